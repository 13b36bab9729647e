"""Parsers of printed cells (rows F21-F25, F29, F36-F38, F40, H20, H39)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimweave.functions.let import let

#: What stands in a cell that says nothing, in lower case.
ABSENT = ("", "—", "–", "-", "n/a", "tba")
#: The names of months; the first three letters do, too, and "sept".
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_DASH = r"\s*[–—−-]\s*"
_SIDE = r"^(?:([a-z]+)\s+)?(\d{1,2})(?:,\s*(\d{4}))?$"
_SAMPLE = r"^([\d,]+)?\s*\(?\s*([a-z]+)?\s*\)?$"
_DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)$"
POPULATIONS = ("lv", "rv", "a", "v")


def _cleaned(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _month(name: Column) -> Column:
    """The number of a month by its name; null for other words."""
    known = {m: k for k, m in enumerate(MONTHS, 1)} | {m[:3]: k for k, m in enumerate(MONTHS, 1)} | {"sept": 9}
    return F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), name)


def fieldwork(text: Column) -> Column:
    """struct(started DATE, ended DATE), both null for what is vague.

    Within a month, across months and across years ("December 30 – January 2, 2026" starts in 2025). Each side may
    leave out what the other states, but the month and the year must be known from one of them.
    """

    def side(said: Column) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(said, _SIDE, k), F.lit(""))
        return F.struct(
            said.rlike(_SIDE).alias("fine"), _month(part(1)).alias("month"), part(2).cast("int").alias("day"), part(3).cast("int").alias("year")
        )

    def split(parts: Column) -> Column:
        one, fine = F.size(parts) == 1, (F.size(parts) <= 2).alias("fine")
        return let(side(parts[0]), lambda a: F.struct(fine, a.alias("a"), F.when(one, a).otherwise(side(F.get(parts, F.lit(1)))).alias("b")))

    def day(y: Column, m: Column, d: Column) -> Column:
        said = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string"))
        return F.when((y >= 0) & m.isNotNull() & d.isNotNull(), said.try_cast("date"))

    def dated(x: Column) -> Column:
        a, b = x["a"], x["b"]
        month, year = F.coalesce(b["month"], a["month"]), F.coalesce(b["year"], a["year"])
        known = x["fine"] & a["fine"] & b["fine"] & month.isNotNull() & year.isNotNull()
        started = day(F.coalesce(a["year"], year), F.coalesce(a["month"], month), a["day"])
        return F.struct(F.when(known, started).alias("started"), F.when(known, day(year, month, b["day"])).alias("ended"))

    def ordered(x: Column) -> Column:
        before = F.when(x["started"] > x["ended"], day(F.year(x["started"]) - 1, F.month(x["started"]), F.day(x["started"]))).otherwise(x["started"])
        both = before.isNotNull() & x["ended"].isNotNull()
        return F.struct(F.when(both, before).alias("started"), F.when(both, x["ended"]).alias("ended"))

    return let(let(let(F.split(F.replace(_cleaned(text), F.lit("."), F.lit("")), _DASH), split), dated), ordered)


def _absent(text: Column) -> Column:
    return text.isNull() | _cleaned(text).isin(*ABSENT)


def sample(text: Column) -> Column:
    """struct(size INT, population STRING, refused BOOLEAN). "437 (LV)", "905 LV"; a rough "~329" is refused."""
    none = F.lit(None)
    said = F.regexp_replace(_cleaned(text), r"^(?:n/a|tba|—|–|-)\s*", "")
    size = F.regexp_replace(F.nullif(F.regexp_extract(said, _SAMPLE, 1), F.lit("")), ",", "").try_cast("int")
    population = F.nullif(F.regexp_extract(said, _SAMPLE, 2), F.lit(""))
    refused = ~_absent(text) & ~(said.rlike(_SAMPLE) & (size.isNotNull() | population.isNotNull()))
    told = lambda c: F.when(~refused & ~_absent(text), c).otherwise(none)
    return F.struct(
        told(size).alias("size"), F.when(~refused, F.coalesce(told(population), F.lit("unknown"))).alias("population"),
        F.coalesce(refused, F.lit(False)).alias("refused")
    )


def _number(text: Column, signs: str) -> Column:
    """struct(value DECIMAL(6,3), refused) of a cell without some signs: absent, read or refused."""

    def told(x: Column) -> Column:
        refused = text.isNotNull() & ~x["said"].isin(*ABSENT) & ~x["fine"]
        return F.struct(F.when(x["fine"], x["said"].try_cast("decimal(6,3)")).alias("value"), F.coalesce(refused, F.lit(False)).alias("refused"))

    cleaned = F.trim(F.regexp_replace(_cleaned(text), signs, ""))
    return let(let(cleaned, lambda said: F.struct(said.alias("said"), said.rlike(_DECIMAL).alias("fine"))), told)


def margin(text: Column) -> Column:
    """struct(value DECIMAL(6,3), refused): "± 4.7%" is 4.7."""
    return _number(text, "[±%]")


def margin_or_null(text: Column) -> Column:
    """The margin, null also where it is refused."""
    return margin(text)["value"]


def percentage(text: Column) -> Column:
    """struct(value DECIMAL(6,3), refused); "<1%" and "3o%" are refused, a dash is absent."""
    return _number(text, "%")


def votes(text: Column) -> Column:
    """a count of digits with or without commas, null if unreadable."""
    said = F.trim(F.regexp_replace(text, ",", ""))
    return F.when(said.rlike("^[0-9]+$"), said.try_cast("bigint"))


def share(text: Column) -> Column:
    """a share with or without its sign."""
    said = F.trim(F.regexp_replace(text, "%", ""))
    return F.when(said.rlike(_DECIMAL), said.try_cast("decimal(6,3)"))


def utc(ts: Column) -> Column:
    """a time without zone is UTC, the session's zone."""
    return ts.cast("timestamp")


def geoid(state: Column, county: Column, tract: Column, block: Column) -> Column:
    """the codes joined up to the first that is missing; null without a state."""
    tail = F.when(county.isNotNull(), F.concat(county, F.when(tract.isNotNull(), F.concat(tract, F.coalesce(block, F.lit("")))).otherwise("")))
    return F.when(state.isNotNull(), F.concat(state, F.coalesce(tail, F.lit(""))))


def coordinates(text: Column) -> Column:
    """struct(lon, lat) of "lon,lat"; both null where out of range or unreadable."""
    parts = F.split(text, ",")
    lon, lat = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    fine = (F.size(parts) == 2) & lon.between(-180, 180) & lat.between(-90, 90)
    return F.struct(F.when(fine, lon).alias("lon"), F.when(fine, lat).alias("lat"))


def wkt(lon: Column, lat: Column) -> Column:
    """F38."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")))


def fieldwork_text(started: Column, ended: Column) -> Column:
    """H20: "a to b", a question mark for what is missing."""
    day = lambda d: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("?"))
    return F.concat(day(started), F.lit(" to "), day(ended))
