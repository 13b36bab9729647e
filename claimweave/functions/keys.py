"""Derived keys: identity computed from what a thing is (rows F14-F20, F28, S4, H35)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimweave.functions import text
from claimweave.functions.let import let

STAGES = ("primary", "runoff", "general", "special", "caucus")
FIRST_CYCLE, LAST_CYCLE = 1788, 2200
_SLUG = "[a-z0-9]+(?:-[a-z0-9]+)*"
DIVISION = r"ocd-division/[a-z0-9:_~.\-/]+"
CONTEST = rf"^({DIVISION})/({_SLUG})/(\d{{4}})/({'|'.join(STAGES)})(?:/({_SLUG}))?$"
EVENT = r"^(ocd-division/.+)/([a-z_]+)/(\d{4}-\d{2}-\d{2})(?:/([^/]+))?$"
POLL = rf"^(.+)/({_SLUG})/(\d{{4}}-\d{{2}}-\d{{2}})$"
#: Precisions that name a day or less.
DAY_OR_FINER = ("day", "hour", "minute", "second", "exact")


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def contest_parts(key: Column) -> Column:
    """struct(division, office, cycle, stage, party); all null where the key is none.

    One match tells all parts: no part holds a line break, which stands between them until they are split.
    """
    split = lambda k: F.when(k.rlike(CONTEST), F.split(F.regexp_replace(k, CONTEST + "(?s:.*)", "$1\n$2\n$3\n$4\n$5"), "\n", -1))

    def checked(p: Column) -> Column:
        fine = p[2].cast("int").between(FIRST_CYCLE, LAST_CYCLE) & ~((p[3] == "general") & (p[4] != ""))
        return F.when(fine, p)

    def named(p: Column) -> Column:
        return F.struct(
            p[0].alias("division"), p[1].alias("office"), p[2].cast("int").alias("cycle"), p[3].alias("stage"), F.nullif(p[4], F.lit("")).alias("party")
        )

    return let(let(let(key, split), checked), named)


def contest_key(division: Column, office: Column, cycle: Column, stage: Column, party: Column | None = None) -> Column:
    """the key, or null where a part breaks the rules: characters of the division, slugs, the range of cycles, a
    known stage, and no party on a general contest."""
    party = F.lit(None).cast("string") if party is None else party

    def checked(p: Column) -> Column:
        fine = p["division"].rlike(f"^{DIVISION}$") & p["office"].rlike(f"^{_SLUG}$") & p["cycle"].between(FIRST_CYCLE, LAST_CYCLE) & p["stage"].isin(*STAGES)
        key = F.concat_ws("/", p["division"], p["office"], p["cycle"].cast("string"), p["stage"], p["party"])
        return F.when(fine & (p["party"].isNull() | p["party"].rlike(f"^{_SLUG}$") & (p["stage"] != "general")), key)

    # Parts are often expressions of many patterns: each is computed once, however often the rules name it.
    return let(
        F.struct(division.alias("division"), office.alias("office"), cycle.alias("cycle"), stage.alias("stage"), party.alias("party")), checked
    )


def built_contest_key(division: Column, office: Column, cycle: Column, stage: Column, party: Column | None = None) -> Column:
    """F14 from text for people: the division in lower case, office and party as slugs."""
    party = None if party is None else text.slug(party)
    return contest_key(F.lower(F.trim(division)), text.slug(office), cycle, stage, party)


def division_label(division: Column) -> Column:
    """the value of the last level, in capitals."""
    return F.upper(F.element_at(F.split(F.element_at(F.split(division, "/"), -1), ":"), -1))


def division_level(division: Column) -> Column:
    """The type of the last level."""
    return F.split_part(F.element_at(F.split(division, "/"), -1), F.lit(":"), F.lit(1))


def contest_label(parts: Column) -> Column:
    """for people to read."""
    words = lambda c: F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))
    return F.concat_ws(
        " ", division_label(parts["division"]), words(parts["office"]), parts["cycle"].cast("string"), words(parts["party"]), words(parts["stage"])
    )


def at_stage(parts: Column, stage: Column) -> Column:
    """F16: the same seat and cycle at another stage; the party drops out of a general contest."""
    return let(parts, lambda p: contest_key(p["division"], p["office"], p["cycle"], stage, F.when(stage != "general", p["party"])))


def office_key(division: Column, office: Column) -> Column:
    return F.concat_ws("/", division, office)


def election_key(division: Column, cycle: Column, stage: Column) -> Column:
    return F.concat_ws("/", division, cycle.cast("string"), stage)


def event_key(division: Column, kind: Column, at: Column, precision: Column, host: Column) -> Column:
    """null where the date is coarser than a day."""
    return F.when(
        precision.isin(*DAY_OR_FINER) & division.isNotNull() & at.isNotNull(), F.concat_ws("/", division, kind, F.date_format(at, "yyyy-MM-dd"), host)
    )


def event_parts(key: Column) -> Column:
    """struct(division, kind, day, host)."""
    return F.struct(*(_part(key, EVENT, k).alias(n) for k, n in enumerate(("division", "kind", "day", "host"), 1)))


def poll_key(contest: Column, pollster: Column, ended: Column) -> Column:
    """null without an end of fieldwork."""
    return F.when(ended.isNotNull(), F.concat_ws("/", contest, pollster, F.date_format(ended, "yyyy-MM-dd")))


def poll_parts(key: Column) -> Column:
    """struct(contest, pollster, ended)."""
    return F.struct(*(_part(key, POLL, k).alias(n) for k, n in enumerate(("contest", "pollster", "ended"), 1)))


def federal_contest_key(office: Column, state: Column, district: Column, cycle: Column, party: Column) -> Column:
    """the primary that a federal candidate runs in: P the country, S a state, H a state's district (00 is 1).

    The party is part of the key, independent where none is given. Null where a state is needed and missing.
    """
    number = F.regexp_replace(F.trim(F.coalesce(district, F.lit(""))), "^0+", "")
    country, at = F.lit("ocd-division/country:us"), F.nullif(F.lower(F.trim(state)), F.lit(""))
    place = F.concat(country, F.lit("/state:"), at)
    seat = F.concat(place, F.lit("/cd:"), F.when(number == "", "1").otherwise(number))
    division = F.when(office == "P", country).when(office == "S", place).when(office == "H", seat)
    name = F.when(office == "P", "president").when(office == "S", "us-senate").when(office == "H", "us-house")
    return built_contest_key(division, name, cycle, F.lit("primary"), text.party_slug(F.coalesce(F.nullif(party, F.lit("")), F.lit("independent"))))


def candidate_file_url(cycle: int) -> str:
    """Where the federal candidate file of a cycle is published."""
    return f"https://www.fec.gov/files/bulk-downloads/{cycle}/cn{cycle % 100:02d}.zip"
