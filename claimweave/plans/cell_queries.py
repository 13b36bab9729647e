"""Registered queries of names, keys, cells, files and pages: inputs are printed from the tables and read back.

Where a query reads files, it first lands them in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.functions import canon, keys, parse, text
from claimweave.operators import geocode, runs
from claimweave.plans import catalog
from claimweave.plans.graph import Graph
from claimweave.plans.materialize import landing
from claimweave.plans.registry import query
from claimweave.sources import delimited, exchange, html, store


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _pick(k: Column, *choices: str | None) -> Column:
    """The choice of a number, going round."""
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(k, F.lit(len(choices))) + 1).cast("int"))


def _sql_pick(k: str, *choices: str | None) -> str:
    said = ", ".join("NULL" if c is None else "'" + c.replace("'", "''") + "'" for c in choices)
    return f"([{said}]::VARCHAR[])[({k}) % {len(choices)} + 1]"


_CODES = ("DEM", "rep", " LIB ", "GRE", "NON", "WFP", "", None, "ind")
_SLUGS = ("democratic", "republican", "libertarian", "green", "nonpartisan", "wfp", None, None, "independent")


@query(f"SELECT c_custkey, {_sql_pick('c_custkey', *_SLUGS)} AS slug FROM customer")
def party_slugs(g: Graph) -> DataFrame:
    """codes of federal files, in any case, blank and unknown ones among them."""
    return g.raw("customer").select("c_custkey", text.party_slug(_pick(F.col("c_custkey"), *_CODES)).alias("slug"))


_NOTES = (" (withdrawn)", " (withdrew) ", "(deceased)", " (Disqualified)", " (incumbent) (write-in)", "  (writein)", " (junior)", "")


@query(f"SELECT c_custkey, c_name || {_sql_pick('c_custkey', '', '', '', '', '', '', ' (junior)', '')} AS name FROM customer")
def candidate_names(g: Graph) -> DataFrame:
    """names with the annotations of a ballot; other parentheses stay."""
    printed = F.concat("c_name", _pick(F.col("c_custkey"), *_NOTES))
    return g.raw("customer").select("c_custkey", text.candidate_name(printed).alias("name"))


@query("""SELECT c_custkey, lower(c_name) || ' é' AS name, 'name-space' AS namespace, 'e' || c_custkey || '-' || lower(c_mktsegment) AS slug, c_name || ', ' || c_mktsegment AS line FROM customer""")
def normalized_names(g: Graph) -> DataFrame:
    """Full-width and accented letters, runs of blanks, blank parts."""
    wide = F.concat(F.lit("　 "), F.translate("c_name", "C", "Ｃ"), F.lit(" \t É "))
    line = text.one_line(F.col("c_name"), F.lit("  "), F.concat(F.col("c_mktsegment"), F.lit(" ")))
    named = F.concat(F.lit("E  "), _text("c_custkey"), F.lit("--"), F.col("c_mktsegment"), F.lit("!"))
    slug = F.regexp_replace(text.slug(named), "^e-", "e")
    return g.raw("customer").select(
        "c_custkey", text.normalize_name(wide).alias("name"), text.namespace(F.lit(" Name-Space ")).alias("namespace"), slug.alias("slug"),
        line.alias("line")
    )


_FILE = """f AS (SELECT c_custkey AS k, 'C' || c_custkey AS id, ['P', 'S', 'H', 'X'][c_custkey % 4 + 1] AS office, ['WI', 'mi', ''][c_custkey % 3 + 1] AS state, lpad((c_custkey % 11)::VARCHAR, 2, '0') AS district,
    ['C', 'N', 'P'][c_custkey % 5 % 3 + 1] AS status, [2026, 2026, 2024][c_custkey % 7 % 3 + 1] AS year, ['DEM', 'rep', '', 'WFP'][c_custkey % 13 % 4 + 1] AS party FROM customer)"""
_PLACE = "CASE office WHEN 'P' THEN 'ocd-division/country:us/president' WHEN 'S' THEN 'ocd-division/country:us/state:' || lower(state) || '/us-senate' ELSE 'ocd-division/country:us/state:' || lower(state) || '/cd:' || greatest(1, k % 11) || '/us-house' END"


def _federal_file(g: Graph) -> DataFrame:
    k = F.col("c_custkey")
    fields = {
        "CAND_ID": F.concat(F.lit("C"), _text("c_custkey")),
        "CAND_NAME": F.concat(F.lit('"DOE, '), F.col("c_name"), F.lit('"')),
        "CAND_PTY_AFFILIATION": _pick(k % 13, "DEM", "rep", "", "WFP"),
        "CAND_ELECTION_YR": _pick(k % 7, "2026", "2026", "2024"),
        "CAND_OFFICE_ST": _pick(k, "WI", "mi", ""),
        "CAND_OFFICE": _pick(k, "P", "S", "H", "X"),
        "CAND_OFFICE_DISTRICT": F.lpad((k % 11).cast("string"), 2, "0"),
        "CAND_ICI": F.lit("C"),
        "CAND_STATUS": _pick(k % 5, "C", "N", "P"),
    }
    return g.raw("customer").select(F.concat_ws("|", *(fields.get(c, F.lit("")) for c in delimited.FEDERAL_COLUMNS)).alias("value"))


@query(f"""WITH {_FILE} SELECT id AS "CAND_ID", 'DOE, ' || c_name AS "CAND_NAME", CASE WHEN office = 'P'
    OR state <> '' THEN {_PLACE} || '/2026/primary/' || ['democratic', 'republican', 'independent', 'wfp'][k % 13 % 4 + 1] END AS contest_key,
    CASE WHEN office <> 'P' AND state = '' THEN id || ' has no office state' END AS error FROM f JOIN customer ON c_custkey = k WHERE office <> 'X'
    AND status <> 'P' AND year = 2026""")
def federal_contest_keys(g: Graph) -> DataFrame:
    """A candidate file, written and read; usable rows with the party in their key."""
    folder = landing(g.spark, "federal")
    _federal_file(g).write.text(folder)
    scan = delimited.rows(g.spark, f"{folder}/*.txt", delimited.FEDERAL_COLUMNS, "|")
    return delimited.federal_candidates(scan, 2026).select("CAND_ID", "CAND_NAME", "contest_key", "error")


_DIVISIONS = (
    "ocd-division/country:us", " OCD-Division/country:us/state:wi ", "ocd-division/Bad Div!/x", "country:us",
    "ocd-division/country:us/district:d_c.x~1"
)
_FINE = ("ocd-division/country:us", "ocd-division/country:us/state:wi", None, None, "ocd-division/country:us/district:d_c.x~1")


@query(f"""WITH k AS (SELECT o_orderkey, {_sql_pick('o_orderkey', *_FINE)} AS d, year(o_orderdate) - CASE
    WHEN o_orderkey % 11 = 0 THEN 300 ELSE 0 END AS y, {_sql_pick('o_orderkey // 5', 'primary', 'general', 'runoff', 'Primary')} AS s,
        {_sql_pick('o_orderkey // 20', None, 'working-families')} AS p FROM orders),
    b AS (SELECT *, CASE WHEN d IS NOT NULL AND y >= 1788 AND s <> 'Primary' AND (p IS NULL
    OR s <> 'general') THEN d || '/us-senate/' || y || '/' || s || coalesce('/' || p, '') END AS key FROM k)
    SELECT o_orderkey, key, CASE WHEN key IS NOT NULL THEN p END AS party, CASE
    WHEN key IS NOT NULL THEN d || '/us-senate/' || y || '/general' END AS successor FROM b""")
def contest_key_rules(g: Graph) -> DataFrame:
    """Built from text for people; odd characters, other prefixes, cycles and stages, and a general's party are refused."""
    k = F.col("o_orderkey")
    year = F.year("o_orderdate") - F.when(k % 11 == 0, 300).otherwise(0)
    whole = lambda n: F.floor(k / n)
    key = keys.built_contest_key(
        _pick(k, *_DIVISIONS), F.lit(" US Senate "), year, _pick(whole(5), "primary", "general", "runoff", "Primary"),
        _pick(whole(20), None, "Working Families")
    )
    # One projection after the other: a key is built once and read once.
    built = g.raw("orders").select("o_orderkey", key.alias("key")).withColumn("parts", keys.contest_parts(F.col("key")))
    return built.select("o_orderkey", "key", F.col("parts.party").alias("party"), keys.at_stage(F.col("parts"), F.lit("general")).alias("successor"))


_LEVEL = "CASE n_nationkey % 4 WHEN 0 THEN 'state' WHEN 1 THEN 'county' WHEN 2 THEN 'precinct' ELSE 'state' END"


@query(f"""WITH d AS (SELECT n_nationkey AS k, 'ocd-division/country:us/' || {_LEVEL} || ':n' || n_nationkey AS id, CASE
    WHEN n_nationkey % 5 = 3 THEN '' ELSE n_name || ', "the"' END AS name, {_LEVEL} AS level FROM nation)
    SELECT id, name, level, name <> '' AND level <> 'precinct' AS kept, CASE WHEN name <> ''
    AND level <> 'precinct' THEN lower(name) END AS normalized_name FROM d""")
def division_rows(g: Graph) -> DataFrame:
    """A division file, quoted and with a header, written and read; rows kept become mentions."""
    level = _pick(F.col("n_nationkey"), "state", "county", "precinct", "state")
    ident = F.concat(F.lit("ocd-division/country:us/"), level, F.lit(":n"), _text("n_nationkey"))
    name = F.when(F.col("n_nationkey") % 5 == 3, " ").otherwise(F.concat(F.lit(' "'), F.col("n_name"), F.lit(', ""the"""')))
    folder = landing(g.spark, "divisions")
    lines = g.raw("nation").select(F.concat(ident, F.lit(","), F.trim(name)).alias("value"))
    head = g.spark.range(1).select(F.lit("id,name").alias("value"), F.lit(0).alias("k"))
    ordered = head.unionByName(lines.withColumn("k", F.lit(1))).coalesce(1).sortWithinPartitions("k")
    ordered.select("value").write.text(folder)
    found = delimited.divisions(delimited.rows(g.spark, f"{folder}/*.txt", ("id", "name"), header=True), ("state", "county"))
    mentions = runs.division_mentions(found.where("kept")).select(F.col("mention_id").alias("id"), "normalized_name")
    return found.withColumn("level", keys.division_level(F.col("id"))).join(mentions, "id", "left").select(
        "id", "name", "level", "kept", "normalized_name"
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice)::BIGINT WHEN 1 THEN o_orderkey * 1000 END AS votes, CASE WHEN o_orderkey % 3 < 2 THEN (o_custkey % 1000 / 10)::DECIMAL(6,3) END AS share FROM orders""")
def vote_cells(g: Graph) -> DataFrame:
    """counts with and without commas, shares with and without a sign; what is no number is null."""
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, F.format_number(F.floor("o_totalprice"), 0)).when(
        k % 4 == 1, F.concat(F.lit(" "), (k * 1000).cast("string"))
    ).when(k % 4 == 2, F.concat(_text("o_orderkey"), F.lit(".5"))).otherwise("n/a")
    share = F.concat((F.col("o_custkey") % 1000 / 10).cast("decimal(5,1)").cast("string"), _pick(k, "%", " ", "[a]"))
    return g.raw("orders").select("o_orderkey", parse.votes(said).alias("votes"), parse.share(share).alias("share"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 8 AS k, (l_tax * 100)::DECIMAL(6,3) AS t FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN k < 3 THEN t END AS margin, k IN (6, 7) AS margin_refused, CASE WHEN k = 2 THEN t END AS share, k IN (0, 1, 6, 7) AS share_refused,
    CASE k WHEN 0 THEN 1234 WHEN 1 THEN 905 WHEN 2 THEN 3045 END AS size, CASE k WHEN 0 THEN 'lv' WHEN 1 THEN 'rv' WHEN 2 THEN 'lv' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unknown' WHEN 5 THEN 'v' END AS population, k IN (6, 7) AS size_refused FROM c""")
def poll_cells(g: Graph) -> DataFrame:
    """Margins, shares and samples as pages print them, absent and refused ones among them."""
    k, t = (F.col("l_orderkey") + F.col("l_linenumber")) % 8, (F.col("l_tax") * 100).cast("decimal(6,3)").cast("string")
    margin = F.when(
        k == 0, F.concat(F.lit("± "), t, F.lit("%"))
    ).when(k == 1, F.concat(F.lit("±"), t)).when(k == 2, F.concat(t, F.lit("%"))).otherwise(
        _pick(k - 3, "—", "TBA", "n/a", "?", "about 3")
    )
    size = _pick(k, "1,234 (LV)", "905 RV", "3,045 LV)", "tba", "–", "– (V)", "~329", "?")
    m, p, s = parse.margin(margin), parse.percentage(margin), parse.sample(size)
    return g.raw("lineitem").select(
        "l_orderkey", "l_linenumber", parse.margin_or_null(margin).alias("margin"), m["refused"].alias("margin_refused"), p["value"].alias("share"),
        p["refused"].alias("share_refused"), s["size"].alias("size"), s["population"].alias("population"), s["refused"].alias("size_refused")
    )


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 9 AS k, o_orderdate::DATE AS a FROM orders)
    SELECT o_orderkey, CASE WHEN k < 3 THEN a WHEN k = 3 THEN make_date(year(a) - 1, 12, 28) END AS started, CASE WHEN k = 0 THEN a WHEN k < 3 THEN a + 40 WHEN k = 3 THEN make_date(year(a), 1, 3) END AS ended,
    CASE WHEN k = 0 THEN a || ' to ' || a WHEN k < 3 THEN a || ' to ' || a + 40 WHEN k = 3 THEN (year(a) - 1) || '-12-28 to ' || year(a) || '-01-03' ELSE '? to ?' END AS said FROM d""")
def fieldwork_cells(g: Graph) -> DataFrame:
    """Single days, short and dotted months, every dash, across years; vague, impossible and reworded ones refused."""
    k, a = F.col("o_orderkey") % 9, F.col("o_orderdate").cast("date")
    b = F.date_add(a, 40)
    fmt = lambda d, f: F.date_format(d, f)
    said = (
        F.when(k == 0, fmt(a, "MMMM d, yyyy"))
        .when(k == 1, F.concat(fmt(a, "MMM. d, yyyy"), F.lit(" — "), fmt(b, "MMM d, yyyy")))
        .when(k == 2, F.concat(F.lower(fmt(a, "MMMM d, yyyy")), F.lit("−"), fmt(b, "MMMM d,  yyyy")))
        .when(k == 3, F.concat(F.lit("December 28 – January 3, "), fmt(a, "yyyy")))
        .otherwise(_pick(k - 4, "through July 30", "July 2026", "February 30, 2026", "July 1 to July 3, 2026", "TBA"))
    )
    f = parse.fieldwork(said)
    return g.raw("orders").select(
        "o_orderkey", f["started"].alias("started"), f["ended"].alias("ended"), parse.fieldwork_text(f["started"], f["ended"]).alias("said")
    )


@query("""WITH c AS (SELECT c_custkey AS k, (c_custkey % 360 - 180)::DOUBLE AS lon, (c_custkey % 200 - 100)::DOUBLE AS lat FROM customer)
    SELECT k, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN '55' WHEN k % 10 = 2 THEN '55025' ELSE '55025000100' || k % 1000 END AS geoid, CASE WHEN abs(lat) <= 90 AND k % 7 > 0 THEN lon END AS lon, CASE WHEN abs(lat) <= 90 AND k % 7 > 0 THEN lat END AS lat,
    CASE WHEN abs(lat) <= 90 AND k % 7 > 0 THEN 'POINT(' || lon || ' ' || lat || ')' END AS wkt FROM c""")
def place_codes(g: Graph) -> DataFrame:
    """Codes joined up to the first that is missing; coordinates out of range or unreadable are none."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    code = parse.geoid(F.when(k % 10 != 0, "55"), F.when(k % 10 != 1, "025"), F.when(k % 10 != 2, "000100"), (k % 1000).cast("string"))
    said = F.concat((k % 360 - 180).cast("string"), F.when(k % 7 == 0, ";").otherwise(","), (k % 200 - 100).cast("string"))
    p = parse.coordinates(F.coalesce(said, none))
    return g.raw("customer").select(
        k.alias("k"), code.alias("geoid"), p["lon"].alias("lon"), p["lat"].alias("lat"), parse.wkt(p["lon"], p["lat"]).alias("wkt")
    )


_JSON = """'{"amount":"' || l_quantity::INTEGER || '","line":' || l_linenumber || ',"note":' || CASE WHEN l_returnflag = 'A' THEN 'null' ELSE '"' || l_returnflag || ' \\"x\\""' END || '}'"""


@query(f"""SELECT l_orderkey, l_linenumber, {_JSON} AS canonical, sha256({_JSON}) AS hash, 'assert:' || sha256('{{"anchor":"' || l_partkey || '","run":"r\\u0026"}}') AS idempotency_key,
    sha256('{{"excerpt":null,"locator":{{"json_pointer":"/rows/' || l_linenumber || '","kind":"json"}},"source_snapshot_id":"s' || l_suppkey || '"}}') AS anchor FROM lineitem""".replace("\\u0026", "&"))
def canonical_hashes(g: Graph) -> DataFrame:
    """Canonical JSON with escapes, its hash, keys of operations and fingerprints of anchors."""
    note = canon.json_text(F.when(F.col("l_returnflag") != "A", F.concat(F.col("l_returnflag"), F.lit(' "x"'))))
    body = canon.canonical_object(note=note, amount=canon.json_text(canon.decimal(F.format_string("%.2f", "l_quantity"))), line=_text("l_linenumber"))
    at = canon.locator(F.lit("json"), F.concat(F.lit('{"json_pointer": "'), delimited.locator(F.col("l_linenumber")), F.lit('"}')))
    anchor = canon.anchor_fingerprint(F.concat(F.lit("s"), _text("l_suppkey")), at, F.lit(None).cast("string"))
    return g.raw("lineitem").select(
        "l_orderkey", "l_linenumber", body.alias("canonical"), canon.sha256(body).alias("hash"),
        canon.idempotency_key("assert", run=F.lit("r&"), anchor=F.col("l_partkey")).alias("idempotency_key"), anchor.alias("anchor")
    )


@query(f"""WITH h AS (SELECT p_partkey, sha1(unhex('{catalog.SPACE.hex}') || encode('part/' || p_partkey)) AS h FROM part)
    SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INTEGER % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def named_ids(g: Graph) -> DataFrame:
    """name-based UUIDs."""
    return g.raw("part").select("p_partkey", canon.uuid5(catalog.SPACE, F.concat(F.lit("part/"), _text("p_partkey"))).alias("id"))


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, '')))::BIGINT AS byte_length
    FROM documents),
    k AS (SELECT sha256, max(byte_length) AS byte_length, count(*) AS n, min(doc_id) AS first FROM d WHERE doc_id % 3 > 0 GROUP BY 1)
    SELECT d.sha256, any_value(d.byte_length) AS byte_length, 'sha256/' || substr(d.sha256, 1, 2) || '/' || substr(d.sha256, 3, 2) || '/' || d.sha256 AS key, bool_or(k.sha256 IS NOT NULL) AS stored, coalesce(max(k.n), 0) > 1 AS archived_twice FROM d LEFT JOIN k USING (sha256) GROUP BY d.sha256""")
def stored_objects(g: Graph) -> DataFrame:
    """Two thirds of the documents put into a store, twice; which of all are there, and which were seen more than once."""
    kept = store.ObjectStore(g.spark, landing(g.spark, "objects"))
    texts = g.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    some = texts.where("doc_id % 3 > 0").select("content")
    kept.put(some)
    kept.put(some)
    everything = texts.select(
        F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("byte_length")
    ).groupBy("sha256").agg(F.max("byte_length").alias("byte_length"))
    seen = store.already_archived(some.select(F.sha2("content", 256).alias("sha256"))).select("sha256", F.lit(True).alias("twice"))
    gone = kept.missing(everything).withColumn("stored", F.lit(False))
    held = kept.get(everything).select("sha256", F.lit(True).alias("there"))
    out = everything.join(gone, "sha256", "left").join(held, "sha256", "left").join(seen, "sha256", "left")
    stored = F.coalesce("there", F.lit(False)) & F.coalesce("stored", F.lit(True))
    return out.select(
        "sha256", "byte_length", canon.content_key(F.col("sha256")).alias("key"), stored.alias("stored"),
        F.coalesce("twice", F.lit(False)).alias("archived_twice")
    )


@query("""SELECT 'E' || p_size AS event_ticker, 'M' || p_partkey AS ticker, p_name AS title, CASE WHEN p_partkey % 9 > 0 THEN (p_retailprice / 10000)::DECIMAL(28,6) END AS last_price_dollars, CASE WHEN p_partkey % 5 > 0 THEN TIMESTAMP '2026-01-01 00:00:00' END AS open_time, p_partkey AS volume FROM part""")
def market_records(g: Graph) -> DataFrame:
    """Landed events of an exchange, dollars as decimals, times as timestamps, null where unreadable."""
    price = F.when(F.col("p_partkey") % 9 > 0, (F.col("p_retailprice") / 10000).cast("decimal(28,6)").cast("string")).otherwise("x")
    opened = F.when(F.col("p_partkey") % 5 > 0, "2026-01-01T00:00:00Z").otherwise("soon")
    market = F.struct(
        F.concat(F.lit("M"), _text("p_partkey")).alias("ticker"), F.col("p_name").alias("title"), F.lit("open").alias("status"),
        opened.alias("open_time"), F.col("p_partkey").alias("volume"), price.alias("last_price_dollars")
    )
    event = F.struct(F.concat(F.lit("E"), _text("p_size")).alias("event_ticker"), F.lit("t").alias("title"))
    nested = g.raw("part").groupBy("p_size").agg(F.collect_list(market).alias("markets")).select(event.alias("event"), "markets")
    folder = landing(g.spark, "exchange")
    nested.select(F.to_json(F.struct("event", "markets")).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(folder)
    return exchange.markets(exchange.events(g.spark, f"{folder}/*.txt")).select(
        "event_ticker", "ticker", "title", "last_price_dollars", F.convert_timezone(None, F.lit("UTC"), F.col("open_time").cast("timestamp_ntz")).alias("open_time"), "volume"
    )


@query("""WITH c AS (SELECT 'k' || c_custkey AS key, c_custkey AS k, c_name FROM customer)
    SELECT key, CASE WHEN k % 6 = 5 OR k % 6 = 4 THEN 'no_match' WHEN k % 6 = 3 THEN 'tie' WHEN k % 2 = 0 THEN 'exact' ELSE 'approximate' END AS quality, CASE WHEN k % 6 < 3 THEN '"Q" ' || c_name || ', MADISON, WI' END AS matched_address,
    CASE WHEN k % 6 < 3 THEN -89.5 + (k % 10) / 10.0::DOUBLE END AS lon, CASE WHEN k % 6 < 3 THEN 43.0::DOUBLE END AS lat, CASE WHEN k % 6 < 3 THEN '550250001001034' END AS geoid FROM c""")
def geocode_results(g: Graph) -> DataFrame:
    """Addresses sent in batches to a service made up here, which matches, ties, fails, loses its point, or does not answer."""

    def service(lines: list[str]) -> list[str]:
        import csv
        import io

        out = io.StringIO()
        answers = csv.writer(out, quoting=csv.QUOTE_ALL)
        for key, street, city, state, postcode in csv.reader(lines):
            k = int(key[1:])
            if k % 6 == 5:
                continue
            said = [key, f"{street}, {city}, {state}, {postcode}", "Tie" if k % 6 == 3 else "Match"]
            if k % 6 != 3:
                point = "" if k % 6 == 4 else f"{-89.5 + (k % 10) / 10.0},43.0"
                said += ["Exact" if k % 2 == 0 else "Non_Exact", f'"Q" {street}, {city}, {state}', point, "1", "L", "55", "025", "000100", "1034"]
            answers.writerow(said)
        return out.getvalue().splitlines()

    rows = g.raw("customer").select(
        F.concat(F.lit("k"), _text("c_custkey")).alias("key"), F.col("c_name").alias("street"), F.lit("MADISON").alias("city"),
        F.lit("WI").alias("state"), F.lit("53703").alias("postcode")
    )
    return geocode.geocode(rows, service, 500)


def _page_of(section: Column, *parts: Column) -> Column:
    return F.concat(F.lit("<html><style>h2 {}</style><h2>"), section, F.lit("</h2>"), *parts, F.lit("</html>"))


_HEADINGS = (
    "Republican primary runoff", "Democratic primary", "General election", "Nonpartisan blanket primary", "Primary elections", "Runoff election",
    "Green primary", "Background"
)
_STAGES = ("runoff", "primary", "general", "primary", "primary", "runoff", None, None)
_PARTIES = ("republican", "democratic", None, None, None, None, None, None)


def _poll_pages(g: Graph) -> DataFrame:
    """A page per supplier and month with a table row per line: pollster spanning both rows of a line, a footnote, a
    margin, two options and a marker row; then a table of averages, which is none of polls."""
    line = F.col("line").cast("string")
    day = F.date_format("l_shipdate", "MMMM d, yyyy")
    share = F.col("l_quantity").cast("int").cast("string")
    size = F.when(F.col("l_linenumber") == 7, "~329").otherwise(F.concat(share, F.lit("00 (LV)")))
    lead = F.concat(
        F.lit('<tr><td rowspan="2">Firm '), line, F.lit('<sup class="mw-ref reference">[1]</sup></td><td rowspan=2>'), day, F.lit("</td><td>")
    )
    first = F.concat(lead, size, F.lit("</td><td>±&nbsp;3.5%</td><td>"), share, F.lit("%</td><td>—</td><td></td></tr>"))
    second = F.concat(
        F.lit("<tr><td>tba</td><td>–</td><td>1</td><td>2%</td><td></td></tr>"),
        F.when(F.col("l_linenumber") == 1, F.lit('<tr><td colspan="7">Bob withdraws</td></tr>')).otherwise("")
    )
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.concat(first, second).alias("t")))), lambda x: x["t"]), "")
    head = "<h3>Polling</h3><table><tr><th>Poll source</th><th>Date(s)<br>administered</th><th>Sample size</th><th>Margin<br>of error</th><th>Ann</th><th>Bob</th><th> </th></tr>"
    mean = "<h3>Polling</h3><table><tr><th>Source of poll aggregation</th><th>Dates</th><th>Sample</th><th>Margin of error</th><th>Ann</th></tr><tr><td>Mean</td><td>July 1, 2026</td><td>1</td><td>1</td><td>40</td></tr></table>"
    pages = g.lines().groupBy("l_suppkey").agg(rows.alias("t"))
    return pages.select(
        F.col("l_suppkey").alias("page_id"),
        _page_of(_pick(F.col("l_suppkey"), *_HEADINGS), F.lit(head), F.col("t"), F.lit("</table>" + mean)).alias("html")
    )


@query(f"""WITH l AS (SELECT l_suppkey AS page_id, 'Firm ' || line AS pollster, min(l_shipdate::DATE) AS day, min(l_quantity::INTEGER) AS q,
    min(l_linenumber) AS n, count(*) AS c FROM g_lines
        WHERE l_suppkey % 8 < 6 GROUP BY l_suppkey, line HAVING count(*) = 1),
    r AS (SELECT *, {_sql_pick('page_id', *_STAGES)} AS stage, {_sql_pick('page_id', *_PARTIES)} AS party FROM l)
    SELECT page_id, stage, party, pollster, day AS started, day AS ended, q * 100 AS sample_size, 'lv' AS population, 3.5::DECIMAL(6,3) AS margin, 'Ann' AS option, q::DECIMAL(6,3) AS percentage, NULL AS error FROM r WHERE n <> 7
    UNION ALL SELECT page_id, stage, party, pollster, day, day, NULL, 'unknown', NULL, u.o, u.v::DECIMAL(6,3), NULL FROM r, (VALUES ('Ann', 1), ('Bob', 2)) AS u(o, v) WHERE n <> 7
    UNION ALL SELECT page_id, stage, party, pollster, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'sample' FROM r WHERE n = 7""")
def poll_rows(g: Graph) -> DataFrame:
    """Pages with poll tables made from lines, read back; a poll with a refused cell is refused whole."""
    twice = g.lines().groupBy("l_suppkey", "line").agg(F.count("*").alias("c")).where("c > 1").groupBy(F.col("l_suppkey").alias("page_id")).agg(
        F.collect_list(F.concat(F.lit("Firm "), _text("line"))).alias("twice")
    )
    found = html.poll_readings(html.polls(html.tables(_poll_pages(g))))
    # Joined by page alone, as whose readings lie already.
    fine = F.col("twice").isNull() | ~F.array_contains("twice", F.col("pollster"))
    return found.join(twice, "page_id", "left").where(fine).select(
        "page_id", "stage", "party", "pollster", "started", "ended", "sample_size", "population", "margin", "option", "percentage", "error"
    )


def _result_pages(g: Graph) -> DataFrame:
    line = F.col("c_custkey").cast("string")
    note = _pick(F.col("c_custkey"), " (incumbent)", " (withdrawn)", "", " (write-in)")
    votes = F.format_number("c_custkey", 0)
    row = F.concat(
        F.lit("<tr><td>A</td><td>"), F.col("c_name"), note, F.lit("</td><td>"), votes, F.lit("</td><td>"), (F.col("c_custkey") % 100).cast("string"),
        F.when(F.col("c_custkey") % 3 > 0, "%").otherwise("?"), F.lit("</td></tr>")
    )
    who = F.concat(F.lit("<li><b>"), F.col("c_name"), F.lit("</b> , mayor, of &amp; in "), line, F.lit("</li>"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", c.alias("t")))), lambda x: x["t"]), "")
    pages = g.raw("customer").groupBy("c_nationkey").agg(
        joined(row).alias("rows"), joined(F.when(F.col("c_custkey") % 5 == 0, who).otherwise("")).alias("listed")
    )
    nominees = F.when(
        F.col("c_nationkey") % 3 > 0,
        F.concat(F.lit("<h3>Candidates</h3><h4>Nominee</h4><ul>"), F.col("listed"), F.lit("</ul><h4>Withdrawn</h4><ul><li>Nobody</li></ul>"))
    ).otherwise("")
    table = "<h3>Results</h3><table><tr><th>Party</th><th>Candidate</th><th>Votes</th><th> %</th></tr>"
    other = "".join(
        f"<tr><td></td><td>{n}</td><td>5</td><td>1</td></tr>" for n in (
            "Turnout", "Others", "Majority", "N/A", "Write-in", "Total votes", "", "Plurality"
        )
    )
    plain = "<table><tr><th>Candidate</th><th>Votes</th></tr><tr><td>Cy</td><td>5</td></tr></table>"
    return pages.select(
        F.col("c_nationkey").cast("long").alias("page_id"),
        _page_of(_pick(F.col("c_nationkey"), *_HEADINGS), nominees, F.lit(table), F.col("rows"), F.lit(other + "</table>" + plain)).alias("html")
    )


@query(f"""SELECT c_nationkey::BIGINT AS page_id, {_sql_pick('c_nationkey', *_STAGES)} AS stage, {_sql_pick('c_nationkey', *_PARTIES)} AS party, c_name AS candidate, c_custkey AS votes,
    CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 100)::DECIMAL(6,3) END AS share, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_custkey % 5 = 0 END AS won FROM customer WHERE c_nationkey % 8 < 6
    AND c_nationkey NOT IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) FILTER (c_custkey % 5 = 0) = 0)""")
def result_rows(g: Graph) -> DataFrame:
    """Pages with results made from customers, read back; who won only where a list of nominees says so."""
    pages = _result_pages(g)
    listed = g.raw("customer").where("c_custkey % 5 = 0").select(F.col("c_nationkey").cast("long").alias("page_id")).distinct()
    found = html.results(html.cells(pages), html.items(pages))
    return found.join(listed, "page_id", "left_semi").select("page_id", "stage", "party", "candidate", "votes", "share", "won")


@query("""WITH t AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages),
    u AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS n FROM t)
    SELECT page_id, n::INTEGER AS item_no, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM u""")
def page_items(g: Graph) -> DataFrame:
    """List items of all pages."""
    return html.items(g.raw("pages").select("page_id", "html")).select("page_id", "item_no", "text")
