"""The claims graph over star-schema tables.

Projects the tables of a folder into the graph's tables, deterministically: jurisdictions from regions and nations,
persons from customers, organisations from suppliers, options from parts, contests from (nation, segment, year),
claims from orders and lines, polls from (supplier, month), reviews from events. ORACLE holds the same projections as
DuckDB views, written independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from claimweave.functions import keys, text
from claimweave.plans.materialize import cut


def _id(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


class Graph:
    """Graph tables of one folder, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def settled(self) -> Graph:
        """This graph with its contests written once, for queries that read entities and identifiers many times: they are
        few, but take a join of all orders with their customers."""
        out, contests = Graph(self.spark, self.folder), cut(self.contests())
        out.contests = lambda: contests
        return out

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def orders(self) -> DataFrame:
        """Orders with the contest that each runs in."""
        customers = self.raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        year = F.year("o_orderdate")
        joined = self.raw("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return joined.withColumn(
            "contest_id", F.concat_ws("/", F.lit("k"), F.col("c_nationkey").cast("string"), F.lower("c_mktsegment"), year.cast("string"))
        ).withColumn("year", year)

    def contests(self) -> DataFrame:
        """contest_id, contest_key, nation_id, office_id for every (nation, segment, year) with an order."""
        nations = self.raw("nation").select("n_nationkey", "n_regionkey")
        seen = self.orders().select("contest_id", "c_nationkey", F.lower("c_mktsegment").alias("segment"), "year").distinct()
        joined = seen.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        division = F.concat(
            F.lit("ocd-division/country:r"), F.col("n_regionkey").cast("string"), F.lit("/state:n"), F.col("n_nationkey").cast("string")
        )
        key = keys.contest_key(division, F.col("segment"), F.col("year"), F.lit("general"))
        return joined.select(
            "contest_id", key.alias("contest_key"), _id("n", "n_nationkey").alias("nation_id"),
            F.concat(F.lit("o/"), F.col("segment")).alias("office_id")
        )

    def entity(self) -> DataFrame:
        """id, kind, canonical_name."""
        named = (
            ("region", "r", "r_regionkey", "jurisdiction", "r_name"), ("nation", "n", "n_nationkey", "jurisdiction", "n_name"),
            ("customer", "c", "c_custkey", "person", "c_name"), ("supplier", "s", "s_suppkey", "organization", "s_name"),
            ("part", "p", "p_partkey", "option", "p_name")
        )
        parts = [self.raw(t).select(_id(p, k).alias("id"), F.lit(kind).alias("kind"), F.col(n).alias("canonical_name")) for t, p, k, kind, n in named]
        contests = self.contests()
        parts.append(contests.select(F.col("contest_id").alias("id"), F.lit("contest").alias("kind"), F.col("contest_key").alias("canonical_name")))
        parts.append(
            contests.select(
                F.col("office_id").alias("id"), F.lit("office").alias("kind"), F.substring("office_id", 3, 99).alias("canonical_name")
            ).distinct()
        )
        parts.append(
            self.raw("events").select(
                _id("e", "event_id").alias("id"), F.lit("event").alias("kind"),
                F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("canonical_name")
            )
        )
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def alias(self) -> DataFrame:
        """entity_id, name, normalized_name: the names of entities, and for suppliers a short form."""
        own = self.entity().select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
        short = self.raw("supplier").select(
            _id("s", "s_suppkey").alias("entity_id"), F.concat(F.lit("Supp "), (F.col("s_suppkey") % 40).cast("string")).alias("name")
        )
        return own.unionByName(short).withColumn("normalized_name", text.ascii_name(F.col("name")))

    def identifier(self) -> DataFrame:
        """entity_id, namespace, value."""
        nations = self.raw("nation").select(
            _id("n", "n_nationkey").alias("entity_id"), F.lit("ocd-division").alias("namespace"),
            F.concat(
                F.lit("ocd-division/country:r"), F.col("n_regionkey").cast("string"), F.lit("/state:n"), F.col("n_nationkey").cast("string")
            ).alias("value")
        )
        contests = self.contests().select(
            F.col("contest_id").alias("entity_id"), F.lit("contest-key").alias("namespace"), F.col("contest_key").alias("value")
        )
        people = self.raw("customer").select(
            _id("c", "c_custkey").alias("entity_id"), F.lit("wikidata").alias("namespace"),
            F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("value")
        )
        parts = self.raw("part").select(
            _id("p", "p_partkey").alias("entity_id"), F.lit("ballotpedia").alias("namespace"),
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("value")
        )
        return nations.unionByName(contests).unionByName(people).unionByName(parts)

    def redirect(self) -> DataFrame:
        """duplicate_id, canonical_id: chains of up to two steps among suppliers."""
        s = self.raw("supplier").where("s_suppkey % 10 in (1, 2)")
        return s.select(
            _id("s", "s_suppkey").alias("duplicate_id"), F.concat(F.lit("s"), (F.col("s_suppkey") - 1).cast("string")).alias("canonical_id")
        )

    def _claims(
        self, df: DataFrame, slug: str, claim_id: Column, subject: Column, obj: Column | None = None, value: Column | None = None,
        at: Column | None = None, since: Column | None = None, until: Column | None = None, created: Column | None = None
    ) -> DataFrame:
        none, when = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
        pick = lambda c, d, n: (d if c is None else c).alias(n)
        first = F.coalesce(*(c for c in (created, at, since) if c is not None), when)
        return df.select(
            claim_id.alias("id"), F.lit(slug).alias("predicate"), subject.alias("subject_id"), pick(obj, none, "object_id"),
            pick(value, none, "value"), pick(at, when, "valid_at"), pick(since, when, "valid_from"), pick(until, when, "valid_to"),
            first.alias("created_at")
        )

    def candidacies(self) -> DataFrame:
        later = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        o = self.orders().withColumn("until", later)
        return self._claims(
            o, "candidate_in", _id("ci", "o_orderkey"), _id("c", "o_custkey"), F.col("contest_id"), since=F.col("o_orderdate"), until=F.col("until")
        )

    def results(self) -> DataFrame:
        """Votes are orders per (customer, contest); contests of even years say who won, others do not."""
        votes = self.orders().groupBy("contest_id", "o_custkey", "year").agg(F.count("*").alias("votes"), F.max("o_orderdate").alias("at"))
        place = F.row_number().over(Window.partitionBy("contest_id").orderBy(F.desc("votes"), "o_custkey"))
        part = F.floor(F.col("votes") * 10000 / F.sum("votes").over(Window.partitionBy("contest_id"))).cast("decimal(8,0)") / 100
        rows = votes.withColumns({"place": place, "share": part.cast("decimal(6,2)").cast("string")})
        won = F.when(F.col("year") % 2 == 0, F.col("place") == 1)
        rows = rows.withColumn("value", F.to_json(F.struct("votes", "share", "place", won.alias("won")), {"ignoreNullFields": "false"}))
        return self._claims(
            rows, "contest_result", F.concat_ws(":", F.lit("cr"), "contest_id", F.col("o_custkey").cast("string")), _id("c", "o_custkey"),
            F.col("contest_id"), F.col("value"), created=F.col("at")
        )

    def donations(self) -> DataFrame:
        lines = self.lines()
        value = F.to_json(F.struct(F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("amount"), F.lit("USD").alias("currency")))
        return self._claims(
            lines, "donated_to", F.concat(F.lit("do"), F.col("line").cast("string")), _id("s", "l_suppkey"), _id("p", "l_partkey"), value,
            at=F.col("l_shipdate")
        )

    def structure(self) -> DataFrame:
        c = self.contests()
        office = self._claims(c, "contest_for_office", F.concat(F.lit("cf:"), F.col("contest_id")), F.col("contest_id"), F.col("office_id"))
        place = self._claims(c, "contest_in_jurisdiction", F.concat(F.lit("cj:"), F.col("contest_id")), F.col("contest_id"), F.col("nation_id"))
        return office.unionByName(place)

    def happenings(self) -> DataFrame:
        """Claims on events: kind, participant, place and occurrence."""
        e, me = self.raw("events"), _id("e", "event_id")
        ids = lambda p: F.concat(F.lit(p), F.col("event_id").cast("string"))
        value = lambda k, c: F.to_json(F.struct(c.alias(k)))
        status = F.when(F.col("event_type") == "error", "cancelled").otherwise("occurred")
        kind = self._claims(e, "event_kind", ids("ek"), me, value=value("kind", F.col("event_type")), created=F.col("ts"))
        who = self._claims(e, "participated_in", ids("pi"), _id("c", "user_id"), me, value("role", F.lit("candidate")), created=F.col("ts"))
        where = self._claims(
            e, "event_in_jurisdiction", ids("ej"), me, F.concat(F.lit("n"), (F.col("user_id") % 25).cast("string")), created=F.col("ts")
        )
        when = self._claims(e, "event_occurrence", ids("eo"), me, value=value("status", status), since=F.col("ts"))
        return kind.unionByName(who).unionByName(where).unionByName(when)

    def claim(self) -> DataFrame:
        """id, predicate, subject_id, object_id, value, valid_at, valid_from, valid_to, created_at."""
        parts = (self.candidacies(), self.results(), self.donations(), self.structure(), self.happenings())
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def lines(self) -> DataFrame:
        """Lines with ``line``, a number that orders them and is unique up to repeated (order, number) pairs."""
        return self.raw("lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))

    def assertion(self) -> DataFrame:
        """seq, claim_id, asserted_by, stance, run_id, page_id, aligned, violation, confidence."""
        writer = F.when(F.col("l_linenumber") < 7, _id("s", "l_suppkey"))
        stance = F.when(F.col("l_returnflag") == "R", "contradicts").when(F.col("l_returnflag") == "A", "supports").otherwise("mentions")
        bad = F.when(F.col("l_discount") > 0.08, F.concat(F.lit("discount "), F.col("l_discount").cast("decimal(4,2)").cast("string")))
        return self.lines().select(
            F.col("line").alias("seq"), _id("ci", "l_orderkey").alias("claim_id"), writer.alias("asserted_by"), stance.alias("stance"),
            F.concat(F.lit("run-"), F.col("l_linestatus")).alias("run_id"), (F.col("l_partkey") % 200).alias("page_id"),
            bad.isNull().alias("aligned"), bad.alias("violation"), F.col("l_shipdate").alias("created_at")
        )

    def readings(self) -> DataFrame:
        """Poll readings: revision_id, pollster_id, contest_id, population, option_id, response_count, margin."""
        line = self.lines()
        month = F.date_format("l_shipdate", "yyyyMM")
        contest = F.concat_ws("/", F.lit("k"), (F.col("l_suppkey") % 25).cast("string"), F.lit("building"), F.year("l_shipdate").cast("string"))
        return line.select(
            F.concat_ws("-", F.concat(F.lit("pr"), F.col("l_suppkey").cast("string")), month).alias("revision_id"),
            _id("s", "l_suppkey").alias("pollster_id"), contest.alias("contest_id"), F.lower("l_returnflag").alias("population"),
            _id("p", "l_partkey").alias("option_id"), F.col("l_quantity").cast("long").alias("response_count"),
            (F.col("l_tax") * 100).cast("decimal(6,3)").alias("margin"), F.col("l_shipdate").cast("date").alias("day"),
            (F.col("l_suppkey") * 7 % 150).alias("review_key")
        )

    def revisions(self) -> DataFrame:
        """revision_id, pollster_id, contest_id, review_key, started, ended."""
        return self.readings().groupBy("revision_id", "pollster_id", "contest_id", "review_key").agg(
            F.min("day").alias("started"), F.max("day").alias("ended")
        )

    def decision(self) -> DataFrame:
        """seq, target (of review), outcome."""
        outcome = F.when(
            F.col("event_type") == "purchase", "accepted"
        ).when(F.col("event_type") == "error", "rejected").otherwise("changes_requested")
        return self.raw("events").select(
            F.col("event_id").alias("seq"), F.col("user_id").alias("target"), outcome.alias("outcome"), F.col("ts").alias("created_at")
        )

    def task(self) -> DataFrame:
        """id, target, status, priority, created_at."""
        status = F.when(
            F.col("event_type").isin("click", "signup"), "pending"
        ).when(F.col("event_type") == "view", "claimed").when(F.col("event_type") == "purchase", "completed").otherwise("cancelled")
        return self.raw("events").select(
            _id("q", "event_id").alias("id"), F.col("user_id").alias("target"), status.alias("status"), (F.col("user_id") % 100).alias("priority"),
            F.col("ts").alias("created_at")
        )


ORACLE = {
    "g_orders": """SELECT o.*, c_nationkey, lower(c_mktsegment) AS segment, year(o_orderdate) AS yr,
        'k/' || c_nationkey || '/' || lower(c_mktsegment) || '/' || year(o_orderdate) AS contest_id FROM orders o
    JOIN customer ON o_custkey = c_custkey""",
    "g_contests": """SELECT DISTINCT contest_id, 'ocd-division/country:r' || n_regionkey || '/state:n' || n_nationkey || '/' || segment || '/' || yr || '/general' AS contest_key,
        'n' || n_nationkey AS nation_id, 'o/' || segment AS office_id FROM g_orders JOIN nation ON c_nationkey = n_nationkey""",
    "g_entity": """SELECT 'r' || r_regionkey AS id, 'jurisdiction' AS kind, r_name AS canonical_name FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'jurisdiction', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'person', c_name FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'organization', s_name FROM supplier UNION ALL SELECT 'p' || p_partkey, 'option', p_name FROM part
        UNION ALL SELECT contest_id, 'contest', contest_key FROM g_contests UNION ALL SELECT DISTINCT office_id, 'office', substr(office_id, 3)
    FROM g_contests
        UNION ALL SELECT 'e' || event_id, 'event', event_type || ' ' || user_id FROM events""",
    "g_alias": """SELECT id AS entity_id, canonical_name AS name, lower(canonical_name) AS normalized_name FROM g_entity
        UNION ALL SELECT 's' || s_suppkey, 'Supp ' || (s_suppkey % 40), 'supp ' || (s_suppkey % 40) FROM supplier""",
    "g_identifier": """SELECT 'n' || n_nationkey AS entity_id, 'ocd-division' AS namespace, 'ocd-division/country:r' || n_regionkey || '/state:n' || n_nationkey AS value FROM nation
        UNION ALL SELECT contest_id, 'contest-key', contest_key FROM g_contests UNION ALL SELECT 'c' || c_custkey, 'wikidata', 'Q' || c_custkey
    FROM customer
        UNION ALL SELECT 'p' || p_partkey, 'ballotpedia', 'P' || p_partkey FROM part""",
    "g_redirect": "SELECT 's' || s_suppkey AS duplicate_id, 's' || (s_suppkey - 1) AS canonical_id FROM supplier WHERE s_suppkey % 10 IN (1, 2)",
    "g_lines": "SELECT *, l_orderkey * 10 + l_linenumber AS line FROM lineitem",
    "g_candidacy": """SELECT 'ci' || o_orderkey AS id, 'candidate_in' AS predicate, 'c' || o_custkey AS subject_id, contest_id AS object_id, NULL::VARCHAR AS value, NULL::TIMESTAMP AS valid_at,
        o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate, o_orderkey) AS valid_to, o_orderdate AS created_at FROM g_orders""",
    "g_votes": "SELECT contest_id, o_custkey, yr, count(*) AS votes, max(o_orderdate) AS seen_at FROM g_orders GROUP BY ALL",
    "g_result": """SELECT 'cr:' || contest_id || ':' || o_custkey AS id, 'contest_result' AS predicate, 'c' || o_custkey AS subject_id, contest_id AS object_id,
        '{"votes":' || votes || ',"share":"' || (floor(votes * 10000 / sum(votes) OVER (PARTITION BY contest_id)) / 100)::DECIMAL(6,2) || '","place":' || row_number() OVER (PARTITION BY contest_id ORDER BY votes DESC, o_custkey)
        || ',"won":' || CASE WHEN yr % 2 = 1 THEN 'null' WHEN row_number() OVER (PARTITION BY contest_id
    ORDER BY votes DESC, o_custkey) = 1 THEN 'true' ELSE 'false' END || '}' AS value,
        NULL::TIMESTAMP AS valid_at, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to, seen_at AS created_at FROM g_votes""",
    "g_donation": """SELECT 'do' || line AS id, 'donated_to' AS predicate, 's' || l_suppkey AS subject_id, 'p' || l_partkey AS object_id,
        '{"amount":"' || l_extendedprice::DECIMAL(18,2) || '","currency":"USD"}' AS value, l_shipdate AS valid_at, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to, l_shipdate AS created_at FROM g_lines""",
    "g_structure": """SELECT 'cf:' || contest_id AS id, 'contest_for_office' AS predicate, contest_id AS subject_id, office_id AS object_id, NULL::VARCHAR AS value, NULL::TIMESTAMP AS valid_at, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to, NULL::TIMESTAMP AS created_at FROM g_contests
        UNION ALL SELECT 'cj:' || contest_id, 'contest_in_jurisdiction', contest_id, nation_id, NULL, NULL, NULL, NULL, NULL FROM g_contests""",
    "g_happening": """SELECT 'ek' || event_id AS id, 'event_kind' AS predicate, 'e' || event_id AS subject_id, NULL::VARCHAR AS object_id, '{"kind":"' || event_type || '"}' AS value, NULL::TIMESTAMP AS valid_at, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to, ts AS created_at FROM events
        UNION ALL SELECT 'pi' || event_id, 'participated_in', 'c' || user_id, 'e' || event_id, '{"role":"candidate"}', NULL, NULL, NULL, ts
    FROM events
        UNION ALL SELECT 'ej' || event_id, 'event_in_jurisdiction', 'e' || event_id, 'n' || (user_id % 25), NULL, NULL, NULL, NULL, ts FROM events
        UNION ALL SELECT 'eo' || event_id, 'event_occurrence', 'e' || event_id, NULL, '{"status":"' || CASE WHEN event_type = 'error' THEN 'cancelled' ELSE 'occurred' END || '"}', NULL, ts, NULL, ts FROM events""",
    "g_claim": "FROM g_candidacy UNION ALL FROM g_result UNION ALL FROM g_donation UNION ALL FROM g_structure UNION ALL FROM g_happening",
    "g_assertion": """SELECT line AS seq, 'ci' || l_orderkey AS claim_id, CASE WHEN l_linenumber < 7 THEN 's' || l_suppkey END AS asserted_by,
        CASE l_returnflag WHEN 'R' THEN 'contradicts'
    WHEN 'A' THEN 'supports' ELSE 'mentions' END AS stance, 'run-' || l_linestatus AS run_id, l_partkey % 200 AS page_id,
        l_discount <= 0.08 AS aligned, CASE
    WHEN l_discount > 0.08 THEN 'discount ' || l_discount::DECIMAL(4,2) END AS violation, l_shipdate AS created_at FROM g_lines""",
    "g_reading": """SELECT 'pr' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m') AS revision_id, 's' || l_suppkey AS pollster_id, 'k/' || (l_suppkey % 25) || '/building/' || year(l_shipdate) AS contest_id,
        lower(l_returnflag) AS population, 'p' || l_partkey AS option_id, l_quantity::BIGINT AS response_count, (l_tax * 100)::DECIMAL(6,3) AS margin, l_shipdate::DATE AS day, l_suppkey * 7 % 150 AS review_key FROM g_lines""",
    "g_revision": "SELECT revision_id, pollster_id, contest_id, review_key, min(day) AS started, max(day) AS ended FROM g_reading GROUP BY ALL",
    "g_decision": "SELECT event_id AS seq, user_id AS target, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'changes_requested' END AS outcome, ts AS created_at FROM events",
    "g_task": "SELECT 'q' || event_id AS id, user_id AS target, CASE WHEN event_type IN ('click', 'signup') THEN 'pending' WHEN event_type = 'view' THEN 'claimed' WHEN event_type = 'purchase' THEN 'completed' ELSE 'cancelled' END AS status, user_id % 100 AS priority, ts AS created_at FROM events",
}


def oracle(sql: str) -> str:
    """``sql`` with the definitions of the graph views that it uses, and those that they use."""
    used: list[str] = []

    def need(body: str) -> None:
        for name, view in ORACLE.items():
            if name in body and name not in used:
                need(view)
                used.append(name)

    need(sql)
    own = sql.lstrip()
    views = ", ".join(f"{n} AS ({ORACLE[n]})" for n in used)
    if not views:
        return own
    return f"WITH RECURSIVE {views}, {own[5:].removeprefix('RECURSIVE ')}" if own.startswith("WITH ") else f"WITH RECURSIVE {views} {own}"
