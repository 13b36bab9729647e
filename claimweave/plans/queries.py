"""The engine's registered queries over the projected graph, each with SQL written apart from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimweave.functions import canon, keys, parse, text
from claimweave.operators import claims as C, contests as K, ingest as I, integrity as G, polls as P, resolve as R, review as V, search as S, validate as X
from claimweave.plans import catalog
from claimweave.plans.graph import Graph
from claimweave.plans.registry import ORACLES, QUERIES, query  # noqa: F401

INSTANT = "1998-06-01"
DATES = ("1995-06-01", "1996-06-01", "1997-06-01", "1998-06-01", "1999-06-01")
SEARCHES = ("supplier 000000012", "red widget", "nation 7", "building", "purchase 42", "supp 7")


def _at(day: str):
    return F.lit(day).cast("timestamp_ntz")


def _survivors(g: Graph) -> DataFrame:
    return G.survivors(g.redirect())


_ORDER = "coalesce(valid_from, valid_at) DESC NULLS LAST, created_at DESC NULLS LAST, id, subject_id NULLS FIRST, object_id NULLS FIRST, value NULLS FIRST"
_LATEST = f"""SELECT id, predicate, {{side}}, rank::INTEGER AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY {{side}} ORDER BY {_ORDER}) AS rank FROM g_claim WHERE {{side}} IS NOT NULL) WHERE rank <= 100"""


@query(_LATEST.format(side="subject_id"))
def claims_about_subject(g: Graph) -> DataFrame:
    """Q1: the page of the 100 latest claims of every subject."""
    return C.latest(g.claim(), "subject_id").select("id", "predicate", "subject_id", "rank")


@query(_LATEST.format(side="object_id"))
def claims_about_object(g: Graph) -> DataFrame:
    """Q1, as object."""
    return C.latest(g.claim(), "object_id").select("id", "predicate", "object_id", "rank")


@query(f"SELECT id, predicate, object_id, created_at FROM g_claim WHERE subject_id = 's3' ORDER BY {_ORDER} LIMIT 100")
def claims_about_entity(g: Graph) -> DataFrame:
    """Q1: the page of claims of which one organisation is the subject."""
    return C.claims_about(g.claim(), "s3").select("id", "predicate", "object_id", "created_at")


@query(f"""SELECT id, subject_id, object_id FROM g_claim WHERE subject_id IN ('s10', 's11', 's12') AND predicate = 'donated_to'
    AND substr(id, -1) <> '1'""")
def claims_about_merged(g: Graph) -> DataFrame:
    """Q1 with what it leaves out unless asked: claims of merged entities, but not those that were replaced."""
    gone = g.donations().where("id like '%1'").select("id")
    found = C.claims_about(g.claim(), "s10", "donated_to", limit=None, merged=_survivors(g), superseded=gone)
    return found.select("id", "subject_id", "object_id")


_PROVENANCE = "SELECT claim_id, count(*) AS n, coalesce(array_to_string(list_sort(list(DISTINCT asserted_by) FILTER (asserted_by IS NOT NULL)), ','), '') AS w FROM g_assertion GROUP BY claim_id"


@query(f"""WITH page AS (SELECT * FROM g_claim WHERE predicate = 'candidate_in'
    ORDER BY valid_from DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 100), pr AS ({_PROVENANCE})
    SELECT p.id, subject_id, s.canonical_name AS subject_name, object_id, o.canonical_name AS object_name, valid_from, coalesce(n, 0) AS assertions,
    coalesce(w, '') AS writers, valid_from IS NOT NULL AND valid_to IS NULL AS is_open
    FROM page p JOIN g_entity s ON s.id = subject_id LEFT JOIN g_entity o ON o.id = object_id LEFT JOIN pr ON pr.claim_id = p.id""")
def claims_with_predicate(g: Graph) -> DataFrame:
    """Q2, Q4, Q6, Q8: the page of the 100 latest candidacies with names and provenance."""
    out = C.materialized(C.claims_with(g.candidacies(), "candidate_in"), g.entity(), g.assertion())
    return out.select("id", "subject_id", "subject_name", "object_id", "object_name", "valid_from", "assertions", "writers", "is_open")


@query(f"""SELECT id, predicate, subject_id, object_id FROM g_claim WHERE (valid_from <= TIMESTAMP '{INSTANT}' AND (valid_to IS NULL
    OR valid_to > TIMESTAMP '{INSTANT}')) OR valid_at = TIMESTAMP '{INSTANT}'""")
def claims_at_instant(g: Graph) -> DataFrame:
    """Q3: every claim that holds at an instant."""
    return g.claim().where(C.valid_at(_at(INSTANT))).select("id", "predicate", "subject_id", "object_id")


@query("""SELECT id, subject_id, object_id, valid_from FROM g_candidacy WHERE subject_id IN (SELECT 'c' || c_custkey FROM customer
    WHERE c_acctbal > 5000)""")
def claims_in_subject_set(g: Graph) -> DataFrame:
    """Q2: candidacies of a set of persons given as a table."""
    rich = g.raw("customer").where("c_acctbal > 5000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return C.claims_with(g.candidacies(), "candidate_in", subjects=rich).select("id", "subject_id", "object_id", "valid_from")


@query(f"""SELECT claim_id, n AS assertions, w AS writers, supports, contradicts, mentions FROM ({_PROVENANCE}) JOIN (SELECT claim_id AS c,
    count(*) FILTER (stance = 'supports') AS supports, count(*) FILTER (stance = 'contradicts') AS contradicts,
    count(*) FILTER (stance = 'mentions') AS mentions FROM g_assertion GROUP BY 1) ON c = claim_id""")
def claim_provenance_summary(g: Graph) -> DataFrame:
    """Q6 with counts by stance."""
    return C.provenance(g.assertion()).join(C.by_stance(g.assertion()), "claim_id")


@query("""SELECT claim_id, seq, stance, coalesce(asserted_by, '(unattributed)') AS asserted_by, a.page_id, url FROM g_assertion a
    JOIN pages p ON p.page_id = a.page_id JOIN g_candidacy c ON c.id = a.claim_id""")
def claim_evidence(g: Graph) -> DataFrame:
    """Q5."""
    return C.evidence(g.candidacies(), g.assertion(), g.raw("pages").select("page_id", "url"))


@query("SELECT object_id AS contest_id, subject_id AS candidate_id, valid_from AS entered, valid_to AS \"left\", valid_to IS NULL AS is_open FROM g_candidacy")
def candidate_stints(g: Graph) -> DataFrame:
    """Q12."""
    return K.candidates_in(g.candidacies())


@query("SELECT day, object_id AS contest_id, count(*) AS candidates FROM g_candidacy, (VALUES " + ", ".join(f"('{d}')" for d in DATES) + ") AS t(day) WHERE valid_from <= day::TIMESTAMP AND (valid_to IS NULL OR valid_to > day::TIMESTAMP) GROUP BY ALL")
def candidates_at_dates(g: Graph) -> DataFrame:
    """Q3, Q12: the field of every contest at five dates, in one pass: each stint is expanded to the dates it covers."""
    days = F.filter(
        F.array(*map(F.lit, DATES)),
        lambda d: (F.col("valid_from") <= d.cast("timestamp_ntz")) & (F.col("valid_to").isNull() | (F.col("valid_to") > d.cast("timestamp_ntz")))
    )
    return g.candidacies().select("object_id", F.explode(days).alias("day")).groupBy(
        "day", F.col("object_id").alias("contest_id")
    ).agg(F.count("*").alias("candidates"))


@query("""SELECT contest_id, candidate_id, votes, share, place, won, row_number() OVER (PARTITION BY contest_id
    ORDER BY votes DESC NULLS LAST, candidate_id)::INTEGER AS rank
    FROM (SELECT object_id AS contest_id, subject_id AS candidate_id, (value->>'votes')::BIGINT AS votes, (value->>'share')::DECIMAL(6,3) AS share, (value->>'place')::INTEGER AS place, (value->>'won')::BOOLEAN AS won FROM g_result)""")
def results_ranked(g: Graph) -> DataFrame:
    """Results by rank, all of the payload; won stays null where unsaid."""
    return K.results(g.results())


@query("""SELECT office_id, contest_id, candidate_id, votes
    FROM (SELECT object_id AS contest_id, subject_id AS candidate_id, (value->>'votes')::BIGINT AS votes FROM g_result WHERE value->>'won' = 'true')
    JOIN g_contests USING (contest_id)""")
def winners_by_office(g: Graph) -> DataFrame:
    """Q14."""
    return K.winners_by_office(g.results().unionByName(g.structure()))


_DETAIL = """SELECT contest_id, contest_key, regexp_extract(contest_key, '^(.*)/[^/]+/[0-9]{4}/general$', 1) AS division, split_part(contest_key, '/', -3) AS office, split_part(contest_key, '/', -2)::INTEGER AS cycle, 'general' AS stage,
    upper(split_part(nation_id, '/', 1)) || ' ' || upper(split_part(contest_key, '/', -3)[1]) || substr(split_part(contest_key, '/', -3), 2) || ' ' || split_part(contest_key, '/', -2) || ' General' AS label, nation_id AS jurisdiction_id FROM g_contests"""


@query(_DETAIL)
def contest_detail(g: Graph) -> DataFrame:
    """Q9, Q16, F14, F15, F20."""
    return K.contests(g.identifier()).drop("party")


@query(_DETAIL + " WHERE starts_with(contest_key, 'ocd-division/country:r1/')")
def contests_by_prefix(g: Graph) -> DataFrame:
    """Q10 without its page."""
    return K.contests_in(g.identifier(), "ocd-division/country:r1/", limit=None).drop("party")


@query(_DETAIL + " WHERE split_part(contest_key, '/', -2) = '1998'")
def contests_by_cycle_stage(g: Graph) -> DataFrame:
    """Q10 by cycle and stage."""
    return K.contests_in(g.identifier(), "ocd-division/", cycle=1998, stage="general", limit=None).drop("party")


@query("SELECT contest_key, replace(contest_key, '/general', '/primary') AS primary_key, contest_id FROM g_contests")
def contest_by_key(g: Graph) -> DataFrame:
    """Q11, F16: every contest looked up under the key that its parts give, and its key a stage earlier."""
    parts = F.struct("division", "office", "cycle", "stage", "party")
    asked = K.contests(g.identifier()).select(
        keys.at_stage(parts, F.lit("general")).alias("value"), keys.at_stage(parts, F.lit("primary")).alias("primary_key")
    )
    return asked.join(g.identifier().where("namespace = 'contest-key'"), "value").select(
        F.col("value").alias("contest_key"), "primary_key", F.col("entity_id").alias("contest_id")
    )


_SURVIVOR = """surv AS (SELECT duplicate_id AS id, canonical_id AS s, 1 AS d FROM g_redirect UNION ALL SELECT surv.id, r.canonical_id, d + 1
    FROM surv JOIN g_redirect r ON r.duplicate_id = surv.s WHERE d < 17),
    closure AS (SELECT id, arg_max(s, d) AS survivor_id, max(d) AS depth FROM surv GROUP BY id)"""
_OPTIONS = "opt AS (SELECT revision_id, population, option_id, sum(response_count)::BIGINT AS n, max(margin) AS margin FROM g_reading GROUP BY ALL)"
_POINTS = f"""{_OPTIONS}, samp AS (SELECT revision_id, population, sum(n)::BIGINT AS sample_size, max(margin) AS margin_of_error, count(*) AS options,
        array_to_string(list(option_id || ' ' || n ORDER BY n DESC, option_id), ', ') AS readings FROM opt GROUP BY ALL),
    lab AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY revision_id) = 1 THEN 'overall' ELSE population END AS sample_label FROM samp),
    last AS (SELECT target, arg_max(outcome, seq) AS o FROM g_decision GROUP BY target)"""


@query(f"""WITH RECURSIVE {_SURVIVOR}, {_POINTS}, pts AS (SELECT contest_id, r.revision_id,
    coalesce(survivor_id, pollster_id) AS pollster, started, ended, sample_label, population,
        sample_size, margin_of_error, options, readings, o IS NOT NULL AS reviewed,
        row_number() OVER (PARTITION BY contest_id ORDER BY ended NULLS LAST, sample_label, r.revision_id, population)::INTEGER AS place
        FROM g_revision r JOIN lab USING (revision_id) LEFT JOIN closure ON id = pollster_id LEFT JOIN last ON target = review_key WHERE o IS NULL
    OR o <> 'rejected')
    SELECT * FROM pts WHERE place <= 500""")
def poll_timeline(g: Graph) -> DataFrame:
    """Every reading of every sample, in order of time."""
    return P.timeline(g.revisions(), g.readings(), g.decision(), _survivors(g))


@query("SELECT target, arg_max(outcome, seq) AS outcome, max(seq) AS seq FROM g_decision GROUP BY target")
def poll_verdicts_latest(g: Graph) -> DataFrame:
    """Q18."""
    return P.latest_verdicts(g.decision())


@query("""WITH o AS (SELECT revision_id, population, option_id, sum(response_count)::BIGINT AS n FROM g_reading GROUP BY ALL),
    t AS (SELECT revision_id, population, sum(n) AS total FROM o GROUP BY ALL)
    SELECT revision_id, population, option_id, n, round(100.0::DOUBLE * n / total, 3) AS percentage FROM o JOIN t USING (revision_id, population)""")
def poll_readings(g: Graph) -> DataFrame:
    """Q20: percentages in every sample."""
    return P.series(g.readings())


@query("""SELECT (SELECT count(*) FROM g_task WHERE status = 'pending') AS pending, (SELECT count(*) FROM g_task
    WHERE status = 'claimed') AS claimed, (SELECT count(*) FROM g_task WHERE status = 'completed') AS completed, count(*) AS decisions,
    count(*) FILTER (o = 'accepted') AS accepted, count(*) FILTER (o = 'rejected') AS rejected FROM (SELECT arg_max(outcome, seq) AS o
    FROM g_decision GROUP BY target)""")
def review_backlog(g: Graph) -> DataFrame:
    """Q21."""
    return V.backlog(g.task(), g.decision())


@query("SELECT * FROM g_task WHERE status = 'pending' ORDER BY priority, created_at, id LIMIT 50")
def review_pending_topk(g: Graph) -> DataFrame:
    """V1."""
    return V.pending(g.task())


@query(f"WITH RECURSIVE {_SURVIVOR} SELECT id, survivor_id, depth::BIGINT AS depth FROM closure")
def redirect_closure(g: Graph) -> DataFrame:
    """R1."""
    return _survivors(g)


@query("SELECT duplicate_id, canonical_id FROM g_redirect WHERE canonical_id IN (SELECT duplicate_id FROM g_redirect)")
def redirect_chains(g: Graph) -> DataFrame:
    """G2."""
    return G.chains(g.redirect())


_RING = "CASE WHEN s_suppkey % 10 <> 9 THEN s_suppkey + 1 WHEN s_suppkey // 10 % 2 = 1 THEN s_suppkey - 8 END"


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM (SELECT s_suppkey AS src, {_RING} AS dst FROM supplier) WHERE dst IS NOT NULL),
    w AS (SELECT src AS start, dst, 1 AS d FROM e UNION ALL SELECT start, e.dst, d + 1 FROM w JOIN e ON w.dst = e.src WHERE d < 10 AND start <> w.dst),
    r AS (SELECT start, max(d) AS n FROM w GROUP BY start HAVING bool_or(dst = start)),
    m AS (SELECT start, min(dst::VARCHAR) AS leader FROM w SEMI JOIN r USING (start) GROUP BY 1)
    SELECT 'supplier' AS graph, m.start::VARCHAR AS id, leader, CASE WHEN m.start::VARCHAR = leader THEN 0 ELSE n - (SELECT min(d) FROM w WHERE w.start = m.start
    AND w.dst::VARCHAR = leader) END::BIGINT AS position FROM m JOIN r USING (start)""")
def graph_cycle_check(g: Graph) -> DataFrame:
    """What is on a cycle, with its place from the cycle's smallest id, in the redirects (none) and in chains of ten of
    which every other one closes on its second member, so that the first only leads into it."""
    k = F.col("s_suppkey")
    to = F.when(k % 10 != 9, k + 1).when(F.expr("s_suppkey div 10 % 2 = 1"), k - 8)
    made = g.raw("supplier").select(k.cast("string").alias("src"), to.cast("string").alias("dst")).where("dst is not null")
    return G.check({"redirect": G.edges(g.redirect(), "duplicate_id", "canonical_id"), "supplier": made})


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER w AS k,
    count(*) OVER (PARTITION BY o_custkey) AS n, last_value(o_orderkey) OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM orders WINDOW w AS (PARTITION BY o_custkey
    ORDER BY o_orderdate, o_orderkey))
    SELECT o_orderkey::VARCHAR AS id, CASE WHEN n - k <= 16 THEN z::VARCHAR END AS survivor_id FROM o WHERE k < n""")
def supersession_terminal(g: Graph) -> DataFrame:
    """The last successor of every order that a later order of its customer supersedes; null beyond 16 steps."""
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = g.raw("orders").select(F.col("o_orderkey").cast("string").alias("src"), later.cast("string").alias("dst")).where("dst is not null")
    return G.terminal(edges).select("id", "survivor_id")


def _grams(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


_ASKED = "asked AS (SELECT query, list_distinct(" + _grams("query") + ") AS q FROM (VALUES " + ", ".join(f"('{q}')" for q in SEARCHES) + ") AS t(query))"
_MATCHES = _ASKED + ", names AS (SELECT DISTINCT entity_id, name, list_distinct(" + _grams("normalized_name") + ") AS g, " + _grams("normalized_name") + " AS o FROM g_alias), hits AS (SELECT query, entity_id, name, q, o, len(list_intersect(q, g))::DOUBLE / (len(q) + len(g) - len(list_intersect(q, g))) AS whole FROM asked, names WHERE len(list_intersect(q, g)) > 0)"


def _asked(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([(q,) for q in SEARCHES], "query string")


@query(f"""WITH RECURSIVE {_SURVIVOR}, {_MATCHES},
    near AS (SELECT * FROM hits WHERE whole >= 0.3),
    ext AS (SELECT query, entity_id, name, whole, q, list_distinct(o[i:j]) AS x
    FROM near, unnest(range(1, len(o) + 1)) AS a(i), unnest(range(i, len(o) + 1)) AS b(j)),
    word AS (SELECT query, entity_id, name, any_value(whole) AS whole,
    max(len(list_intersect(q, x))::DOUBLE / (len(q) + len(x) - len(list_intersect(q, x)))) AS word FROM ext GROUP BY ALL),
    cand AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(word, 9) DESC, round(whole, 9) DESC, name, entity_id) AS c FROM word
    WHERE word >= 0.5),
    deg AS (SELECT e, count(DISTINCT id) AS claims FROM (SELECT id, subject_id AS e FROM g_claim UNION ALL SELECT id, object_id FROM g_claim)
    WHERE e IS NOT NULL GROUP BY e),
    r AS (SELECT query, entity_id, coalesce(survivor_id, entity_id) AS s, name, canonical_name, word, whole, coalesce(claims, 0) AS claims
        FROM cand JOIN g_entity g ON g.id = entity_id LEFT JOIN closure ON closure.id = entity_id LEFT JOIN deg ON e = entity_id WHERE c <= 200),
    p AS (SELECT *, row_number() OVER (PARTITION BY query
    ORDER BY round(word, 9) DESC, claims DESC, round(whole, 9) DESC, canonical_name, entity_id, name) AS k FROM r),
    f AS (SELECT *, row_number() OVER (PARTITION BY query, s ORDER BY k) AS j FROM p WHERE k <= 40),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY k) AS rank FROM f WHERE j = 1)
    SELECT query, rank::INTEGER AS rank, s AS entity_id, g.kind, g.canonical_name, CASE
    WHEN name <> g.canonical_name THEN name END AS matched_alias, round(word, 6) AS word, round(whole, 6) AS whole, claims
    FROM t JOIN g_entity g ON g.id = s WHERE rank <= 20""")
def entity_search_topk(g: Graph) -> DataFrame:
    """The 20 best entities for each of some search texts."""
    return S.search(g.alias(), g.entity(), g.claim(), _survivors(g), _asked(g))


@query(f"WITH {_MATCHES} SELECT query, entity_id, name, round(whole, 6) AS whole FROM hits WHERE whole >= 0.3")
def entity_similarity(g: Graph) -> DataFrame:
    """all aliases over the match threshold."""
    index = S.NameIndex.kept(g.alias())
    return S.bearers(S.matches(index, _asked(g)), index).select(
        "query", "entity_id", "name", F.round("whole", 6).alias("whole")
    )


@query("WITH s AS (SELECT entity_id, name, list_distinct(" + _grams("normalized_name") + ") AS g FROM g_alias WHERE starts_with(entity_id, 's')), n AS (SELECT DISTINCT 'Supp ' || (s_suppkey % 40) AS query FROM supplier), q AS (SELECT query, list_distinct(" + _grams("query") + ") AS q FROM n), m AS (SELECT query, entity_id, name, len(list_intersect(q, g))::DOUBLE / (len(q) + len(g) - len(list_intersect(q, g))) AS w FROM q, s), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(w, 9) DESC, name, entity_id) AS rank FROM m WHERE w >= 0.55) SELECT query, rank::INTEGER AS rank, entity_id, name, round(w, 6) AS whole FROM r WHERE rank <= 5")
def lookalike_pairs(g: Graph) -> DataFrame:
    """Q29: for every short name of a supplier the five closest organisations."""
    names = g.raw("supplier").select(F.concat(F.lit("Supp "), (F.col("s_suppkey") % 40).cast("string")).alias("query")).distinct()
    return S.lookalikes(g.alias(), g.entity(), names, "organization")


@query("""SELECT id, first AS context FROM g_entity LEFT JOIN (SELECT entity_id, arg_min(namespace || ':' || value, namespace) AS first
    FROM g_identifier GROUP BY 1) ON entity_id = id""")
def entity_context(g: Graph) -> DataFrame:
    """Q26."""
    return S.contexts(g.entity(), g.identifier(), g.claim())


@query("""WITH f AS (SELECT id, kind, canonical_name FROM g_entity WHERE kind = 'option' AND canonical_name ILIKE '%widget%'
    ORDER BY canonical_name, id LIMIT 21) SELECT id, kind, canonical_name, (SELECT count(*) FROM f) > 20 AS truncated, aliases FROM (SELECT * FROM f
    ORDER BY canonical_name, id LIMIT 20) LEFT JOIN (SELECT entity_id, array_to_string(list_sort(list(DISTINCT name)), '|') AS aliases FROM g_alias
    GROUP BY 1) ON entity_id = id""")
def find_entities_fragment(g: Graph) -> DataFrame:
    """Q27, Q31, Q32: a page of 20 and whether there is more."""
    return S.find_entities(g.entity(), g.alias(), "Widget", "option")


_LAST = "(SELECT max(ts) FROM events WHERE event_type = 'purchase' AND user_id % 25 = 7)"


@query(f"""SELECT 'e' || event_id AS id, 'event' AS kind, event_type || ' ' || user_id AS canonical_name, ts AS moment, false AS truncated,
    event_type || ' ' || user_id AS aliases FROM events WHERE event_type = 'purchase' AND user_id % 25 = 7 AND ts >= TIMESTAMP '2024-01-10' AND ts <= {_LAST}""")
def find_events_recent(g: Graph) -> DataFrame:
    """Q28, F32: by kind, place and time; the window ends at the instant of the last such event, which is inside."""
    end = g.raw("events").where("event_type = 'purchase' and user_id % 25 = 7").agg(F.max("ts").alias("at")).first()["at"]
    until = F.lit(end).cast("timestamp_ntz")
    return S.find_events(g.entity(), g.happenings(), "purchase", jurisdiction="n7", after=_at("2024-01-10"), before=until, limit=None, aliases=g.alias())


@query("""WITH f AS (SELECT 'e' || event_id AS id, event_type || ' ' || user_id AS canonical_name, ts AS moment FROM events
    WHERE contains(lower(event_type || ' ' || user_id), 'purchase 1') OR event_id % 50 = 3),
    p AS (SELECT *, row_number() OVER (ORDER BY moment DESC NULLS LAST, canonical_name, id) AS k FROM f)
    SELECT id, 'event' AS kind, canonical_name, moment, (SELECT count(*) FROM f) > 20 AS truncated,
    CASE WHEN substr(id, 2)::BIGINT % 50 = 3 THEN 'Old purchase 1 name|' || canonical_name ELSE canonical_name END AS aliases FROM p WHERE k <= 20""")
def find_events_by_name(g: Graph) -> DataFrame:
    """Q28, Q31, Q32: a page of events by a fragment of their name or of one they had before, with aliases and whether there are more."""
    old = g.raw("events").where("event_id % 50 = 3").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("entity_id"), F.lit("Old purchase 1 name").alias("name"),
        F.lit("old purchase 1 name").alias("normalized_name")
    )
    return S.find_events(g.entity(), g.happenings(), name="Purchase 1", aliases=g.alias().unionByName(old))


@query("SELECT 'e' || event_id AS id, ts AS moment FROM events")
def latest_occurrence(g: Graph) -> DataFrame:
    """Q30."""
    return S.latest_occurrence(g.happenings())


@query("""SELECT entity_id, count(DISTINCT id) AS claims FROM (SELECT id, subject_id AS entity_id FROM g_claim UNION ALL SELECT id, object_id
    FROM g_claim) WHERE entity_id IS NOT NULL GROUP BY entity_id""")
def claim_degree(g: Graph) -> DataFrame:
    """Q23."""
    return S.claim_degree(g.claim())


def _mentions(rows: DataFrame, kind: str, name, identifiers) -> DataFrame:
    return rows.select(
        "mention_id", F.lit(kind).alias("kind"), name.alias("name"), text.ascii_name(name).alias("normalized_name"), identifiers.alias("identifiers")
    )


def _no_ids():
    return F.from_json(F.lit("[]"), "array<struct<namespace:string,value:string>>")


@query(f"""WITH RECURSIVE {_SURVIVOR}, a AS (SELECT DISTINCT normalized_name, coalesce(survivor_id, entity_id) AS e FROM g_alias LEFT
    JOIN closure ON id = entity_id WHERE starts_with(entity_id, 's')),
    u AS (SELECT normalized_name, min(e) AS e, array_to_string(list_sort(list(e)), ',') AS l, count(*) AS n FROM a GROUP BY 1),
    m AS (SELECT 'm' || s_suppkey AS mention_id, 'supp ' || (s_suppkey % 40) AS name FROM supplier UNION ALL SELECT 'f' || s_suppkey, lower(s_name)
    FROM supplier)
    SELECT mention_id, CASE WHEN n = 1 THEN e END AS entity_id, CASE WHEN n > 1 THEN l END AS ambiguous_with FROM m
    JOIN u ON normalized_name = name""")
def alias_resolution(g: Graph) -> DataFrame:
    """Mentions by the full name of a supplier, which leads to its survivor, and by a short name that several bear."""
    s = g.raw("supplier")
    ident = lambda p: F.concat(F.lit(p), F.col("s_suppkey").cast("string")).alias("mention_id")
    short = s.select(ident("m"), F.concat(F.lit("Supp "), (F.col("s_suppkey") % 40).cast("string")).alias("name"))
    rows = short.unionByName(s.select(ident("f"), F.col("s_name").alias("name")))
    found = R.by_alias(_mentions(rows, "organization", F.col("name"), _no_ids()), g.alias(), g.entity(), g.identifier(), _survivors(g))
    return found.withColumn("ambiguous_with", F.when(F.col("ambiguous_with").isNotNull(), F.array_join("ambiguous_with", ",")))


@query("""SELECT 'm' || o_orderkey AS mention_id, CASE
    WHEN o_custkey % 4 = 0 THEN 'x' || substr(sha256('person' || chr(31) || 'wikidata=new' || o_custkey), 1, 32) ELSE 'c' || o_custkey END AS entity_id,
    CASE WHEN o_custkey % 4 = 0 THEN 'created' ELSE 'identifier' END AS method FROM orders""")
def identifier_resolution(g: Graph) -> DataFrame:
    """A mention per order by its customer's key; a quarter of the customers have a key that nobody owns."""
    rows = g.raw("orders").withColumn("mention_id", F.concat(F.lit("m"), F.col("o_orderkey").cast("string")))
    key = F.concat(F.when(F.col("o_custkey") % 4 == 0, "new").otherwise("Q"), F.col("o_custkey").cast("string"))
    mentions = _mentions(rows, "person", F.concat(F.lit("Buyer "), F.col("o_custkey").cast("string")), R.mention(wikidata=key))
    return R.resolve(mentions, g.entity(), g.alias(), g.identifier(), _survivors(g)).select("mention_id", "entity_id", "method")


_NEW = "'x' || substr(sha256('{kind}' || chr(31) || '{key}' || {of}), 1, 32)"


@query(f"""SELECT mention_id, CASE c % 6 WHEN 0 THEN 'c' || c WHEN 1 THEN {_NEW.format(kind='person', key='wikidata=Z', of='c')}
    WHEN 2 THEN {_NEW.format(kind='person', key='fec=F', of='c')}
        WHEN 3 THEN 'c' || c WHEN 4 THEN NULL ELSE 'c' || c END AS entity_id, CASE c % 6 WHEN 0 THEN 'identifier' WHEN 1 THEN 'created'
    WHEN 2 THEN 'created' WHEN 3 THEN 'alias' WHEN 4 THEN NULL ELSE 'alias' END AS method,
        CASE WHEN c % 6 = 4 THEN 'wikidata:Q' || c || ' already identifies person c' || c || ', not a contest' END AS error
    FROM (SELECT 'm' || c_custkey AS mention_id, c_custkey AS c FROM customer)""")
def mention_resolution(g: Graph) -> DataFrame:
    """By key, against a contradicting key, past a missed defining key, by name with a new key, with a key of another kind, by name alone."""
    k, n = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    pair = lambda ns, v: F.array(F.struct(F.lit(ns).alias("namespace"), F.concat(F.lit(v), n).alias("value")))
    ids = F.when(k.isin(0, 4), pair(" Wikidata ", "Q")).when(k == 1, pair("wikidata", "Z")).when(k.isin(2, 3), pair("fec", "F")).otherwise(_no_ids())
    rows = g.raw("customer").withColumn("mention_id", F.concat(F.lit("m"), n))
    mentions = _mentions(rows, "person", F.col("c_name"), ids).withColumn("k", F.substring("mention_id", 2, 99).cast("long") % 6)
    mentions = mentions.withColumn("kind", F.when(F.col("k") == 4, "contest").otherwise("person")).withColumn("authoritative", F.col("k") == 2)
    return R.resolve(mentions, g.entity(), g.alias(), g.identifier(), _survivors(g)).select("mention_id", "entity_id", "method", "error")


@query("""SELECT normalized_name, namespace, count(DISTINCT value) AS values, count(DISTINCT entity_id) AS entities
    FROM (SELECT DISTINCT entity_id, normalized_name FROM g_alias) JOIN g_identifier USING (entity_id)
    GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""")
def namesake_contradictions(g: Graph) -> DataFrame:
    """Names whose bearers have different keys in one namespace."""
    return R.namesakes(g.alias(), g.identifier())


_PRINT = """sha256('{"object_id":"' || object_id || '","predicate_version_id":"donated_to","subject_id":"' || subject_id || '","target_kind":"qualified","valid_at":"' || strftime(valid_at, '%Y-%m-%dT%H:%M:%S') || '+00:00","valid_at_precision":"day","valid_from":null,"valid_from_precision":null,"valid_to":null,"valid_to_precision":null,"value":' || value || '}')"""


@query(f"SELECT {_PRINT} AS fingerprint, count(*) AS claims FROM g_donation GROUP BY 1")
def fingerprint_dedup(g: Graph) -> DataFrame:
    """Donations by fingerprint."""
    return I.fingerprinted(g.donations()).groupBy("fingerprint").agg(F.count("*").alias("claims"))


@query("""WITH s AS (SELECT DISTINCT seq, claim_id FROM g_assertion WHERE run_id = 'run-O'), k AS (SELECT DISTINCT seq FROM g_assertion
    WHERE run_id = 'run-F'), f AS (SELECT DISTINCT claim_id FROM g_assertion WHERE run_id = 'run-F'),
    j AS (SELECT s.seq::VARCHAR AS seq, s.claim_id, k.seq IS NOT NULL AS kk, f.claim_id IS NOT NULL AS ff FROM s LEFT JOIN k ON k.seq = s.seq LEFT
    JOIN f ON f.claim_id = s.claim_id), m AS (SELECT claim_id, min(seq) AS first FROM j WHERE NOT kk GROUP BY 1)
    SELECT seq AS idempotency_key, j.claim_id AS fingerprint, CASE WHEN kk THEN 'unchanged' WHEN ff
    OR seq <> first THEN 'corroborated' ELSE 'created' END AS outcome FROM j LEFT JOIN m ON m.claim_id = j.claim_id""")
def corroboration_outcomes(g: Graph) -> DataFrame:
    """One run's assertions recorded after another's."""
    a = g.assertion().select(F.col("seq").cast("string").alias("idempotency_key"), F.col("claim_id").alias("fingerprint"), "run_id")
    before = a.where("run_id = 'run-F'")
    return I.outcomes(a.where("run_id = 'run-O'").drop("run_id").distinct(), before, before).select("idempotency_key", "fingerprint", "outcome")


@query("""SELECT run_id, count(*) AS assertions,
    count(*) FILTER (aligned) AS aligned_n, round(count(*) FILTER (aligned) / count(*)::DOUBLE, 6) AS score FROM g_assertion GROUP BY run_id""")
def assertion_alignment(g: Graph) -> DataFrame:
    """R16 by run."""
    return C.alignment(g.assertion(), "run_id")


@query("SELECT seq AS assertion_seq, 'pending' AS status, 50 AS priority, violation AS reason FROM g_assertion WHERE NOT aligned")
def misaligned_tasks(g: Graph) -> DataFrame:
    """R15."""
    return I.review_tasks(g.assertion())


@query("""SELECT a.contest_id, a.pollster_id, a.revision_id AS a, b.revision_id AS b FROM g_revision a
    JOIN g_revision b ON a.contest_id = b.contest_id AND a.pollster_id = b.pollster_id AND a.revision_id < b.revision_id
    WHERE abs(date_diff('day', a.ended, b.ended)) <= 3""")
def near_duplicate_polls(g: Graph) -> DataFrame:
    """I8."""
    return I.near_duplicates(g.revisions())


@query("""SELECT sha256(coalesce(text, '')) AS sha256, max(octet_length(encode(coalesce(text, ''))))::BIGINT AS byte_length,
    count(*) AS copies, 'sha256/' || substr(sha256(coalesce(text, '')), 1, 2) || '/' || substr(sha256(coalesce(text, '')), 3, 2) || '/' || sha256(coalesce(text, '')) AS content_key FROM documents GROUP BY sha256(coalesce(text, ''))""")
def artifact_dedup(g: Graph) -> DataFrame:
    """Artifacts of all documents, by digest."""
    artifacts = I.observed(g.raw("documents").select("source", F.col("text").alias("content")))[1]
    return artifacts.withColumn("content_key", canon.content_key(F.col("sha256")))


@query("""WITH d AS (SELECT lang AS run_id, sha256(coalesce(text, '')) AS sha256, doc_id, source FROM documents),
    p AS (SELECT run_id, sha256, 'd' || arg_min(doc_id, doc_id) AS prior FROM d WHERE source <> 'src0' GROUP BY 1, 2) SELECT run_id, sha256,
    coalesce(prior, 'new' || doc_id) AS snapshot_id, prior IS NOT NULL AS reused FROM d LEFT JOIN p USING (run_id, sha256)""")
def snapshot_reuse(g: Graph) -> DataFrame:
    """Documents retrieved again, against the earlier snapshots of every source but one."""
    d = g.raw("documents").select(F.col("lang").alias("run_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "doc_id", "source")
    prior = d.where("source <> 'src0'").select(
        "run_id", "sha256", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("snapshot_id"), F.col("doc_id").alias("retrieved_at")
    )
    return I.snapshot_reuse(prior, d.select("run_id", "sha256", F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("snapshot_id")))


@query("""SELECT 'interval_order' AS "constraint", id AS key FROM g_candidacy WHERE valid_to <= valid_from
    UNION ALL SELECT 'claim_unique', id FROM g_donation GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'amount_positive', 'do' || line FROM g_lines WHERE l_extendedprice <= 1000
    UNION ALL SELECT 'stance_known', seq::VARCHAR FROM g_assertion WHERE stance NOT IN ('supports', 'contradicts')
    UNION ALL SELECT DISTINCT 'page_exists', page_id::VARCHAR FROM g_assertion WHERE page_id NOT IN (SELECT page_id FROM pages)
    UNION ALL SELECT 'alignment_paired', seq::VARCHAR FROM g_assertion WHERE aligned <> (violation IS NULL)
    UNION ALL SELECT 'one_open_task', target::VARCHAR FROM g_task WHERE status IN ('pending', 'claimed') GROUP BY target HAVING count(*) > 1""")
def constraint_violations(g: Graph) -> DataFrame:
    """Section 1.8: rows that break temporal, unique, range, enumeration, reference, pairing and partial unique rules."""
    a, pages = g.assertion(), g.raw("pages").select("page_id")
    return X.all_of(
        X.broken(g.candidacies(), "interval_order", "id", F.col("valid_to") > F.col("valid_from")),
        X.repeated(g.donations(), "claim_unique", ["id"]),
        X.broken(g.lines().withColumn("id", F.concat(F.lit("do"), F.col("line").cast("string"))), "amount_positive", "id", F.col("l_extendedprice") > 1000),
        X.broken(a, "stance_known", "seq", X.member("stance", ("supports", "contradicts"))),
        X.dangling(a, "page_exists", "page_id", pages, "page_id"),
        X.broken(a, "alignment_paired", "seq", F.col("aligned") == F.col("violation").isNull()),
        X.repeated(g.task(), "one_open_task", ["target"], "status in ('pending', 'claimed')"),
    )


@query("""SELECT 'e' || event_id AS id, event_type AS event_kind, CASE
    WHEN event_type = 'error' THEN 'cancelled' ELSE 'occurred' END AS status, ts AS starts_at, 'n' || (user_id % 25) AS jurisdiction_id, 1::BIGINT AS participants, 4::BIGINT AS claims FROM events""")
def event_projection(g: Graph) -> DataFrame:
    """The current state of every event, rebuilt from its claims in one aggregation."""
    c = g.happenings()
    event = F.when(F.col("predicate") == "participated_in", F.col("object_id")).otherwise(F.col("subject_id"))
    of = lambda p, v: F.max_by(F.when(F.col("predicate") == p, v), F.when(F.col("predicate") == p, F.col("created_at")))
    return c.groupBy(event.alias("id")).agg(
        of("event_kind", F.get_json_object("value", "$.kind")).alias("event_kind"),
        of("event_occurrence", F.get_json_object("value", "$.status")).alias("status"),
        of("event_occurrence", F.col("valid_from")).alias("starts_at"), of("event_in_jurisdiction", F.col("object_id")).alias("jurisdiction_id"),
        F.count_if(F.col("predicate") == "participated_in").alias("participants"), F.count("*").alias("claims")
    )


@query("""SELECT subject_id AS donor_id, year(valid_at)::INTEGER AS year, count(*) AS gifts, sum((value->>'amount')::DECIMAL(18,2))::DOUBLE AS total
    FROM g_donation GROUP BY 1, 2""")
def donation_rollup(g: Graph) -> DataFrame:
    """Donations per donor and year, summed as decimals."""
    amount = F.get_json_object("value", "$.amount").cast("decimal(18,2)")
    return g.donations().groupBy(F.col("subject_id").alias("donor_id"), F.year("valid_at").alias("year")).agg(
        F.count("*").alias("gifts"), F.sum(amount).cast("double").alias("total")
    )


@query("""WITH o AS (SELECT o_custkey, o_orderdate AS a, max(o_orderdate + INTERVAL 20 DAY) OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders)
    SELECT DISTINCT 'c' || o_custkey AS record_id FROM o WHERE a < b""")
def stint_overlaps(g: Graph) -> DataFrame:
    """Customers with orders less than 20 days apart."""
    entered = F.col("o_orderdate").cast("timestamp")
    stint = F.struct(entered.alias("entered"), (entered + F.expr("interval 20 days")).alias("left"))
    records = g.raw("orders").groupBy(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("record_id")
    ).agg(F.collect_list(stint).alias("stints"))
    return I.overlapping_stints(records)


@query("SELECT count(DISTINCT seq) AS assertions, 0::BIGINT AS created, 0::BIGINT AS corroborated, count(DISTINCT seq) AS unchanged FROM g_assertion")
def idempotent_reingest(g: Graph) -> DataFrame:
    """The same assertions a second time change nothing."""
    a = g.assertion().select(F.col("seq").cast("string").alias("idempotency_key"), F.col("claim_id").alias("fingerprint"))
    again = I.outcomes(a, a, a)
    return again.agg(
        F.count("*").alias("assertions"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "corroborated", "unchanged"))
    )


@query("""WITH kinds AS (SELECT id, kind FROM g_entity),
    c AS (SELECT id, predicate, subject_id, object_id FROM g_claim UNION ALL SELECT 'z' || o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'unheard_of' ELSE 'candidate_in' END,
        CASE o_orderkey % 6 WHEN 1 THEN 'nobody' WHEN 2 THEN 'n1' ELSE 'c' || o_custkey END,
        CASE o_orderkey % 6 WHEN 3 THEN 'nothing' WHEN 4 THEN 's1' WHEN 5 THEN NULL ELSE contest_id END FROM g_orders),
    spec(p, ss, oo) AS (VALUES ('candidate_in', ['person'], ['contest']), ('contest_result', ['person', 'organization', 'option'], ['contest']),
        ('donated_to', ['person', 'organization', 'party'], ['person', 'organization', 'contest']), ('contest_for_office', ['contest'], ['office']),
        ('contest_in_jurisdiction', ['contest'], ['jurisdiction']), ('event_kind', ['event'], []), ('participated_in', ['person', 'organization'], ['event']),
        ('event_in_jurisdiction', ['event'], ['jurisdiction']), ('event_occurrence', ['event'], [])),
    j AS (SELECT c.*, a.kind AS sk, b.kind AS ok, ss, oo FROM c LEFT JOIN kinds a ON a.id = subject_id LEFT JOIN kinds b ON b.id = object_id LEFT JOIN spec ON p = predicate)
    SELECT id, nullif(concat_ws('; ', CASE WHEN ss IS NULL THEN 'unknown predicate' END,
        CASE WHEN sk IS NULL THEN 'subject ' || subject_id || ' does not exist' WHEN NOT list_contains(ss, sk) THEN 'subject is ' || sk END,
        CASE WHEN object_id IS NULL THEN NULL WHEN ok IS NULL THEN 'object ' || object_id || ' does not exist' WHEN NOT list_contains(oo, ok) THEN 'object is ' || ok END), '')
        AS violation FROM j""")
def ontology_check(g: Graph) -> DataFrame:
    """All claims, and orders as claims of unknown predicates, with ends that do not exist or are of other kinds."""
    m, none = F.col("o_orderkey") % 6, F.lit(None).cast("string")
    odd = g.orders().select(
        F.concat(F.lit("z"), F.col("o_orderkey").cast("string")).alias("id"), F.when(m == 0, "unheard_of").otherwise("candidate_in").alias("predicate"),
        F.when(m == 1, "nobody").when(m == 2, "n1").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("subject_id"),
        F.when(m == 3, "nothing").when(m == 4, "s1").when(m == 5, none).otherwise(F.col("contest_id")).alias("object_id")
    )
    every = g.claim().select("id", "predicate", "subject_id", "object_id").unionByName(odd)
    return I.ontology(every, g.entity(), catalog.predicates(g.spark))


_SHAPES = (
    "unknown predicate", "a value claim has an object", "no object", "an entity claim has a value", "no value", "a timeless claim has a time", "no time",
    "a point and an interval", "ends before it begins", "valid_at has no precision", "a precision without valid_to", "valid_from has an unknown precision"
)


@query("SELECT o_orderkey::VARCHAR AS id, [" + ", ".join(f"'{x}'" for x in _SHAPES) + f"][1 + o_orderkey % {len(_SHAPES) + 1}] AS error FROM orders WHERE o_orderkey % {len(_SHAPES) + 1} < {len(_SHAPES)}")
def claim_shape_errors(g: Graph) -> DataFrame:
    """Orders as claims of which each breaks one rule of its predicate's contract, and every thirteenth none."""
    m, at = F.col("o_orderkey") % (len(_SHAPES) + 1), F.col("o_orderdate")
    none, never, day = F.lit(None).cast("string"), F.lit(None).cast(g.raw("orders").schema["o_orderdate"].dataType), F.lit("day")
    slug = F.when(m == 0, "unheard_of").when(m == 1, "event_kind").when(m == 4, "endorsed").when(m == 5, "event_kind").when(
        m == 6, "event_occurrence"
    ).otherwise("candidate_in")
    value = F.when(m.isin(1, 3, 5, 6), "{}")
    held = {
        "valid_at": F.when(m.isin(5, 7, 9), at), "valid_from": F.when(m.isin(7, 8, 11, 12), at), "valid_to": F.when(m == 8, at),
        "valid_at_precision": F.when(m.isin(5, 7), day), "valid_from_precision": F.when(m.isin(7, 8, 12), day).when(m == 11, "week"),
        "valid_to_precision": F.when(m.isin(8, 10), day)
    }
    rows = g.raw("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), slug.alias("predicate"), F.lit("a").alias("subject_id"),
        F.when(~m.isin(2, 5, 6), "b").otherwise(none).alias("object_id"), value.alias("value"),
        *(F.coalesce(c, never if "precision" not in n else none).alias(n) for n, c in held.items())
    )
    return I.shape_errors(rows, catalog.predicates(g.spark))


@query("SELECT o_orderkey, o_orderdate::DATE AS started, o_orderdate::DATE + 5 AS ended FROM orders")
def fieldwork_parsing(g: Graph) -> DataFrame:
    """ranges printed from order dates, within and across months and years, read back."""
    a, b = F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 5)
    month = lambda d: F.date_format(d, "MMMM d")
    printed = F.when(
        (F.month(a) == F.month(b)), F.concat(month(a), F.lit("–"), F.date_format(b, "d, yyyy"))
    ).otherwise(F.concat(month(a), F.lit(" – "), month(b), F.date_format(b, ", yyyy")))
    return g.raw("orders").select("o_orderkey", parse.fieldwork(printed).alias("f")).select("o_orderkey", "f.started", "f.ended")


@query("""SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS size, CASE l_returnflag WHEN 'A' THEN 'a'
    WHEN 'R' THEN 'unknown' END AS population, l_returnflag = 'N' AS refused, CASE
    WHEN l_linestatus = 'O' THEN round(l_discount * 100)::INTEGER END AS percentage FROM lineitem WHERE l_returnflag <> 'N'
    UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, true, CASE WHEN l_linestatus = 'O' THEN round(l_discount * 100)::INTEGER END FROM lineitem
    WHERE l_returnflag = 'N'""")
def cell_parsing(g: Graph) -> DataFrame:
    """Sample and percentage cells printed from lines; rough samples and "<n%" are refused, not zero."""
    n = F.col("l_quantity").cast("int").cast("string")
    cell = F.when(F.col("l_returnflag") == "A", F.concat(n, F.lit(" (A)"))).when(F.col("l_returnflag") == "R", n).otherwise(F.concat(F.lit("~"), n))
    share = F.concat(
        F.when(F.col("l_linestatus") == "O", "").otherwise("<"), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")
    )
    return g.raw("lineitem").select("l_orderkey", "l_linenumber", parse.sample(cell).alias("s"), parse.percentage(share).alias("p")).select(
        "l_orderkey", "l_linenumber", "s.size", "s.population", "s.refused", F.col("p.value").cast("int").alias("percentage")
    )


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(regexp_replace(p_retailprice::DECIMAL(18,4)::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS price FROM part")
def slugs_and_decimals(g: Graph) -> DataFrame:
    """F2, F4."""
    return g.raw("part").select(
        "p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"),
        canon.decimal(F.col("p_retailprice").cast("decimal(18,4)")).alias("price")
    )


@query("""SELECT 'k' || o_orderkey AS id, 'ocd-division/country:us/debate/' || strftime(o_orderdate, '%Y-%m-%d') || '/host-' || o_custkey AS event_key, 'host-' || o_custkey AS host, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'c/p-' || o_custkey || '/' || strftime(o_orderdate, '%Y-%m-%d') END AS poll_key FROM orders""")
def derived_keys(g: Graph) -> DataFrame:
    """Event and poll keys built and parsed."""
    host = F.concat(F.lit("host-"), F.col("o_custkey").cast("string"))
    key = keys.event_key(F.lit("ocd-division/country:us"), F.lit("debate"), F.col("o_orderdate"), F.lit("day"), host)
    poll = keys.poll_key(
        F.lit("c"), F.concat(F.lit("p-"), F.col("o_custkey").cast("string")), F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    )
    return g.raw("orders").select(
        F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("id"), key.alias("event_key"), keys.event_parts(key)["host"].alias("host"),
        poll.alias("poll_key")
    )


@query("SELECT l_orderkey || '-' || l_linenumber AS record_id, 'donated_to' AS predicate, 's' || l_suppkey AS subject_id, 'p' || l_partkey AS object_id, '{\"amount\":\"' || l_quantity::INTEGER || '\",\"currency\":\"USD\",\"kind\":\"contribution\",\"purpose\":null,\"supporting\":' || (l_tax > 0.04)::VARCHAR || '}' AS value, l_shipdate AS valid_at FROM lineitem")
def ingest_donations(g: Graph) -> DataFrame:
    """Lines as donation records, fanned out to claims."""
    records = g.raw("lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("record_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("donor_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("recipient_id"), F.format_string("%.2f", "l_quantity").alias("amount"),
        F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("kind"), (F.col("l_tax") > 0.04).alias("supporting"),
        F.lit(None).cast("string").alias("purpose"), F.col("l_shipdate").cast("timestamp").alias("given")
    )
    return I.donations(records).select(
        "record_id", "predicate", "subject_id", "object_id", "value", F.col("valid_at").cast("timestamp_ntz").alias("valid_at")
    )


@query("SELECT contest_id AS record_id, predicate, contest_id AS subject_id, CASE predicate WHEN 'contest_in_jurisdiction' THEN nation_id WHEN 'contest_for_office' THEN office_id END AS object_id, CASE predicate WHEN 'contest_stage' THEN '{\"stage\":\"general\"}' END AS value FROM g_contests, (VALUES ('contest_stage'), ('contest_in_jurisdiction'), ('contest_for_office')) AS t(predicate)")
def ingest_race_structures(g: Graph) -> DataFrame:
    """I2."""
    none = F.lit(None).cast("string")
    records = g.contests().select(
        F.col("contest_id").alias("record_id"), "contest_id", F.lit("general").alias("stage"), F.col("nation_id").alias("jurisdiction_id"),
        "office_id", none.alias("election_id"), none.alias("party_id"), none.alias("next_id")
    )
    return I.race_structures(records).select("record_id", "predicate", "subject_id", "object_id", "value")


@query("""SELECT 'c' || o_custkey AS record_id, 'candidate_in' AS predicate, contest_id AS object_id, count(*) AS stints, min(o_orderdate) AS first
    FROM g_orders GROUP BY 1, 3""")
def ingest_candidacies(g: Graph) -> DataFrame:
    """A record per customer and contest, with a stint per order."""
    stint = F.struct(F.col("o_orderdate").cast("timestamp").alias("entered"), F.lit(None).cast("timestamp").alias("left"))
    records = g.orders().groupBy(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("record_id"), "contest_id"
    ).agg(F.collect_list(stint).alias("stints")).withColumn("candidate_id", F.col("record_id"))
    return I.candidacies(records).groupBy("record_id", "predicate", "object_id").agg(
        F.count("*").alias("stints"), F.min("valid_from").cast("timestamp_ntz").alias("first")
    )


@query("""SELECT 'e' || event_id AS record_id, p AS predicate, CASE p
    WHEN 'participated_in' THEN 'c' || user_id ELSE 'e' || event_id END AS subject_id, CASE p WHEN 'participated_in' THEN 'e' || event_id
    WHEN 'event_in_jurisdiction' THEN 'n' || (user_id % 25) END AS object_id,
    CASE p WHEN 'participated_in' THEN '{"role":"candidate"}' WHEN 'event_kind' THEN '{"kind":"debate"}'
    WHEN 'event_occurrence' THEN '{"status":"occurred"}' END AS value
    FROM events, (VALUES ('participated_in'), ('event_kind'), ('event_occurrence'), ('event_in_jurisdiction')) AS t(p)""")
def ingest_debates(g: Graph) -> DataFrame:
    """I1."""
    ident = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    who = F.array(F.struct(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("id"), F.lit("candidate").alias("role")))
    records = g.raw("events").select(
        ident.alias("record_id"), ident.alias("event_id"), F.lit("occurred").alias("status"), F.col("ts").cast("timestamp").alias("starts"),
        F.lit(None).cast("timestamp").alias("ends"), who.alias("participants"), F.lit(None).cast("string").alias("contest_id"),
        F.concat(F.lit("n"), (F.col("user_id") % 25).cast("string")).alias("jurisdiction_id")
    )
    return I.debates(records).select("record_id", "predicate", "subject_id", "object_id", "value")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), w AS (
        SELECT k, 's' || CASE k % 10 WHEN 0 THEN k + 2 WHEN 1 THEN k + 3 WHEN 2 THEN k + 3 WHEN 3 THEN k - 1 WHEN 4 THEN k + 1 WHEN 5 THEN k - 1 WHEN 6 THEN k + 1
            WHEN 7 THEN k + 1 ELSE k END AS c, 1 AS j FROM s WHERE k % 10 <> 8 UNION ALL SELECT k, 'nobody', 1 FROM s WHERE k % 10 = 8
        UNION ALL SELECT k, 's' || (k + 2), 2 FROM s WHERE k % 10 = 6 UNION ALL SELECT k, 's' || (k + 1), 2 FROM s WHERE k % 10 = 5),
    j AS (SELECT *, CASE WHEN k % 10 = 7 THEN 'no reason' WHEN c NOT IN (SELECT 's' || k FROM s) THEN 'no such entity' WHEN c = 's' || k THEN 'merged into itself'
        WHEN k % 10 IN (1, 2) THEN 'is merged already' WHEN k % 10 = 0 THEN 'would make a cycle' WHEN k % 10 = 5 AND j = 1 THEN 'would make a cycle'
        WHEN k % 10 = 6 AND j = 2 THEN 'is merged already' END AS why FROM w)
    SELECT 's' || k AS duplicate_id, CASE WHEN why IS NOT NULL THEN c WHEN k % 10 = 3 THEN 's' || (k - 3) ELSE 's' || (k - k % 10 + 7) END AS canonical_id, why
    FROM j""")
def merge_guard(g: Graph) -> DataFrame:
    """Merges wanted for every supplier, judged together: rings that the batch itself would close, two merges of one
    entity, refused ones that forestall nothing, and whatever a merge is refused for by itself; the rest leads straight to its end."""
    s = g.raw("supplier").select(F.col("s_suppkey").alias("k"))
    want = lambda rows, step: rows.select("k", F.concat(F.lit("s"), (F.col("k") + step).cast("string")).alias("c"))
    of = lambda r: s.where(F.col("k") % 10 == r)
    made = want(of(0), 2)
    for r, step in ((1, 3), (2, 3), (3, -1), (4, 1), (5, -1), (5, 1), (6, 1), (6, 2), (7, 1), (9, 0)):
        made = made.unionByName(want(of(r), step))
    made = made.unionByName(of(8).select("k", F.lit("nobody").alias("c")))
    wanted = made.select(
        F.concat(F.lit("s"), F.col("k").cast("string")).alias("duplicate_id"), F.col("c").alias("canonical_id"),
        F.when(F.col("k") % 10 == 7, " ").otherwise("the same").alias("reason")
    )
    done, refused = V.merges(g.redirect(), wanted, g.entity())
    return done.withColumn("why", F.lit(None).cast("string")).unionByName(refused)


@query("""WITH e AS (SELECT event_id AS k, event_id % 12 AS m, event_id // 12 AS p, event_type NOT IN ('purchase', 'error') AS open FROM events),
    first AS (SELECT p, min(k) AS k FROM e WHERE m IN (6, 7) AND open GROUP BY 1),
    w AS (SELECT k, CASE m WHEN 0 THEN 'no token' WHEN 1 THEN 'unknown outcome' WHEN 2 THEN 'no reviewer' WHEN 4 THEN 'no reason' WHEN 10 THEN 'no such task' END AS why, m, p, open
        FROM e UNION ALL SELECT k, NULL, m + 100, p, open FROM e WHERE m IN (4, 5)),
    j AS (SELECT m, CASE WHEN why IS NOT NULL THEN why WHEN NOT open THEN 'task is closed' WHEN m = 3 THEN 'token was used'
        WHEN m = 8 THEN 'say why the candidates are other things' WHEN m = 105 THEN 'task has another decision'
        WHEN m IN (6, 7) AND k <> first.k THEN 'token stands twice' END AS why FROM w LEFT JOIN first USING (p))
    SELECT why, count(*) AS tasks FROM j GROUP BY why""".replace("SELECT m, CASE WHEN why", "SELECT w.m, CASE WHEN why").replace("AND k <> first.k", "AND w.k <> first.k"))
def decision_guard(g: Graph) -> DataFrame:
    """V3, V9: decisions wanted for every task: malformed ones, unknown and closed tasks, used tokens, a token on two tasks,
    two decisions on one, a bad one before a good one, and acceptance without a word where there are candidates."""
    e = g.raw("events").select("event_id", (F.col("event_id") % 12).alias("m"), F.col("event_id").cast("string").alias("k"))
    own, m = F.concat(F.lit("a"), F.col("k")), F.col("m")
    token = F.when(m == 0, F.lit(None)).when(m == 3, "used").when(m.isin(6, 7), F.concat(F.lit("p"), F.floor(F.col("event_id") / 12).cast("string"))).otherwise(own)
    main = e.select(
        F.concat(F.when(m == 10, "z").otherwise("q"), "k").alias("task_id"),
        F.when(m == 1, "banana").when(m.isin(8, 9), "accepted").otherwise("rejected").alias("outcome"), F.when(m == 2, " ").otherwise("ann").alias("reviewer"),
        token.alias("token"), F.when(~m.isin(4, 8, 9), "seen").alias("reason")
    )
    more = e.where("m in (4, 5)").select(
        F.concat(F.lit("q"), F.col("k")).alias("task_id"), F.lit("rejected").alias("outcome"), F.lit("bob").alias("reviewer"),
        F.concat(F.lit("b"), F.col("k")).alias("token"), F.lit("seen too").alias("reason")
    )
    offers = e.where("m in (8, 11)").select(F.concat(F.lit("q"), F.col("k")).alias("task_id"))
    stored = g.decision().withColumn("token", F.when(F.col("seq") == F.lit(1), "used").otherwise(F.concat(F.lit("old"), F.col("seq").cast("string"))))
    stored = stored.unionByName(stored.limit(1).withColumn("token", F.lit("used")))
    appended, refused = V.decide(g.task(), stored, main.unionByName(more), offers)
    return appended.select(F.lit(None).cast("string").alias("why")).unionByName(refused.select("why")).groupBy("why").agg(F.count("*").alias("tasks"))


@query("""SELECT b.revision_id, count(*) AS accepted_n FROM g_revision a JOIN (SELECT target, arg_max(outcome, seq) AS o FROM g_decision
    GROUP BY target) v ON v.target = a.review_key AND v.o = 'accepted'
    JOIN g_revision b ON b.pollster_id = a.pollster_id AND b.contest_id = a.contest_id AND b.revision_id <> a.revision_id
    WHERE b.review_key NOT IN (SELECT target FROM g_task WHERE status IN ('pending', 'claimed') AND priority < 20) GROUP BY 1""")
def rival_revisions(g: Graph) -> DataFrame:
    """Other revisions of the polls of which one is accepted now, but those that an urgent open task holds."""
    accepted = P.latest_verdicts(g.decision()).where("outcome = 'accepted'").select(F.col("target").alias("review_key"))
    revisions = g.revisions().withColumn("poll_id", F.concat_ws("|", "pollster_id", "contest_id"))
    done = revisions.join(accepted, "review_key", "left_semi").select("revision_id")
    urgent = g.task().where("priority < 20").select("status", F.col("target").alias("review_key")).distinct()
    held = urgent.join(revisions.select("review_key", F.col("revision_id").alias("target")), "review_key").select("status", "target")
    return V.rivals(revisions, held, done).groupBy("revision_id").agg(F.count("*").alias("accepted_n"))


@query("""SELECT region.r_name, n_name, count(*) AS candidacies, count(DISTINCT subject_id) AS people FROM g_candidacy
    JOIN g_contests ON contest_id = object_id JOIN nation ON nation_id = 'n' || n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def candidacies_by_region(g: Graph) -> DataFrame:
    """A roll-up over three joins."""
    places = g.raw("nation").join(g.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("nation_id"), "n_name", "r_name"
    )
    c = g.candidacies().join(g.contests().select(F.col("contest_id").alias("object_id"), "nation_id"), "object_id").join(places, "nation_id")
    return c.groupBy("r_name", "n_name").agg(F.count("*").alias("candidacies"), F.count_distinct("subject_id").alias("people"))


from claimweave.plans import cell_queries, record_queries  # noqa: E402, F401  (they register theirs)
