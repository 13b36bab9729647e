"""Steps whose work must not grow faster than their input."""

from pyspark.sql import functions as F

from claimweave.functions import keys
from claimweave.operators import ingest as I, integrity as G, resolve as R, review as V, search as S
from claimweave.plans import catalog, materialize, queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_follow_the_longest_path_not_the_number_of_edges(spark, monkeypatch):
    pairs = [(2 * k, 2 * k + 1) for k in range(3000)]
    edges = pairs + [(b, a) for a, b in pairs] + [(10_000 + k, 10_001 + k) for k in range(9)] + [(10_009, 3), (20_000, 20_001)]
    calls, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda *a: calls.append(1) or cut(*a))
    found = {(r["id"], r["leader"], r["position"], r["next"]) for r in G.rings(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {(a, a, 0, b) for a, b in pairs} | {(b, a, 1, a) for a, b in pairs}
    assert len(calls) <= 12


def test_a_name_is_resolved_once_however_many_mentions_bear_it(spark, monkeypatch):
    entities = spark.createDataFrame([(f"e{k}", "person") for k in range(40)], "id string, kind string")
    aliases = spark.createDataFrame([(f"e{k}", "many") for k in range(39)] + [("e39", "one")], "entity_id string, normalized_name string")
    ids = spark.createDataFrame([("e39", "fec", "F1")], "entity_id string, namespace string, value string")
    merged = spark.createDataFrame([("e1", "e0")], "id string, survivor_id string")
    pair = "array<struct<namespace:string,value:string>>"
    rows = [(f"m{k}", "person", "many", []) for k in range(50)] + [("a", "person", "one", [("fec", "F1")]), ("b", "person", "one", [("fec", "F2")]), ("c", "person", None, [])]
    mentions = spark.createDataFrame(rows, f"mention_id string, kind string, normalized_name string, identifiers {pair}")
    seen = []
    monkeypatch.setattr(R, "followed", lambda rows, *a, f=R.followed: seen.append(rows.count()) or f(rows, *a))
    told = {r["mention_id"]: (r["entity_id"], r["ambiguous_with"]) for r in R.by_alias(mentions, aliases, entities, ids, merged).collect()}
    several = sorted(f"e{k}" for k in range(39) if k != 1)
    assert told == {f"m{k}": (None, several) for k in range(50)} | {"a": ("e39", None), "b": (None, None)}
    assert seen == [40]


def test_no_split_of_the_input_is_sorted_before_it_is_dealt(spark):
    claims = spark.range(10).select(
        F.lit("event_occurrence").alias("predicate"), F.col("id").cast("string").alias("subject_id"), F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_at"), F.lit("o").alias("object_id")
    )
    ids = claims.select(F.col("subject_id").alias("entity_id"), F.lit("n").alias("namespace"), F.lit("v").alias("value"))
    ents = claims.select(F.col("subject_id").alias("id"), F.lit("person").alias("kind"))
    for df in (S.latest_occurrence(claims), S.contexts(ents, ids, claims)):
        for sort in _plan(df).split("Sort [")[1:]:
            assert "Exchange" in sort.split("\n")[1], _plan(df)


def test_claims_without_objects_do_not_meet_in_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        claims = spark.createDataFrame([(str(k), "event_kind", "e", None) for k in range(400)], "id string, predicate string, subject_id string, object_id string")
        kinds = spark.createDataFrame([("e", "event")], "id string, kind string")
        told = I.ontology(claims, kinds, catalog.predicates(spark))
        assert "__object" in _plan(told) and [r["violation"] for r in told.collect()] == [None] * 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_contest_key_is_built_once_and_read_once(spark, tmp_path):
    orders = spark.range(40).select(F.col("id").alias("o_orderkey"), F.lit("1998-02-03").cast("timestamp_ntz").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    plan = _plan(queries.QUERIES["contest_key_rules"](spark, str(tmp_path)))
    assert plan.count("(primary|runoff|general|special|caucus)") == 2 and plan.count("RLIKE(") <= 7, len(plan)
    d = "ocd-division/a/b/2020/primary/2021"
    odd = [f"{d}/general", f"{d}/general\n", f"{d}/special/x\r\n", f"\n{d}/general", "a\nb\n2020\nprimary\n", None, "", f"{d}/general/x", f"{d}/primary/"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in odd], "x string").select(keys.contest_parts(F.col("x"))).collect()]
    head = ("ocd-division/a/b/2020", "primary", 2021)
    assert [tuple(r) for r in got] == [(*head, "general", None), (*head, "general", None), (*head, "special", "x")] + [(None,) * 5] * 6


def _batch(spark):
    pair = "array<struct<namespace:string,value:string>>"
    entities = spark.createDataFrame([(f"e{k}", "person") for k in range(20)], "id string, kind string")
    aliases = spark.createDataFrame([(f"e{k}", f"name {k}", f"name {k}") for k in range(20)], "entity_id string, name string, normalized_name string")
    ids = spark.createDataFrame([(f"e{k}", "fec", f"F{k}") for k in range(20)], "entity_id string, namespace string, value string")
    merged = spark.createDataFrame([("e1", "e0")], "id string, survivor_id string")
    rows = [(f"m{k}", "person", f"name {k}", f"name {k}", [("fec", f"F{k}")] if k % 2 else []) for k in range(30)]
    return spark.createDataFrame(rows, f"mention_id string, kind string, name string, normalized_name string, identifiers {pair}"), entities, aliases, ids, merged


def test_a_large_batch_is_not_sent_to_every_executor(spark, monkeypatch):
    monkeypatch.setattr(materialize, "LARGE", -1, raising=False)
    m, e, a, i, s = _batch(spark)
    told = R.resolve(m, e, a, i, s)
    want = {f"m{k}": "e0" if k == 1 else f"e{k}" for k in range(20)}
    got = {r["mention_id"]: r["entity_id"] for r in told.collect()}
    assert {k: got[k] for k in want} == want and len(set(got.values())) == 29
    names, fresh, owned = R.recorded(told, m, a, i, s)
    assert {r["value"] for r in fresh.collect()} == {f"F{k}" for k in range(21, 30, 2)} and owned.count() == 0
    for df in (told, names, fresh):
        assert "BroadcastHashJoin" not in _plan(df), _plan(df)


def test_the_key_of_a_mention_is_short_and_stays_behind(spark):
    faces, *keyed = R._faces(_batch(spark)[0])
    assert "key" not in faces.columns
    assert {len(r["key"]) for df in keyed[:2] for r in df.collect()} == {16}


def test_records_are_judged_once(spark):
    plan = _plan(queries.QUERIES["import_errors"](spark, "/root/testdata/sf0.001"))
    assert plan.count("lineitem.parquet") == 1 and plan.count("orders.parquet") == 2 and "Join" not in plan, plan
    given = "record_id string, donor_id string, recipient_id string, amount string, currency string, kind string, supporting boolean, purpose string, given timestamp"
    rows = [("a", "d", "r", "-0.10", None, None, None, 'x"]', None), ("b", "d", "r", "1.50", "US", "gift", True, None, None), ("c", "d", "r", "7", None, None, None, None, None), ("d", None, "r", "7", None, None, None, None, None)]
    gifts = spark.createDataFrame(rows, given)
    told = {r["record_id"]: r["error"] for r in I.verdicts(gifts, "donation").collect()}
    wrong = {"a": "donated_to: amount is less than 0", "b": "donated_to: currency is shorter than 3, kind is none of the allowed"}
    assert told == wrong | {"c": None}
    claims, errors = I.judged_records(gifts, "donation")
    assert [r["record_id"] for r in claims.collect()] == ["c"] and {r["record_id"]: r["error"] for r in errors.collect()} == wrong


def test_texts_of_all_revisions_are_not_dealt_with_each_of_them(spark):
    plan = _plan(queries.QUERIES["task_views"](spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in plan[: plan.index("collect_list(")] and plan.count("lineitem.parquet") == 2, plan
    rows = [("r1", "p", 1, "s", "k"), ("r2", "p", 2, "s", "k"), ("r3", "q", 1, "x", None), ("r4", None, 1, "s", "k")]
    revisions = spark.createDataFrame(rows, "revision_id string, poll_id string, revision_number int, pollster_id string, contest_id string").withColumns(
        {"started": F.lit(None).cast("date"), "ended": F.lit(None).cast("date"), "created_by": F.lit(None).cast("string"), "poll_key": F.lit("")}
    )
    tasks = spark.createDataFrame(
        [("a", "r1", "pending"), ("b", "r1", "claimed"), ("c", "r2", "completed"), ("d", "r3", "pending"), ("e", "r4", "pending"), ("f", "none", "pending")],
        "id string, target string, status string"
    )
    readings = spark.createDataFrame([("r2", "Ann 4")], "revision_id string, readings string")
    entities = spark.createDataFrame([("s", "Firm"), ("k", "Race")], "id string, canonical_name string")
    told = {r["id"]: r for r in V.poll_views(tasks, revisions, readings, entities).collect()}
    assert set(told) == {"a", "b", "d"} and told["d"]["headline"] == "(unknown pollster) — unknown contest"
    assert [tuple(x) for x in told["a"]["readings"]] == [(1, True, "(no readings)", "(unattributed)"), (2, False, "Ann 4", "(unattributed)")]
    assert told["a"]["readings"] == told["b"]["readings"] and told["a"]["candidates"] == []
