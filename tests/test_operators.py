import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimweave.operators import claims as C, contests as K, geocode, ingest as I, integrity as G, polls as P, resolve as R, review as V, search as S, validate as X
from claimweave.plans import catalog

CLAIM = "id string, predicate string, subject_id string, object_id string, value string, valid_at timestamp, valid_from timestamp, valid_to timestamp, created_at timestamp"


def day(text):
    return dt.datetime.fromisoformat(text) if text else None


def claims(spark, *rows):
    return spark.createDataFrame([(i, p, s, o, v, day(at), day(a), day(b), day(c)) for i, p, s, o, v, at, a, b, c in rows], CLAIM)


def test_half_open_and_reentry(spark):
    c = claims(spark, ("1", "candidate_in", "returner", "k", None, None, "2026-01-01", "2026-07-08", None), ("2", "candidate_in", "returner", "k", None, None, "2026-07-18", None, None), ("3", "candidate_in", "steady", "k", None, None, "2026-01-01", None, None), ("4", "candidate_in", "endless", "k", None, None, None, "2027-01-01", None), ("5", "candidate_in", "timeless", "k", None, None, None, None, None))
    assert K.candidates_in(c).count() == 5
    for at, who in (("2026-05-01", {"returner", "steady"}), ("2026-07-08", {"steady"}), ("2026-07-10", {"steady"}), ("2026-08-01", {"returner", "steady"})):
        assert {r["candidate_id"] for r in K.candidates_in(c, at=F.lit(at).cast("timestamp")).collect()} == who


def test_results_keep_unsaid_wins(spark):
    c = claims(spark, *(("r" + s, "contest_result", s, k, v, None, None, None, None) for s, k, v in (("a", "k", '{"votes":311495,"won":false}'), ("b", "k", '{"votes":315278,"share":"39.81","won":true}'), ("c", "k", '{"votes":null,"won":null}'), ("d", "j", '{"votes":5}'), ("e", "j", '{"votes":7,"extra":1}'))), ("o", "contest_for_office", "k", "o", None, None, None, None, None))
    got = {r["candidate_id"]: r for r in K.results(c).collect()}
    assert [got[x]["rank"] for x in "bac"] == [1, 2, 3] and str(got["b"]["share"]) == "39.810" and got["d"]["won"] is None
    assert got["e"]["votes"] is None  # an unknown key voids the payload
    assert [r["candidate_id"] for r in K.winners_by_office(c).collect()] == ["b"]


def test_redirects(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "duplicate_id string, canonical_id string")
    got = {x["id"]: (x["survivor_id"], x["depth"]) for x in G.survivors(r).collect()}
    assert got == {"a": ("c", 2), "b": ("c", 1), "x": (None, None), "y": (None, None), "z": (None, None)}
    assert {tuple(x) for x in G.chains(r).collect()} >= {("a", "b")}
    bad = {"redirect": G.edges(r, "duplicate_id", "canonical_id")}
    assert {x["id"] for x in G.check(bad).collect()} == {"x", "y"}  # z only leads there
    with pytest.raises(ValueError):
        G.assert_sound(bad)
    long = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)], r.schema)
    got = {x["id"]: x["survivor_id"] for x in G.survivors(long).collect()}
    assert got["n04"] == "n20" and got["n03"] is None
    ids = spark.createDataFrame([("a",), ("q",), ("x",)], "id string")
    assert {x["id"]: x["survivor_id"] for x in G.resolve(ids, r).collect()} == {"a": "c", "q": "q", "x": None}


def test_verdicts(spark):
    d = spark.createDataFrame([(1, 7, "rejected"), (2, 7, "accepted"), (3, 8, "rejected"), (4, 9, "changes_requested")], "seq long, target long, outcome string")
    assert {r["target"]: r["outcome"] for r in P.latest_verdicts(d).collect()} == {7: "accepted", 8: "rejected", 9: "changes_requested"}
    t = spark.createDataFrame([("p", "pending"), ("c", "cancelled")], "id string, status string")
    assert V.backlog(t, d).first().asDict() == {"pending": 1, "claimed": 0, "completed": 0, "decisions": 3, "accepted": 1, "rejected": 1}
    revisions = spark.createDataFrame([("r1", "s", "k", 7), ("r2", "s", "k", 8)], "revision_id string, pollster_id string, contest_id string, review_key long").withColumns({"started": F.lit(None).cast("date"), "ended": F.lit(None).cast("date")})
    readings = spark.createDataFrame([("r1", "lv", "x", 10), ("r2", "lv", "x", 20)], "revision_id string, population string, option_id string, response_count long").withColumn("margin", F.lit(None).cast("decimal(6,3)"))
    merged = spark.createDataFrame([("s", "t")], "id string, survivor_id string")
    assert [r["pollster"] for r in P.timeline(revisions, readings, d, merged).collect()] == ["t"]
    assert P.timeline(revisions, readings, d, merged, include_rejected=True).count() == 2


def test_search_prefers_the_claimed(spark):
    e = spark.createDataFrame([("1", "person", "David Crowley"), ("2", "jurisdiction", "Crowley city"), ("3", "organization", "UC Berkeley"), ("4", "organization", "UC Berkeley IGS")], "id string, kind string, canonical_name string")
    a = e.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"), F.lower("canonical_name").alias("normalized_name"))
    c = claims(spark, ("1", "candidate_in", "1", "k", None, None, None, None, None))
    merged = spark.createDataFrame([("3", "4")], "id string, survivor_id string")
    ask = lambda q: S.search(a, e, c, merged, spark.createDataFrame([(q,)], "query string")).orderBy("rank").collect()
    assert [r["entity_id"] for r in ask("crowley")] == ["1", "2"]
    hit = ask("uc berkeley")
    assert [(r["entity_id"], r["matched_alias"], r["canonical_name"]) for r in hit] == [("4", "UC Berkeley", "UC Berkeley IGS")]
    few = S.search(a, e, c, merged, spark.createDataFrame([("crowley",)], "query string"), candidates=1).collect()
    assert [r["entity_id"] for r in few] == ["2"]  # the best names are looked at before claims count
    page = S.find_entities(e, a, "crowley", limit=1).collect()
    assert len(page) == 1 and page[0]["truncated"]
    assert not S.find_entities(e, a, "crowley", limit=2).first()["truncated"]
    like = S.lookalikes(a, e, spark.createDataFrame([("UC Berkeley IGS",)], "query string"), "organization").collect()
    assert like[0]["entity_id"] == "4"


def test_resolution(spark):
    e = spark.createDataFrame([("e1", "person", "Ann"), ("e2", "person", "Bob"), ("e3", "person", "Bob"), ("e4", "other", "Cy")], "id string, kind string, canonical_name string")
    a = e.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"), F.lower("canonical_name").alias("normalized_name"))
    i = spark.createDataFrame([("wikidata", "Q1", "e1"), ("contest-key", "k1", "e4")], "namespace string, value string, entity_id string")
    none = spark.createDataFrame([], "id string, survivor_id string")
    ids = "array<struct<namespace:string,value:string>>"
    m = spark.createDataFrame([("m1", "person", "Annie", "annie", [("wikidata", "Q1")]), ("m2", "person", "Ann", "ann", [("wikidata", "Q9")]), ("m3", "person", "Ann", "ann", []), ("m4", "person", "Bob", "bob", []), ("m5", "person", "Cy", "cy", []), ("m6", "contest", "Cy", "cy", [("contest-key", "k2")]), ("m7", "person", "Dee", "dee", []), ("m8", "person", "Dee", "dee", [])], f"mention_id string, kind string, name string, normalized_name string, identifiers {ids}")
    m = m.withColumn("authoritative", F.col("mention_id") == "m6")
    got = {r["mention_id"]: (r["entity_id"], r["method"]) for r in R.resolve(m, e, a, i, none).collect()}
    assert got["m1"] == ("e1", "identifier") and got["m3"] == ("e1", "alias") and got["m5"] == ("e4", "alias")
    assert got["m2"][1] == "created"  # the name fits, but the key contradicts
    assert got["m4"][1] == "created"  # two namesakes
    assert got["m6"][1] == "created"  # a computed key that misses is a new thing
    assert got["m7"] == got["m8"] and got["m7"][1] == "created"
    resolved = R.resolve(m, e, a, i, none)
    names, fresh, owned = R.recorded(resolved, m, a, i, none)
    assert ("e1", "Annie") in {(r["entity_id"], r["name"]) for r in names.collect()} and owned.count() == 0 and fresh.count() == 2
    assert R.kind_promotions(resolved, m, e).collect()[0]["new_kind"] == "person"


def test_resolution_keeps_apart_what_it_must(spark):
    e = spark.createDataFrame([("e1", "person", "Bob"), ("e2", "person", "Bob"), ("e3", "person", "Zed"), ("e4", "jurisdiction", "Michigan"), ("e5", "other", "Val"), ("e6", "person", "Lost")], "id string, kind string, canonical_name string")
    a = e.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"), F.lower("canonical_name").alias("normalized_name"))
    i = spark.createDataFrame([("wikidata", "Q1", "e1"), ("wikidata", "Q5", "e3")], "namespace string, value string, entity_id string")
    none = spark.createDataFrame([], "id string, survivor_id string")
    ids = "array<struct<namespace:string,value:string>>"
    rows = [("bob", "person", "Bob", "bob", [("wikidata", "Q9")], False), ("zed", "other", "Zed", "zed", [], False), ("adopts", "jurisdiction", "Michigan", "michigan", [("ocd-division", "mi")], False), ("defines", "jurisdiction", "Michigan", "michigan", [("ocd-division", "other")], True), ("refines", "person", "Val", "val", [], False), ("clash", "contest", "Zed", "zed", [(" WikiData ", " Q5 ")], False)]
    m = spark.createDataFrame(rows, f"mention_id string, kind string, name string, normalized_name string, identifiers {ids}, authoritative boolean")
    got = {r["mention_id"]: r for r in R.resolve(m, e, a, i, none).collect()}
    assert got["bob"]["method"] == "created" and got["bob"]["ambiguous_with"] == ["e1", "e2"]  # ambiguous first, whatever the keys
    assert got["zed"]["method"] == "created"  # a mention of unknown kind joins stored kind other only
    assert got["adopts"]["entity_id"] == "e4" and got["defines"]["method"] == "created"
    assert got["refines"]["entity_id"] == "e5"
    assert got["clash"]["entity_id"] is None and "already identifies person e3" in got["clash"]["error"]
    lost = spark.createDataFrame([("e6", None)], "id string, survivor_id string")
    with pytest.raises(Exception, match="cycle or too far"):
        R.resolve(spark.createDataFrame([("l", "person", "Lost", "lost", [], False)], m.schema), e, a, i, lost).collect()


def test_recording_twice_changes_nothing(spark):
    staged = spark.createDataFrame([("k1", "f1"), ("k2", "f1"), ("k3", "f2")], "idempotency_key string, fingerprint string")
    none = spark.createDataFrame([], "idempotency_key string, fingerprint string, seq long")
    first = {r["idempotency_key"]: r["outcome"] for r in I.outcomes(staged, none, none).collect()}
    assert first == {"k1": "created", "k2": "corroborated", "k3": "created"}
    new_claims, new_assertions = I.appended(I.outcomes(staged, none, none), none)
    assert [r["seq"] for r in new_assertions.orderBy("seq").collect()] == [1, 2, 3]
    assert {r["outcome"] for r in I.outcomes(staged, new_claims, new_assertions).collect()} == {"unchanged"}


def test_contracts(spark):
    c = claims(spark, ("ok", "candidate_in", "a", "k", None, None, "2026-01-01", None, None), ("value", "candidate_in", "a", "k", "{}", None, None, None, None), ("none", "candidate_in", "a", None, None, None, None, None, None), ("late", "candidate_in", "a", "k", None, None, "2026-02-01", "2026-01-01", None), ("timed", "event_kind", "a", None, "{}", "2026-01-01", None, None, None), ("undated", "event_occurrence", "a", None, "{}", None, None, None, None), ("odd", "nothing", "a", "k", None, None, None, None, None))
    got = {r["id"]: r["error"] for r in I.shape_errors(c, catalog.predicates(spark)).collect()}
    assert set(got) == {"value", "none", "late", "timed", "undated", "odd"} and got["late"] == "ends before it begins"
    e = spark.createDataFrame([("a", "organization"), ("k", "contest")], "id string, kind string")
    assert {r["id"]: r["violation"] for r in I.ontology(c, e, catalog.predicates(spark)).collect()}["ok"] == "subject is organization"


def test_fan_out(spark):
    s = "array<struct<entered:timestamp,left:timestamp>>"
    records = spark.createDataFrame([("r", "c", "k", [(day("2026-01-01"), day("2026-02-01")), (day("2026-01-15"), None)]), ("q", "c", "k", None)], f"record_id string, candidate_id string, contest_id string, stints {s}")
    assert I.candidacies(records).count() == 3
    assert [r["record_id"] for r in I.overlapping_stints(records).collect()] == ["r"]
    debates = spark.createDataFrame([("r", "e", "occurred", None, None, [("c", "candidate"), ("d", "moderator")], "k", None)], "record_id string, event_id string, status string, starts timestamp, ends timestamp, participants array<struct<id:string,role:string>>, contest_id string, jurisdiction_id string")
    assert sorted(r["predicate"] for r in I.debates(debates).collect()) == ["event_about_contest", "event_kind", "event_occurrence", "participated_in", "participated_in"]
    with pytest.raises(KeyError):
        I.ingestor("unknown")
    polls = spark.createDataFrame([("r", [("lv", 400, [("A", "41"), ("B", "39")])])], "revision_id string, samples array<struct<population:string,sample_size:int,readings:array<struct<label:string,percentage:string>>>>")
    assert [(r["label"], r["option"]) for r in I.written_readings(polls).orderBy("position").collect()] == [("overall", "A"), ("overall", "B")]


def test_near_duplicates_and_concerns(spark):
    rows = [("a", "k", "s", dt.date(2026, 7, 1)), ("b", "k", "s", dt.date(2026, 7, 4)), ("c", "k", "s", dt.date(2026, 7, 8)), ("d", "k", "t", dt.date(2026, 7, 1)), ("e", "k", "t", None)]
    r = spark.createDataFrame(rows, "revision_id string, contest_id string, pollster_id string, ended date")
    near = I.near_duplicates(r)
    assert {(x["a"], x["b"]) for x in near.collect()} == {("a", "b")}
    like = spark.createDataFrame([("t",)], "pollster_id string")
    stored = spark.createDataFrame([("pb",)], "poll_id string")
    told = I.concerns(r.withColumn("poll_id", F.concat(F.lit("p"), "revision_id")), near, like, stored)
    assert {tuple(x) for x in told.collect()} == {("b", "another reading of this poll exists"), ("e", "no end of fieldwork"), ("a", "near duplicate"), ("b", "near duplicate"), ("d", "lookalike pollster"), ("e", "lookalike pollster")}


def test_decisions_and_merges(spark):
    t = spark.createDataFrame([("q1", 1, "pending"), ("q2", 2, "completed")], "id string, target long, status string")
    d = spark.createDataFrame([(5, "old")], "seq long, token string")
    w = spark.createDataFrame([("q1", "accepted", "ann", "t1", None), ("q1", "rejected", "ann", "t2", "no"), ("q2", "accepted", "ann", "t3", None), ("q9", "accepted", "ann", "t4", None), ("q1", "rejected", "ann", "t5", None)], "task_id string, outcome string, reviewer string, token string, reason string")
    done, refused = V.decide(t, d, w)
    assert [(r["seq"], r["token"]) for r in done.collect()] == [(6, "t1")]
    assert {r["token"]: r["why"] for r in refused.collect()} == {"t2": "task has another decision", "t3": "task is closed", "t4": "no such task", "t5": "no reason"}
    assert V.find_task(t, " Q1 ").count() == 1
    for bad in ("q", " ", "z"):
        with pytest.raises(LookupError):
            V.find_task(t, bad)
    assert V.find_task(t, "q1").count() == 1


def test_geocoding(spark):
    def service(lines):
        keys = [x.split(",")[0].strip('"') for x in lines]
        full = '"{}","1 Main","Match","Exact","1 MAIN ST","-89.4,43.1","1","L","55","025","001","1000"'
        return [full.format(k) if k == "a" else f'"{k}","x","Tie"' if k == "b" else f'"{k}","x","Match","Exact","Y","","1","L","55"' for k in keys if k != "d"]

    a = spark.createDataFrame([(k, "1 Main", "Madison", "WI", "5") for k in "abcd"], "key string, street string, city string, state string, postcode string")
    got = {r["key"]: r for r in geocode.geocode(a, service, batch=2).collect()}
    assert {k: r["quality"] for k, r in got.items()} == {"a": "exact", "b": "tie", "c": "no_match", "d": "no_match"}
    assert got["a"]["geoid"] == "550250011000" and geocode.broken(geocode.geocode(a, service)).count() == 0


def test_geocoding_asks_again(spark, tmp_path):
    a = spark.createDataFrame([("a", "1 Main", "Madison", "WI", "5")], "key string, street string, city string, state string, postcode string").coalesce(1)
    log = str(tmp_path / "asked")

    def shaky(lines, fails, error):
        with open(log, "a") as f:
            f.write("x")
        with open(log) as f:
            if len(f.read()) <= fails:
                raise error("busy")
        return ['"a","x","Tie"']

    told = geocode.geocode(a, lambda x: shaky(x, 2, geocode.Unavailable), backoff=0.01).collect()
    assert told[0]["quality"] == "tie" and len(open(log).read()) == 3
    open(log, "w").close()
    with pytest.raises(Exception, match="failed 3 times"):
        geocode.geocode(a, lambda x: shaky(x, 9, TimeoutError), backoff=0.01).collect()
    with pytest.raises(Exception, match="busy"):
        geocode.geocode(a, lambda x: shaky(x, 99, ValueError), backoff=0.01).collect()


def test_validators(spark):
    r = spark.createDataFrame([("1", "running", None, None), ("2", "failed", dt.datetime(2026, 1, 1), None), ("3", "succeeded", dt.datetime(2026, 1, 1), None), ("3", "succeeded", None, None)], "id string, status string, completed_at timestamp, error_message string")
    assert [x["key"] for x in X.broken(r, "state", "id", X.run_state()).collect()] == ["2", "3"]
    assert [x["key"] for x in X.repeated(r, "id", ["id"]).collect()] == ["3"]
    one = spark.createDataFrame([("a", None), ("a", "b"), (None, None)], "x string, y string")
    assert one.where(X.one_of("x", "y")).count() == 1 and one.where(X.paired("x", "y")).count() == 2


def test_poll_writing(spark):
    from claimweave.operators import polling

    polls = spark.createDataFrame([("p", 41, "u1"), ("p", 41, "u2"), ("p", 42, "u1"), ("q", 41, "u1")], "poll_id string, reading int, source_url string")
    none = spark.createDataFrame([], "poll_id string, payload_hash string, revision_number int")
    first = polling.new_revisions(polls, none)
    assert sorted((r["poll_id"], r["revision_number"]) for r in first.collect()) == [("p", 1), ("p", 2), ("q", 1)]
    assert polling.new_revisions(polls, first.select(*none.columns)).count() == 0
    q = spark.createDataFrame([("q1", "r1", "k1", 1), ("q0", "r1", "k0", 0), ("q2", "r2", "k2", 0)], "id string, poll_revision_id string, contest_id string, position int")
    assert {tuple(r) for r in polling.contest_of(q).collect()} == {("r1", "k0"), ("r2", "k2")}
    o = polling.new_options(spark.createDataFrame([("o1", "q1"), ("o2", "q2")], "id string, question_id string"), q)
    s = spark.createDataFrame([("s1", "r1")], "id string, poll_revision_id string")
    fine, refused = polling.new_estimates(spark.createDataFrame([("o1", "s1"), ("o2", "s1")], "option_id string, sample_id string"), o, s)
    assert [r["poll_revision_id"] for r in fine.collect()] == ["r1"] and refused.count() == 1


def test_import_runs_are_idempotent(spark):
    from claimweave.operators import runs

    rows = spark.createDataFrame([("r0", 0, "sn", "c1", "k", None), ("r1", 1, "sn", "c2", "k", "x"), ("r2", 2, "sn", None, "k", None)], "record_id string, index long, snapshot string, candidate_id string, contest_id string, party_id string")
    error = F.when(F.col("candidate_id").isNull(), "no candidate")
    none = spark.createDataFrame([], "idempotency_key string, fingerprint string")
    told, report = runs.run_import(rows, I.federal_candidacies, error, "run", none, none)
    assert report.first().asDict() == {"imported": 2, "failed": 1, "created": 3, "corroborated": 0, "unchanged": 0}
    again, report = runs.run_import(rows, I.federal_candidacies, error, "run", told, told)
    assert report.first().asDict() == {"imported": 2, "failed": 1, "created": 0, "corroborated": 0, "unchanged": 3}
    other, report = runs.run_import(rows, I.federal_candidacies, error, "later", told, told)
    assert report.first()["corroborated"] == 3
    key = runs.run_key("fec", "2026", "0" * 64)
    known = spark.createDataFrame([(key,)], "idempotency_key string")
    assert runs.started(spark, known, key, "import").count() == 0 and runs.started(spark, known.limit(0), key, "import").count() == 1


def test_tables(spark, tmp_path):
    from claimweave.plans.schema import TABLES, Tables

    t = Tables(spark, str(tmp_path))
    t.create()
    assert len(TABLES) == 32 and t.read("claim").count() == 0
    t.append("entity", spark.createDataFrame([("a", "person")], "id string, kind string"))
    t.create()
    assert t.read("entity").first()["canonical_name"] is None
    with pytest.raises(ValueError):
        t.append("entity", spark.createDataFrame([("a",)], "nothing string"))
    with pytest.raises(PermissionError):
        t.replace("claim", t.read("claim"))


def test_reading_verdicts_and_choices(spark):
    t = spark.createDataFrame([("q1", 1, "pending")], "id string, target long, status string")
    d = spark.createDataFrame([(5,)], "seq long")
    w = spark.createDataFrame([(1, "rejected", "a", "t1", "no"), (2, "rejected", "a", "t2", "no"), (3, "accepted", "a", "t3", "")], "target long, outcome string, reviewer string, token string, reason string")
    done, refused = V.decide_readings(t, d, w)
    assert [(r["seq"], r["target"]) for r in done.collect()] == [(6, 2)]
    assert {r["token"]: r["why"] for r in refused.collect()} == {"t1": "has an open task", "t3": "no reason"}
    c = [{"id": "ab1", "name": "Acme"}, {"id": "ab2", "name": "Zeta"}]
    assert V.chosen(c, "2") == c[1] and V.chosen(c, "ab1") == c[0] and V.chosen(c, "zeta") == c[1]
    with pytest.raises(LookupError):
        V.chosen(c, "ab")
    like = spark.createDataFrame([("x", "e1"), ("x", "e2"), ("x", "e3")], "query string, entity_id string")
    merged = spark.createDataFrame([("e1", "e2")], "id string, survivor_id string")
    own = spark.createDataFrame([("x", "e3")], "query string, entity_id string")
    assert [r["entity_id"] for r in V.merge_candidates(like, merged, own).collect()] == ["e2"]


def test_candidates_are_counted_as_the_pairs_are(spark):
    like = spark.createDataFrame([("a", e) for e in ("s1", "s2", "s3", "s3")] + [("b", "s4"), ("c", "s2")], "query string, entity_id string")
    merged = spark.createDataFrame([("s2", "s1")], "id string, survivor_id string")
    own = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "a"), ("s4", "b"), ("s9", "b"), ("s1", "c"), ("s5", "d")], "own string, query string")
    found = {(r["own"], r["candidates"], r["first"]) for r in V.candidate_counts(own, like, merged).collect()}
    assert found == {("s1", 1, "s3"), ("s2", 2, "s1"), ("s3", 1, "s1"), ("s9", 1, "s4")}
