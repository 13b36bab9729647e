"""Batches are judged together: resolution, decisions and merges whose rows meet each other."""

import itertools

import pytest
from pyspark.sql import functions as F

from claimweave.operators import integrity as G, resolve as R, review as V
from claimweave.operators.components import connected

IDS = "array<struct<namespace:string,value:string>>"
MENTION = f"mention_id string, kind string, name string, normalized_name string, identifiers {IDS}, authoritative boolean"


def world(spark):
    e = spark.createDataFrame([("e1", "person", "Ann"), ("e2", "person", "Bob"), ("e3", "contest", "Race")], "id string, kind string, canonical_name string")
    a = e.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"), F.lower("canonical_name").alias("normalized_name"))
    i = spark.createDataFrame([("wikidata", "Q1", "e1"), ("wikidata", "Q2", "e2"), ("contest-key", "k1", "e3")], "namespace string, value string, entity_id string")
    return e, a, i, spark.createDataFrame([], "id string, survivor_id string")


def mentions(spark, *rows):
    return spark.createDataFrame([(m, kind, name, name.lower(), [tuple(x.split(":")) for x in ids], sure) for m, kind, name, ids, sure in rows], MENTION)


def ask(spark, *rows):
    e, a, i, none = world(spark)
    m = mentions(spark, *rows)
    return {r["mention_id"]: r for r in R.resolve(m, e, a, i, none).collect()}, m, (a, i, none)


def test_components(spark):
    edges = [("b", "a"), ("c", "b"), ("e", "d"), ("x", "x"), *((f"n{k:03}", f"n{k + 1:03}") for k in range(70))]
    got = {r["id"]: r["root"] for r in connected(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert [got[x] for x in "abcdex"] == ["a", "a", "a", "d", "d", "x"] and {got[f"n{k:03}"] for k in range(71)} == {"n000"}
    assert connected(spark.createDataFrame([], "u string, v string")).count() == 0


def test_a_later_identifier_joins_mentions_in_either_order(spark):
    for one, two in (("m1", "m2"), ("m2", "m1")):
        got, m, stored = ask(spark, (one, "person", "Zoe", ["wikidata:Q9", "fec:F9"], False), (two, "person", "Z. Zed", ["fec:F9"], False))
        assert got["m1"]["entity_id"] == got["m2"]["entity_id"] and got["m1"]["method"] == "created"
        names, fresh, owned = R.recorded(R.resolve(m, *world(spark)), m, *stored)
        assert sorted((r["namespace"], r["value"]) for r in fresh.collect()) == [("fec", "F9"), ("wikidata", "Q9")] and owned.count() == 0
        assert {r["name"] for r in names.collect()} == {"Zoe", "Z. Zed"}


def test_chains_and_stored_owners(spark):
    got, *_ = ask(
        spark, ("a", "person", "A", ["x:1"], False), ("b", "person", "B", ["x:1", "y:1"], False), ("c", "person", "C", ["y:1", "z:1"], False),
        ("d", "person", "D", ["z:1"], False), ("p", "person", "P", ["wikidata:Q1", "fec:F1"], False), ("q", "person", "Q", ["fec:F1", "g:1"], False),
        ("r", "person", "R", ["g:1"], False), ("s", "person", "Ann", ["h:1"], False), ("t", "person", "T", ["h:1"], False)
    )
    assert len({got[x]["entity_id"] for x in "abcd"}) == 1 and got["a"]["entity_id"].startswith("x")
    assert {got[x]["entity_id"] for x in "pqr"} == {"e1"} and got["r"]["method"] == "identifier"  # through a key that p brings
    assert (got["s"]["method"], got["t"]["method"]) == ("alias", "identifier") and got["t"]["entity_id"] == "e1"


def test_a_key_that_two_entities_want(spark):
    got, m, stored = ask(spark, ("a", "person", "A", ["wikidata:Q1", "fec:F1"], False), ("b", "person", "B", ["wikidata:Q2", "fec:F1"], False), ("c", "person", "C", ["fec:F1"], False))
    assert [got[x]["entity_id"] for x in "abc"] == ["e1", "e2", "e1"]
    _, fresh, owned = R.recorded(R.resolve(m, *world(spark)), m, *stored)
    assert [tuple(r) for r in fresh.select("entity_id", "value").collect()] == [("e1", "F1")]
    assert [tuple(r) for r in owned.select("entity_id", "value", "owner").collect()] == [("e2", "F1", "e1")]


def test_kinds_that_clash_in_one_batch(spark):
    got, *_ = ask(spark, ("a", "person", "A", ["x:1"], False), ("b", "contest", "B", ["x:1"], False), ("c", "other", "C", ["x:1"], False))
    assert got["b"]["entity_id"] is None and "x:1 already identifies person, not a contest" == got["b"]["error"]
    assert got["a"]["entity_id"] == got["c"]["entity_id"] is not None
    got, *_ = ask(spark, ("a", "person", "A", ["wikidata:Q1", "x:1"], False), ("b", "contest", "B", ["x:1"], False))
    assert got["b"]["entity_id"] is None and got["b"]["error"] == "x:1 already identifies person e1, not a contest"


def test_names_within_a_batch(spark):
    got, *_ = ask(
        spark, ("a", "person", "Zoe", ["fec:F1"], False), ("b", "person", "Zoe", [], False), ("c", "person", "Zoe", ["wikidata:Q7"], False),
        ("d", "person", "Yan", ["fec:F2"], False), ("e", "person", "Yan", ["fec:F3"], False), ("f", "person", "Yan", [], False),
        ("g", "event", "Debate", ["event-key:k1"], True), ("h", "event", "Debate", ["event-key:k2"], True), ("i", "contest", "Zoe", [], False),
        ("j", "event", "Talk", ["event-key:k3"], True), ("k", "event", "Talk", [], False)
    )
    assert got["a"]["entity_id"] == got["b"]["entity_id"] == got["c"]["entity_id"] and got["b"]["method"] == "alias"  # no namespace differs
    assert len({got[x]["entity_id"] for x in "def"}) == 3  # two keys of one namespace are two people
    assert got["f"]["ambiguous_with"] == sorted([got["d"]["entity_id"], got["e"]["entity_id"]])
    assert got["g"]["entity_id"] != got["h"]["entity_id"]  # the key defines them
    assert got["i"]["entity_id"] not in {got["a"]["entity_id"]} and got["j"]["entity_id"] == got["k"]["entity_id"]


def test_other_spellings_are_recorded(spark):
    e, a, i, none = world(spark)
    m = mentions(spark, ("a", "person", "Ann", ["wikidata:Q1"], False)).withColumn("aliases", F.array(F.lit("Annie  X"), F.lit("ANN"), F.lit(" ")))
    names, *_ = R.recorded(R.resolve(m, e, a, i, none), m, a, i, none)
    assert [tuple(r) for r in names.select("entity_id", "normalized_name", "name").collect()] == [("e1", "annie x", "Annie  X")]


def test_unknown_pollsters(spark):
    e = spark.createDataFrame([("o1", "organization", "EPIC-MRA"), ("o2", "organization", "Emerson College"), ("p1", "person", "Quinn")], "id string, kind string, canonical_name string")
    a = e.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"), F.lower("canonical_name").alias("normalized_name"))
    i = spark.createDataFrame([], "namespace string, value string, entity_id string")
    none = spark.createDataFrame([], "id string, survivor_id string")
    names = spark.createDataFrame([("Epic MRA",), ("Emerson Colleges",), ("Emerson-Colleges",), ("Quinn",)], "name string")
    told, spelt = R.resolved_pollsters(names, e, a, i, none)
    got = {r["name"]: r for r in told.collect()}
    assert got["Epic MRA"]["entity_id"] == "o1" and not got["Epic MRA"]["created"]
    assert got["Emerson Colleges"]["created"] and got["Emerson Colleges"]["entity_id"] == got["Emerson-Colleges"]["entity_id"]
    assert got["Emerson Colleges"]["lookalikes"] == ["o2"] and got["Quinn"]["entity_id"] != "p1" and got["Quinn"]["created"]
    assert {r["normalized_name"] for r in spelt.collect()} == {"epic mra", "emerson colleges", "emerson-colleges", "quinn"}


def in_rounds(redirects, wanted):
    """Each entity's first merge that was not refused is tried; of those on a ring the last is refused."""
    stored, stands, refused, left = dict(redirects), {}, [], sorted(set(wanted))
    refused += [w for w in left if w[0] == w[1] or w[0] in stored]
    left = [w for w in left if w not in refused]
    while left:
        now = {a: b for a, b in reversed(left)}
        to = stored | stands | now
        closing = set()
        for a in now:
            ring, x = [a], to.get(a)
            while x is not None and x not in ring:
                ring.append(x)
                x = to.get(x)
            if x == a:
                closing.add(max(y for y in ring if y in now))
        stands |= {a: b for a, b in now.items() if a not in closing}
        refused += [(a, now[a]) for a in closing] + [w for w in left if w[0] in stands and w != (w[0], stands[w[0]])]
        left = [w for w in left if w[0] not in stands and w not in refused]
    to = stored | stands
    end = lambda x: end(to[x]) if x in to else x
    return sorted((a, end(a)) for a in stands), sorted(refused)


def merged(spark, redirects, wanted):
    ddl = "duplicate_id string, canonical_id string"
    done, refused = V.merges(spark.createDataFrame(redirects, ddl), spark.createDataFrame(wanted, ddl))
    return sorted(map(tuple, done.collect())), sorted((r[0], r[1]) for r in refused.collect())


@pytest.mark.parametrize(
    "redirects,wanted",
    [
        ([], [("a", "b"), ("b", "a"), ("c", "d"), ("c", "e")]),
        ([("s", "t")], [("t", "u"), ("u", "s"), ("u", "v"), ("s", "w"), ("v", "v"), ("w", "s")]),
        ([], [(x, y) for x, y in itertools.permutations("abcd", 2)]),
        ([], [(f"n{k:02}", f"n{k + 1:02}") for k in range(40)] + [("n40", "n00"), ("n40", "z")]),
    ],
)
def test_merges_of_a_batch(spark, redirects, wanted):
    assert merged(spark, redirects, wanted) == in_rounds(redirects, wanted)


def test_merges_say_why_they_are_refused(spark):
    e = spark.createDataFrame([(x,) for x in "abc"], "id string")
    w = spark.createDataFrame([("a", "b", " "), ("b", "c", None), ("c", "x", "same"), ("x", "a", "same"), ("a", "a", "same"), ("a", "c", "same")], "duplicate_id string, canonical_id string, reason string")
    done, refused = V.merges(spark.createDataFrame([], "duplicate_id string, canonical_id string"), w, e)
    assert [tuple(r) for r in done.collect()] == [("a", "c")]
    assert {(r[0], r[1]): r["why"] for r in refused.collect()} == {
        ("a", "b"): "no reason", ("b", "c"): "no reason", ("c", "x"): "no such entity", ("x", "a"): "no such entity", ("a", "a"): "merged into itself"
    }


def test_decisions_of_a_batch(spark):
    t = spark.createDataFrame([(f"q{k}", k, "pending") for k in range(9)], "id string, target long, status string")
    d = spark.createDataFrame([(5, "old")], "seq long, token string")
    rows = [
        ("q1", "accepted", "ann", None, None), ("q2", "banana", "ann", "t2", "x"), ("q3", "accepted", " ", "t3", None), ("q4", "rejected", "ann", "t4", "no"),
        ("q5", "rejected", "ann", "t4", "no"), ("q6", "rejected", "ann", "a6", ""), ("q6", "rejected", "ann", "b6", "good"), ("q7", "accepted", "ann", "old", None),
        ("q8", "accepted", "ann", "t8", None), ("q0", None, "ann", "t0", "x"), ("q4", "rejected", "ann", "t4", "no")
    ]
    w = spark.createDataFrame(rows, "task_id string, outcome string, reviewer string, token string, reason string")
    offers = spark.createDataFrame([("q8",)], "task_id string")
    done, refused = V.decide(t, d, w, offers)
    assert sorted((r["token"], r["task_id"], r["seq"]) for r in done.collect()) == [("b6", "q6", done.where("token = 'b6'").first()["seq"]), ("t4", "q4", done.where("token = 't4'").first()["seq"])]
    assert {r["seq"] for r in done.collect()} == {6, 7}
    assert {r["task_id"] + (r["token"] or ""): r["why"] for r in refused.collect()} == {
        "q1": "no token", "q2t2": "unknown outcome", "q3t3": "no reviewer", "q5t4": "token stands twice", "q6a6": "no reason", "q7old": "token was used",
        "q8t8": "say why the candidates are other things", "q0t0": "unknown outcome"
    }


def test_a_refused_decision_forestalls_none(spark):
    t = spark.createDataFrame([(f"q{k}", k, "pending") for k in range(4)], "id string, target long, status string")
    d = spark.createDataFrame([], "seq long, token string")
    rows = [("q0", "a"), ("q0", "b"), ("q1", "b"), ("q1", "c"), ("q2", "c"), ("q2", "d"), ("q3", "d")]
    w = spark.createDataFrame([(q, "accepted", "ann", k, None) for q, k in rows], "task_id string, outcome string, reviewer string, token string, reason string")
    done, _ = V.decide(t, d, w)
    assert sorted((r["token"], r["task_id"]) for r in done.collect()) == [("a", "q0"), ("b", "q1"), ("c", "q2"), ("d", "q3")]


def test_reading_verdicts_of_a_batch(spark):
    t = spark.createDataFrame([], "id string, target long, status string")
    d = spark.createDataFrame([(5, "old")], "seq long, token string")
    rows = [(1, "banana", "a", "t1", "x"), (2, "accepted", " ", "t2", "x"), (3, "accepted", "a", "old", "x"), (4, "accepted", "a", "t4", "x"), (4, "rejected", "a", "t5", "x"), (5, "accepted", "a", "t6", None), (9, "accepted", "a", "t9", "x"), (6, "accepted", "a", "t4", "x")]
    w = spark.createDataFrame(rows, "target long, outcome string, reviewer string, token string, reason string")
    known = spark.createDataFrame([(k,) for k in range(1, 8)], "target long")
    done, refused = V.decide_readings(t, d, w, known)
    assert [(r["target"], r["token"], r["seq"]) for r in done.collect()] == [(4, "t4", 6)]
    assert {(r["target"], r["token"]): r["why"] for r in refused.collect()} == {
        (1, "t1"): "unknown outcome", (2, "t2"): "no reviewer", (3, "old"): "token was used", (4, "t5"): "revision has another verdict", (5, "t6"): "no reason",
        (9, "t9"): "no such revision", (6, "t4"): "token stands twice"
    }


def test_rings_have_paths(spark):
    edges = [("b", "c"), ("c", "a"), ("a", "b"), ("t", "b"), ("u", "t"), ("x", "x"), ("p", "q"), *((f"r{k:02}", f"r{(k * 7 + 3) % 20:02}") for k in range(20))]
    g = spark.createDataFrame(edges, "src string, dst string")
    got = {r["leader"]: r["path"] for r in G.paths(g).collect()}
    assert got["a"] == "a > b > c > a" and got["x"] == "x > x" and not set(got) & {"t", "u", "p", "b"}
    step = dict(edges)
    for leader, path in got.items():
        nodes = path.split(" > ")
        assert min(nodes) == leader == nodes[0] == nodes[-1] and all(step[a] == b for a, b in zip(nodes, nodes[1:])) and len(set(nodes)) == len(nodes) - 1
    assert {r["id"] for r in G.rings(g).collect()} == {n for p in got.values() for n in p.split(" > ")}
    assert G.rings(g.limit(0)).count() == 0
