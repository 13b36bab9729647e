"""The kept trigram index: built once, pruned, added to, and equal to comparing all names."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from claimweave.operators import name_index, search as S
from claimweave.operators.name_index import NameIndex
from claimweave.plans.graph import Graph

FOLDER = "/root/testdata/sf0.001"


def grams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def names(spark, rows):
    return spark.createDataFrame([(e, n, " ".join(n.lower().split())) for e, n in rows], "entity_id string, name string, normalized_name string")


@pytest.mark.parametrize("floor", [0.3, 0.55, 0.8, 1.0])
def test_matches_are_those_of_all_pairs(spark, floor):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    held = [(f"e{k}", " ".join(word() for _ in range(rng.randrange(1, 4)))) for k in range(150)] + [("e1", "Abc  abc"), ("e2", "--")]
    asked = sorted({" ".join(word() for _ in range(rng.randrange(1, 3))) for _ in range(15)} | {"--", "zzz", "ABC abc"})
    index = NameIndex.build(names(spark, held), names_per_bucket=10)
    assert index.buckets > 8
    got = {(r["query"], r["name"]): round(r["whole"], 9) for r in index.matches(spark.createDataFrame([(q,) for q in asked], "query string"), floor).collect()}
    want = {}
    for q, (_, n) in itertools.product(asked, held):
        a, b = grams(q), grams(n)
        if a & b and len(a & b) / len(a | b) >= floor:
            want[q, n] = round(len(a & b) / len(a | b), 9)
    assert got == want


def test_an_index_is_built_once_and_pruned(spark, monkeypatch):
    built = []
    old = NameIndex.build.__func__
    monkeypatch.setattr(NameIndex, "build", classmethod(lambda cls, *a: built.append(1) or old(cls, *a)))
    monkeypatch.setattr(name_index, "_KEPT", {})
    g, asked = Graph(spark, FOLDER), spark.createDataFrame([("supplier 3",)], "query string")
    first = S.matches(NameIndex.kept(g.alias()), asked).collect()
    again = Graph(spark, FOLDER)
    assert S.matches(NameIndex.kept(again.alias()), asked).collect() == first and len(first) and len(built) == 1
    NameIndex.kept(Graph(spark, "/root/testdata/sf0.01").alias())
    NameIndex.kept(names(spark, [("a", "x")])), NameIndex.kept(names(spark, [("a", "y")]))  # of rows in memory nothing is kept
    assert len(built) == 4 and len(name_index._KEPT) == 2
    plan = NameIndex.kept(g.alias()).probed(asked, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_aliases_are_added(spark):
    index = NameIndex.build(names(spark, [("e1", "red widget"), ("e2", "blue widget")]))
    index.add(names(spark, [("e3", "red widget"), ("e4", "red wagon"), ("e1", "red widget")]))
    ask = spark.createDataFrame([("red widget",), ("wagon",)], "query string")
    found = S.bearers(index.matches(ask, 0.3), index).select("query", "entity_id").collect()
    assert sorted((r[0], r[1]) for r in found if r[0] == "wagon") == [("wagon", "e4")]
    assert {r[1] for r in found if r[0] == "red widget"} >= {"e1", "e2", "e3", "e4"} and len(found) == len(set(found))
    assert index.frequencies().where("gram = 'wag'").first()["n"] == 1
    assert index.postings().groupBy("gram", "name").count().where(F.col("count") > 1).count() == 0
