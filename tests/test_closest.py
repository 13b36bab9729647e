"""The closest names, step by step."""

from claimweave.operators import search


def _grams(x):
    import re

    words = [w for w in re.split("[^a-z0-9]+", x.lower()) if w]
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def test_lookalikes_are_those_of_all_pairs_without_trying_them(spark, monkeypatch):
    names = [(f"s{k}", f"Supplier#{k * 37 % 5000:09d}") for k in range(300)] + [("t", "Supplier#000000111"), ("u", "Supplier#000001111")]
    names += [(f"b{k}", "Supp 1") for k in range(20)] + [("x", "Zq"), ("y", None), ("z", "--")]
    aliases = spark.createDataFrame([(e, n, n and n.lower()) for e, n in names], "entity_id string, name string, normalized_name string")
    entities = spark.createDataFrame([(e, "office" if e == "s3" else "organization") for e, _ in names], "id string, kind string")
    asked = [f"suppliers-{k * 37 % 5000:09d}" for k in range(0, 300, 7)] + ["supplier-000000111", "Supp 1", "zq", "nothing like it", "", "supplier"]

    def refuse(*_):
        raise AssertionError("a threshold alone finds all names that differ by a number")

    monkeypatch.setattr(search, "matches", refuse)
    found = search.lookalikes(aliases, entities, spark.createDataFrame([(q,) for q in asked], "query string"), "organization").collect()
    wanted = set()
    for q in set(asked):
        a = _grams(q)
        near = [(len(a & b) / len(a | b), n, e) for e, n in names if n and e != "s3" and (b := _grams(n)) and a]
        near = sorted((-round(w, 9), n, e, round(w, 6)) for w, n, e in near if w >= 0.55)[:5]
        wanted |= {(q, k, e, n, w) for k, (_, n, e, w) in enumerate(near, 1)}
    assert {(r["query"], r["rank"], r["entity_id"], r["name"], r["whole"]) for r in found} == wanted
    assert len(found) == len(wanted) > 200
