"""Operators 11 to 13 against brute force, and their behaviour on odd rows."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from claimweave.llm import dialogue, multi_index, periodicity, queries

FOLDER = "/root/testdata/sf0.001"


def brute_runs(w, least=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            x = w[s : i + q]
            if len(x) >= max(least, 2 * q) and not any(all(a == b for a, b in zip(x, x[r:])) for r in range(1, q)):
                out.add((s, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_those_of_all_periods():
    rng = random.Random(7)
    for _ in range(1500):
        n, k = rng.randrange(90), rng.choice([1, 2, 3, 5, 26])
        w = [str(rng.randrange(k)) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            w = w[:a] + [w[a : a + p][(i - a) % len(w[a : a + p])] for i in range(a, n)]
        w += w[: rng.randrange(20)] * rng.randrange(4)
        assert periodicity.runs(w) == brute_runs(w), w


def test_extensions_are_checked_word_for_word(monkeypatch):
    monkeypatch.setattr(periodicity.Extensions, "_same", lambda self, i, j, k: True)  # hashes that always agree
    w = list("abababcabababd" * 3)
    assert periodicity.runs(w) == brute_runs(w)


def test_long_periodic_texts_are_fast():
    assert periodicity.runs(["a", "b", "c"] * 50_000) == [(0, 150_000, 3)]


def expected_runs(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words) if n < 400 else periodicity.runs(words)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    text = b" ".join(w for i, w in enumerate(words) if i not in drop)
    said = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha(said), sha(text))


def test_periodic_runs_query(spark):
    rows = queries.op11_periodic_runs(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, rows)) == sorted(expected_runs(*d) for d in docs)
    assert sum(r["n_runs"] > 0 for r in rows) > 5


def test_periodic_runs_on_odd_rows(spark):
    text = "x " * 11 + "y " * 12
    made = spark.createDataFrame(
        [(None, text, 1), (1, None, 1), (2, " \t\n", 1), (3, text, 1), (3, text, 1), (4, "é " * 20 + " ü" * 12, 1)], "doc_id int, text string, n_runs int"
    )
    out = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in periodicity.collapsed(made).collect())
    long = "x " * 10 + "x y"
    assert out == [
        ("1", 0, [], ""), ("2", 0, [], ""), ("3", 23, [(11, 12, 1)], long), ("3", 23, [(11, 12, 1)], long),
        ("4", 13, [(1, 12, 1)], "é " * 20 + " ü"), ("None", 23, [(11, 12, 1)], long)
    ]
    assert periodicity.digests(periodicity.collapsed(made.limit(0))).count() == 0


def exact_nearest(rows, asked, k):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = {}
    for q, x in asked:
        near = sorted(((-round(float(unit(x) @ unit(y)), 12), i) for i, y in rows if i != q and len(x) == len(y)))[:k]
        out[q] = [i for _, i in near]
    return out


def test_probing_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 24))
    turn = multi_index.rotations(multi_index._units(x), 24)
    own = multi_index.codes(multi_index._units(x), turn)
    shard = multi_index.Shard(np.arange(700), x, own)
    for radius in (0, 3, 8, 15, 31, 40, 63, 64, 90, 128, 200):
        for i in range(0, 700, 97):
            want = np.flatnonzero(multi_index.distances(own, np.repeat(own[i : i + 1], 700, 0)) <= radius)
            assert np.flatnonzero(shard.probed(own[i : i + 1], radius)[:, 0]).tolist() == want.tolist()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = queries.op12_nearest_neighbours(spark, folder).collect()
    truth = duckdb.sql(multi_index.ORACLE.replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet'")).fetchall()
    asked = len({t[0] for t in truth})
    assert len(got) == len(truth) == 5 * asked
    hit = {(r["query_id"], r["vec_id"]) for r in got} & {(t[0], t[2]) for t in truth}
    assert len(hit) >= 0.9 * len(truth)


def test_neighbours_on_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, v), (4, [2.0, 4.0, 6.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [1.0, 1.0])]
    rows += [(None, v), (10, [1e200, 0.0, 0.0]), (11, [-1.0, 0.0, 0.0]), (3, v), (12, [])]
    made = multi_index.usable(spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<double>, score int"))
    got = multi_index.search(made, made.where("vec_id in (1, 9, 11)"), 4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 1] == [(1, 1, 2), (1, 2, 3), (1, 3, 3), (1, 4, 4)]
    assert [r["vec_id"] for r in got if r["query_id"] == 11] == [1, 2, 3, 3]
    assert not [r for r in got if r["query_id"] == 9]
    assert multi_index.search(made.limit(0), made, 4).count() == 0 == multi_index.search(made, made.limit(0), 4).count()


def test_shards_and_blocks_change_nothing(spark):
    some = multi_index.usable(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    asked = some.where("vec_id % 50 = 0")
    a = sorted(map(tuple, multi_index.search(some, asked, 5).collect()))
    b = sorted(map(tuple, multi_index.search(some, asked, 5, shard=100, block=3).collect()))
    assert [x[:3] for x in a] == [x[:3] for x in b]


def brute_repair(roles, faults):
    """The least (cost, edits) over every sequence of edits with up to two inserts in a row."""
    best, n = None, len(roles)
    ok = lambda s: s[:1] == "s" and len(s) > 1 and set(map("".join, zip(*[iter(s[1:])] * 2))) <= {"ua"} and len(s) % 2 == 1 or len(s) % 2 == 0 and set(map("".join, zip(*[iter(s)] * 2))) <= {"ua"}
    for ops in itertools.product("KRD", repeat=n):
        if any(o != "D" and f in (1, 2) for o, f in zip(ops, faults)):
            continue
        base = sum({"K": 0, "R": 2, "D": 3}[o] + (f == 3 and o != "D") for o, f in zip(ops, faults))
        if best and base > best[0]:
            continue
        for ins in itertools.product(range(3), repeat=n + 1):
            cost = base + 2 * sum(ins)
            audit = "".join("I" * k + o for k, o in zip(ins, (*ops, "")))
            if best and (cost, audit) >= best:
                continue
            free = [""]
            for k, o, r in zip(ins, (*ops, ""), (*roles, "")):
                free = [f + x for f in free for x in map("".join, itertools.product("ua", repeat=k))]
                free = [f + x for f in free for x in ({"K": [r[:1]], "R": ["u", "a"], "D": [""], "": [""]}[o])]
            if any(ok(f) for f in free):
                best = (cost, audit)
    return best


def test_search_finds_the_cheapest_edits():
    rng = random.Random(5)
    for _ in range(120):
        n = rng.randrange(5)
        roles = [rng.choice(["system", "user", "assistant", "tool", " "]) for _ in range(n)]
        faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        got = next((c, a) for s, c, a in dialogue.searched(roles, faults) if s in dialogue.ACCEPTING)
        assert got == brute_repair(roles, faults), (roles, faults)
        said = "".join(r[0] for r, _ in dialogue.replayed(roles, roles, got[1]))
        assert said.removeprefix("s").replace("ua", "") == "" and said != "s"


def _dialogues(spark, n=60, seed=11):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(40)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool"])
            text = rng.choice(["Yes.", "No?", "and", " ", None, "", "Well!\n", "so. on", f"{turn} is it."])
            rows.append((conv if conv % 7 else None, rng.choice([turn, turn, turn, None]), role, text, 0))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")


def test_blocks_give_what_one_search_gives(spark):
    rows = _dialogues(spark).cache()
    ids = rows.select("conv_id")
    whole = sorted(map(str, dialogue.digests(dialogue.repair(rows), ids).collect()))
    assert len(whole) == rows.select("conv_id").distinct().count()
    for block in (1, 3, 8):
        assert sorted(map(str, dialogue.digests(dialogue.repair(rows, block), ids).collect())) == whole


def test_chained_blocks_keep_the_order_of_edits():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 14)
        roles = [rng.choice(["system", "user", "assistant"]) for _ in range(n)]
        faults = [rng.choice([0, 0, 0, 1, 3]) for _ in range(n)]
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(3))})
        found = [[(s, *w) for s in range(4) for w in dialogue.searched(roles[a:b], faults[a:b], s, whole=False)] for a, b in zip(cuts, cuts[1:])]
        rank = [{a: k for k, a in enumerate(sorted({w[3] for w in ways}))} for ways in found]
        cost, steps, tail = dialogue.chained([[(s, e, c, r[a]) for s, e, c, a in ways] for ways, r in zip(found, rank)])
        audit = "".join(next(a for s, e, _, a in ways if (s, e) == step) for ways, step in zip(found, steps)) + tail
        assert (cost, audit) == next((c, a) for s, c, a in dialogue.searched(roles, faults) if s in dialogue.ACCEPTING)


def test_dialogues_equal_sql(spark):
    rows = _dialogues(spark, 40, 3)
    con = duckdb.connect()
    con.register("conversations", rows.drop("cost").toArrow())
    got = dialogue.digests(dialogue.repair(dialogue.damaged(rows)), rows)
    want = con.sql(dialogue.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(str(r) for r in want.fetchall())


def test_empty_dialogues(spark):
    none = _dialogues(spark, 0)
    assert dialogue.digests(dialogue.repair(none), none).count() == 0
    ids = spark.createDataFrame([(5,), (5,), (None,)], "conv_id long")
    rows = sorted(map(str, (tuple(r) for r in dialogue.digests(dialogue.repair(none), ids).collect())))
    empty = hashlib.sha256(b"").hexdigest()
    assert rows == sorted([str((5, 0, 0, 0, 0, 0, 0, "", empty)), str((None, 0, 0, 0, 0, 0, 0, "", empty))])
