import gzip
import hashlib
import io
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from claimweave.llm import embed_dedup, topk, warc
from claimweave.llm.common import Scratch

VECTORS = "vec_id long, embedding array<float>, label int"


def some_vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, 16))
    rows = [v for v in base] + [base[i % 5] + 0.08 * rng.standard_normal(16) for i in range(120)] + [base[0]] * 4
    return [(i, [float(x) for x in v], 0) for i, v in enumerate(np.array(rows, np.float32))]


ODD = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [1.0] * 15 + [None], 0), (904, [float("nan")] + [1.0] * 15, 0), (905, [float("inf")] + [1.0] * 15, 0), (906, [1.0, 2.0], None), (907, [1.0, 2.1], 0), (None, [1.0] * 16, 0)]


def test_topk_equals_brute_force(spark):
    rows = [r for r in some_vectors()] + ODD
    v = topk.integers(spark.createDataFrame(rows, VECTORS))
    x = {i: np.floor(256 * np.array(e, np.float64)).astype(int) for i, e, _ in rows if i is not None and e and all(c is not None and np.isfinite(c) for c in e)}
    expected = set()
    for q in (i for i in x if i % 50 == 0):
        best = sorted(((-int(x[q] @ x[j]), j) for j in x if j != q and len(x[j]) == len(x[q])))[:5]
        expected |= {(q, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    asked = v.where("vec_id % 50 = 0")
    for shard in (16384, 50):
        assert {tuple(r) for r in topk.search(v, asked, 5, shard=shard, block=2).collect()} == expected
    few = topk.search(v.where("vec_id in (0, 1, 2)"), v.where("vec_id = 0"), 5).collect()
    assert len(few) == 2
    assert topk.search(v.limit(0), asked).count() == 0 and topk.search(v, asked.limit(0)).count() == 0


def test_search_stops_only_on_proof():
    """Whatever the data, the index gives the exact answer, also with ties."""
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (400, 8))
    ids = np.arange(400) * 7
    index = topk.ImpactIndex.of(ids, x)
    index = topk.ImpactIndex.read(pd.DataFrame(index.packed(), columns=["segment", "ids", "starts", "rows", "vals"]))
    got = set(index.search(ids[:20], x[:20], 5))
    for k in range(20):
        best = sorted((-int(x[k] @ x[j]), int(ids[j])) for j in range(400) if j != k)[:5]
        assert {(int(ids[k]), j, -s) for s, j in best} <= got
    assert len(got) == 100


def test_embedding_links_equal_brute_force(spark):
    rows = some_vectors(1) + ODD
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), miss=1e-4).collect()}
    assert len(got) == len(rows)
    x = {i: np.array(e, np.float64) for i, e, _ in rows if i is not None and e and all(c is not None and np.isfinite(c) for c in e) and any(e)}
    links = {i: {j for j in x if j != i and len(x[j]) == len(x[i]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.9} for i in x}
    for i, _, _ in rows:
        if i is None:
            assert got[i]["component_id"] is None
            continue
        reach, new = {i}, {i}
        while new:
            new = set().union(*(links.get(j, set()) for j in new)) - reach
            reach |= new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, ())), min(reach), i == min(reach))


def test_equal_vectors_cost_one(spark):
    """50,000 equal vectors are one class, not 25 blocks against each other."""
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(50_000)] + [(50_000, [1.0, 2.0, 3.0, 4.1], 0), (50_001, [-1.0, 0.0, 0.0, 0.0], 0), (50_001, [4.0, 3.0, -2.0, 1.0], 0)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).groupBy("n_links", "component_id", "kept").count().collect()
    assert Counter({(r["n_links"], r["component_id"], r["kept"]): r["count"] for r in got}) == Counter({(50_000, 0, False): 50_000, (50_000, 0, True): 1, (0, 50_001, True): 2})


def test_embedding_blocks_and_empty(spark, monkeypatch):
    df = spark.createDataFrame(some_vectors(3), VECTORS)
    whole = {tuple(r) for r in embed_dedup.near_duplicates(df, miss=1e-4).collect()}
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)  # many blocks for one bucket
    assert {tuple(r) for r in embed_dedup.near_duplicates(df, miss=1e-4).collect()} == whole
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    bits, tables = embed_dedup.shape(1 << 20)
    assert bits == 11 and tables > 20


PAGES = "page_id long, url string, html string"
LONG = "héllo " * 40


def odd_pages():
    return [(5, "http://a/x y\r\n", LONG), (3, "http://b", LONG), (3, "http://b", LONG), (9, None, LONG), (None, "u", LONG), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "x" * 99), (8, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100), (12, "u", "\x1f\u008b\x08 WARC/1.1 \r\n\r\n" * 30), (13, "u", "z" * 300_000)]


def expected_pages(rows):
    out = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        same = [r[0] for r in rows if r[2] == html and r[0] is not None]
        first = min(same, default=None) if len(p) >= 100 else None
        revisit = first is not None and page_id != first
        out.append((page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("split", [warc.SPLIT_BYTES, 97])
def test_archives_round_trip(spark, split):
    df = spark.createDataFrame(odd_pages(), PAGES).repartition(2)
    scratch = Scratch(spark, "warc-test")
    files = warc.write_archives(df, scratch.path("archives"), scratch)
    got = warc.read_archives(spark, files, split=split).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected_pages(odd_pages())
    payloads = {r["page_id"]: r["payload"] for r in got}
    assert payloads[13] == b"z" * 300_000 and payloads[1] == b"" and payloads[5] is None
    for f in files.collect():  # any gzip reader can read them
        with open(f["path"].removeprefix("file:"), "rb") as raw:
            assert gzip.decompress(raw.read()).startswith(b"WARC/1.1\r\n")


def test_reader_skips_what_is_no_record():
    record = warc._record(1, "u", b"p" * 500, hashlib.sha256(b"p" * 500).hexdigest(), None)
    junk = gzip.compress(b"not an archive") + b"\x1f\x8b\x08junk"
    data = junk + record + b"\0\0" + record
    found = [at for at, _ in warc.records(io.BytesIO(data), 0, len(data))]
    assert found == [len(junk), len(junk) + len(record) + 2]
    assert [at for at, _ in warc.records(io.BytesIO(data), len(junk) + 1, len(data))] == found[1:]
    assert list(warc.records(io.BytesIO(data), 0, len(junk))) == []
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(record[:-20]), 0, len(record)))
    broken = warc._record(1, "u", b"p" * 500, "0" * 64, None)
    with pytest.raises(ValueError):
        warc.parsed(gzip.decompress(broken))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


