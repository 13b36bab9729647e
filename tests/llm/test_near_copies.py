"""Near copies against a comparison of all pairs."""

import itertools

import corpus_pipeline
import numpy as np
import pytest

from claimweave.llm import near_copies, simhash

FOLDER = "/root/testdata/sf0.01"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(rows):
    """Pairs of places in (doc_id, text): those at similarity 0.8, and of them those that share a bucket."""
    sets = [brute_runs(t) for _, t in rows]
    prints = {}
    for (_, t), x in zip(rows, sets):
        mine = [simhash.signed(f) for f in simhash.fingerprints(t, 2, 4)]
        prints[x] = min(prints.get(x, mine), mine)
    masks = simhash.covering_masks(4)
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b:
            yield i, j, 0
        elif 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
            apart = [(x ^ y) & (1 << 64) - 1 for x, y in zip(prints[a], prints[b])]
            yield i, j, min(x.bit_count() for x in apart) if any(not x & m for x in apart for m in masks) else 99


def keepers(rows, links):
    """The least doc_id of each component."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted(min(g) for g in groups.values())


def edited():
    """Copies with words changed, on both sides of the threshold, and of sizes where one run decides."""
    rng, texts = np.random.default_rng(3), ["", " \t", "one", "One ", "two words"]
    for n in (5, 6, 8, 9, 13, 14, 20, 40, 90, 300):
        base = [f"w{x}" for x in rng.integers(0, 9000, n)]
        texts.append(" ".join(base))
        for cut in range(1, 1 + n // 4, max(1, n // 40)):
            texts += [" ".join(base[cut:]), " ".join(base[:-cut] + [f"x{n}{cut}"] * cut)]
        for k in (1, 2, 3, 5, 8):
            words = list(base)
            for at in rng.integers(0, n, k):
                words[at] = f"y{at}"
            texts.append(" ".join(words))
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("which", ["edited", "sf0.01"])
def test_stage_removes_what_shares_a_bucket_and_is_alike(spark, which):
    if which == "edited":
        docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in edited()], DDL).repartition(3)
    else:
        docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    links = list(brute_links(rows))
    out = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect())
    assert out == keepers(rows, [(i, j) for i, j, apart in links if apart < 99])
    most, least = keepers(rows, [(i, j) for i, j, apart in links if apart <= 4]), keepers(rows, [(i, j) for i, j, _ in links])
    assert len(least) <= len(out) <= len(most)


def test_a_large_group_is_not_compared_pair_by_pair(spark):
    """2,000 different near copies: as many links, not two million."""
    base = [f"w{x}" for x in np.random.default_rng(1).integers(0, 9000, 200)]
    texts = [" ".join(base[:i % 190 + 1] + [f"x{i}"] + base[i % 190 + 2 :]) for i in range(2000)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DDL)
    assert [r["doc_id"] for r in near_copies.keep_one(docs).collect()] == [0]


def test_covering_keeps_its_word():
    rng = np.random.default_rng(4)
    for radius in range(2, 7):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 2 and all(m.bit_count() == 32 for m in masks)
        for _ in range(300):
            apart = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
            assert any(not apart & m for m in masks)
