"""Operators on documents, against brute force and in odd cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimweave.llm import mixing, near_copies, piece_codec, quality, simhash, substring, token_store, toxicity, warc

DDL = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: The library with nothing set, as the contract calls it.
PLAIN = Tokenizer.from_file(BPE)


def words(n, seed=0):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n)]


def odd_documents():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long, passage = " ".join(words(30_000, 1)), " ".join(words(60, 2))
    texts = [None, "", " \t\n", "one", "Two words", "three small words", long, long + " end", passage, f"before {passage} after", "ÀÉ x\x0by z　a\x85b", "a  b   c ", "漢字 <|endoftext|> 😀", "same", "same"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[8], (None, "no id", None, None, None), (None, None, None, None, None), (99, passage, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DDL).withColumns({c: F.lit(7) for c in ("fp", "th", "u", "v", "key", "run", "spans", "score", "label", "ids", "size", "rate", "block", "part", "sigs")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def brute_fingerprint(text):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """doc_id sets joined where fingerprints differ in two bits or fewer."""
    u = sorted(set(prints.values()))
    up = {x: x for x in u}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(u):
        for y in u[:i]:
            if (x ^ y).bit_count() <= 2:
                up[root(x)] = root(y)
    return {k: root(x) for k, x in prints.items()}


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 6
    assert all(any(not (m >> i & 1 or m >> j & 1) for m in masks) for i in range(64) for j in range(i + 1))


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    prints = list(base)
    for x in base[:25]:
        for _ in range(6):  # chains and clumps of near fingerprints
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            prints.append(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in set(prints)]
    from claimweave.llm.common import Scratch

    got = {r["u"]: r["v"] for r in simhash.linked(spark.createDataFrame(signed, "fp long"), Scratch(spark, "t")).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for k, r in brute_components({x[0]: x[0] & (1 << 64) - 1 for x in signed}).items():
        theirs[r].add(k)
    for (x,) in signed:
        mine[got.get(x, x)].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_odd_cases(spark, odd, empty):
    rows = odd_documents()
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    prints = {k: brute_fingerprint(r[1]) for k, r in enumerate(rows)}
    assert sorted(r["fp"] & (1 << 64) - 1 for r in got) == sorted(prints.values())
    groups = defaultdict(list)
    for k, r in brute_components(prints).items():
        groups[r].append(rows[k][0])
    expected = Counter((i, min((x for x in g if x is not None), default=None)) for g in groups.values() for i in g)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == expected
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.count() == len(groups) and kept.columns == odd.columns


def brute_repeats(rows, w=35):
    cut = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(x[i : i + w]) for x in cut for i in range(len(x) - w + 1))
    out = []
    for r, x in zip(rows, cut):
        gone = set()
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone.update(range(i, i + w))
        kept = b" ".join(y for i, y in enumerate(x) if i not in gone)
        out.append((r[0], len(x), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substring_odd_cases(spark, odd, empty):
    got = substring.without_repeats(odd).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_repeats(odd_documents())
    assert substring.without_repeats(empty).count() == 0 and substring.replace_text(empty).count() == 0
    kept = substring.replace_text(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_documents())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_equals_brute_force(spark, seed):
    """Shared passages of every length around the window, at every offset, in few distinct words, and repeats within a text."""
    rng = np.random.default_rng(seed)
    passages = [words(int(n), seed * 100 + k) for k, n in enumerate((34, 35, 36, 40, 60, 90))] + [["a", "b"] * 30, ["z"] * 50]
    rows = []
    for i in range(40):
        text = words(int(rng.integers(0, 80)), 1000 * seed + i)
        for k in rng.integers(0, len(passages), 3):
            p = passages[k]
            lo = int(rng.integers(0, max(1, len(p) - 30)))
            text += p[lo:] + words(int(rng.integers(0, 9)), 7 * i + k)
        rows.append((i, " ".join(text), "en", "s", 0))
    df = spark.createDataFrame(rows, DDL)
    got = Counter(map(tuple, substring.without_repeats(df, full=False).collect()))
    assert got == brute_repeats(rows) and any(r[2] for r in got)


def test_phrases_in_pieces(monkeypatch):
    """A text cut into several pieces has the same windows as in one."""
    w = [x.encode() for x in words(3000)]
    whole = np.concatenate([n for *_, n in substring.phrases(w)]).sum()
    monkeypatch.setattr(substring, "PIECE", 256)
    monkeypatch.setattr(substring, "_LOW", np.uint64(255))
    assert np.concatenate([n for *_, n in substring.phrases(w)]).sum() == whole == 3000 - 34


def test_token_store(spark, odd, empty, tmp_path):
    tokenizer = Tokenizer.from_file(BPE)
    rows = sorted(odd_documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(map(tuple, token_store.round_trip(odd, BPE).collect()), key=lambda r: r[1])
    start = 0
    for r, (doc_id, at, n, crc) in zip(rows, got, strict=True):
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        assert (doc_id, at, n, crc) == (r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert token_store.round_trip(empty, BPE).count() == 0
    token_store.write_store(odd, str(tmp_path / "s"), BPE)
    one = token_store.read_store(spark, str(tmp_path / "s")).where("doc_id = 6")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)" in one._jdf.queryExecution().executedPlan().toString()


def test_encoder_equals_library():
    encoder, texts = token_store.ByteLevelEncoder.of(BPE), ["it's I'LL we've  x\n\n y\t\tz", "a   ", "!!'s ''s d'x", "½²x ª", "\x00\x1f  x", "\r\n \n"]
    assert encoder.by_word and encoder.encode(texts) == [encoder._whole(t) for t in texts]


def test_mixing(spark, odd, empty):
    got = mixing.with_copies(odd)
    assert got.count() == len(odd_documents())
    rows = got.select("source", "size", "source_size", "target", "copies").collect()
    sizes = {r["source"]: r["source_size"] for r in rows}
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:  # reshare the excess until none is above its cap
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        left, open_ = left - sum(3 * sizes[s] for s in over), open_ - over
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 for r in rows)
    assert all(0 <= r["copies"] <= 3 for r in rows)
    again = mixing.with_copies(odd).select("doc_id", "text", "copies")
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got.select("doc_id", "text", "copies").collect()))
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(odd).count() == sum(r["copies"] for r in rows)
    assert mixing.with_copies(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixing_with_many_sources(spark, odd, monkeypatch):
    """The join by source and salt gives the same mix as the broadcast."""
    columns = ("doc_id", "text", "source_size", "target", "copies")
    few = Counter(map(tuple, mixing.with_copies(odd).select(*columns).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert Counter(map(tuple, mixing.with_copies(odd).select(*columns).collect())) == few


def test_mixing_meets_targets(spark):
    rows = [(i, " ".join(["x"] * (1 + i % 9)), "en", f"s{i % 7 if i % 3 else 0}", 0) for i in range(6000)]
    got = mixing.with_copies(spark.createDataFrame(rows, DDL)).groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert all(abs(r["n"] - r["t"]) < 0.1 * r["t"] for r in got)


def test_pieces(spark, odd, empty):
    model = piece_codec.PieceModel.of(PIECES)
    done = piece_codec.encode(odd, PIECES, giant=500, chunk=100).collect()
    assert len(done) == len(odd_documents())
    for r in done:
        assert r["ids"] == model.processor.encode(r["text"] or "")
    digest = piece_codec.digests(piece_codec.encode(odd, PIECES), PIECES)
    assert digest.count() == len(odd_documents()) and digest.where("not round_trip").count() == 0
    assert piece_codec.encode(empty, PIECES).count() == 0


def unigram_file(path, byte_fallback):
    """A unigram model written by hand: a few pieces with dyadic scores."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = byte_fallback
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{b:02X}>", 6) for b in range(256) if byte_fallback)):
        m.pieces.add(piece=piece, score=0.0, type=kind)
    rng = np.random.default_rng(3)
    pieces = ["▁", "a", "b", "c", "▁a", "▁b", "ab", "bc", "abc", "cab", "▁ab", "bca", "aab", "▁cab", "bcab", "abcab"]
    for p in pieces:
        m.pieces.add(piece=p, score=-float(rng.integers(8, 200 * len(p))) / 16 - 1 / (1 << len(p)), type=1)
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_max_plus_scan_equals_library(spark, tmp_path, monkeypatch, byte_fallback):
    monkeypatch.setattr(piece_codec, "RUN", 3)
    path = unigram_file(tmp_path / f"u{byte_fallback}.model", byte_fallback)
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("abc  é" if k % 2 else "abc "), n)) for k, n in enumerate((5, 60, 200, 777, 1500))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = piece_codec.PieceModel.of(path)
    assert model.kind == piece_codec.UNIGRAM and model.chunks
    for chunk in (7, 64):
        got = {r["doc_id"]: r["ids"] for r in piece_codec.encode(df, path, giant=20, chunk=chunk).collect()}
        assert got == {k: model.processor.encode(t) for k, t in enumerate(texts)}


def test_substring_is_linear_in_repeated_rows(spark):
    """One text 2,000 times: as many spans as once, and all its words go."""
    text = " ".join(words(300, 8))
    rows = [(7, text, "en", "s", 0)] * 2000 + [(8, " ".join(words(50, 9)) + " " + text, "en", "s", 0), (None, text, None, None, None), (-1, "x " + text, None, None, None)]
    df = spark.createDataFrame(rows, DDL).repartition(8)
    from claimweave.llm.common import Scratch

    spans = substring.repeated_windows(df, Scratch(spark, "t")).selectExpr("size(spans) AS n").collect()
    assert len(spans) == 4 and max(r["n"] for r in spans) <= 300
    assert Counter(map(tuple, substring.without_repeats(df, full=False).collect())) == brute_repeats(rows)


def test_batches_are_bounded_in_bytes(spark):
    """Fifty texts of a megabyte do not make one batch; every operator asks for the same bounds."""
    from claimweave.llm import common

    common.small_batches(spark)
    wide = spark.range(0, 50, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("wide word "), 100_000).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    assert max(r["n"] for r in wide.mapInArrow(sizes, "n long").collect()) <= common.BATCH_BYTES + (2 << 20)
    few = wide.limit(3)
    assert simhash.near_duplicates(few).select("component_id").distinct().count() == 1
    assert {r["n_removed"] for r in substring.without_repeats(few, full=False).collect()} == {200_000}
    assert len({r["ids_crc32"] for r in token_store.round_trip(few, BPE).collect()}) == 1
    assert {r["round_trip"] for r in piece_codec.digests(piece_codec.encode(few, PIECES), PIECES).collect()} == {True}
    assert near_copies.keep_one(few).count() == 1
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(few, labels).select("score").distinct().count() == 1
    assert toxicity.score(few, labels).select("score").distinct().count() == 1
    pages = few.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {(r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()} == {("response", None), ("revisit", 0)}


def test_scratch_tables_can_be_dropped(spark):
    import os

    from claimweave.llm.common import Scratch

    scratch = Scratch(spark, "t")
    scratch.table(spark.range(3), "a")
    folder = scratch.path("a").removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    scratch.drop("a")
    assert not os.path.isdir(folder)


def test_quality_equals_a_plain_fit(spark):
    """The summed normal equations, solved, against one least-squares problem over the whole matrix."""
    docs, labels = labelled_corpus(spark, 400)
    rows = quality.labelled(quality.with_statistics(docs.repartition(5)), labels, "quality")
    model = quality.fit(rows)
    held = rows.select("doc_id", "f", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("aside")).collect()
    x, y = (np.array([r[c] for r in held if not r["aside"]], float) for c in ("f", "label"))
    whole = np.array([r["f"] for r in held])
    assert np.allclose(model.mean, whole.mean(axis=0)) and np.allclose(model.sd, np.where(whole.std(axis=0) > 1e-9, whole.std(axis=0), 1))
    z = model.features(x)
    wide = np.vstack([z, np.sqrt(quality.RIDGE * len(z)) * np.eye(z.shape[1])])
    beta = np.linalg.lstsq(wide, np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(z @ model.beta, z @ beta, atol=1e-6)


def brute_tree(x, y, margin, cuts):
    """One tree by trying every feature and cut at every node: the value that each row gets."""
    from claimweave.llm import boosting as B

    p = 1 / (1 + np.exp(-margin))
    g, h = p - y, p * (1 - p)

    def grow(rows, depth):
        best, split = 1e-6, None
        if depth < B.DEPTH:
            gain0 = g[rows].sum() ** 2 / (h[rows].sum() + B.L2)
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if min(len(left), len(right)) >= B.LEAST:
                        gain = sum(g[r].sum() ** 2 / (h[r].sum() + B.L2) for r in (left, right)) - gain0
                        if gain > best + 1e-12:
                            best, split = gain, (left, right)
        if split is None:
            out[rows] = -B.RATE * g[rows].sum() / (h[rows].sum() + B.L2)
        else:
            for part in split:
                grow(part, depth + 1)

    out = np.zeros(len(y))
    grow(np.arange(len(y)), 0)
    return out


def test_trees_equal_brute_force(monkeypatch):
    from claimweave.llm import boosting

    monkeypatch.setattr(boosting, "TREES", 4)
    rng = np.random.default_rng(6)
    x = np.round(rng.random((160, 3)), 1)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7) | (rng.random(160) < 0.1)).astype(float)
    trees = boosting.BoostedTrees().fit(x, y)
    cuts = [np.unique(np.concatenate([c, c - 1e-9])) for c in x.T]  # every way to part the rows
    margin = np.full(160, trees.base)
    for _ in range(4):
        margin = margin + brute_tree(x, y, margin, cuts)
    loss = lambda m: np.log1p(np.exp(-m * (2 * y - 1))).mean()
    assert abs(loss(trees.margin(x)) - loss(margin)) < 1e-3


def test_toxicity_of_repeated_ids_learns_one_text(spark):
    docs, labels = labelled_corpus(spark, 200)
    many = docs.union(docs).union(docs.withColumn("text", F.concat(F.col("text"), F.lit(" zz"))))
    once, thrice = toxicity.fit(docs, labels), toxicity.fit(many, labels)
    texts = [r["text"] for r in docs.limit(50).collect()]
    assert np.allclose(once.scores(texts), thrice.scores(texts))


def test_max_plus_is_associative():
    a, b, c = np.random.default_rng(0).integers(-9, 0, (3, 4, 4)).astype(float)
    p = piece_codec.max_plus
    assert (p(p(a, b), c) == p(a, p(b, c))).all()


def labelled_corpus(spark, n=900):
    """Clean prose, junk of repeated words, and insults here and there."""
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(n):
        w = words(int(rng.integers(5, 200)), 50_000 + i)
        bad, toxic = i % 6 == 0, i % 5 == 1
        if bad:
            w = [x for y in w[:8] for x in [y] * 20]
        if toxic:
            w[int(rng.integers(len(w)))] = ["grubnik", "M0R0N!", "vlorp" + words(1, i)[0]][i % 3]
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, DDL), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, odd, empty):
    docs, labels = labelled_corpus(spark)
    got = quality.score(docs, labels)
    assert got.count() == 900 and got.where("not score between 0 and 1").count() == 0
    assert {r["doc_id"] for r in got.where("held_out").collect()} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    held = got.where("held_out").join(labels, "doc_id")
    assert held.where("predicted = quality").count() >= 0.97 * held.count()
    odd_labels = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 0), (12345, 0, 0)], labels.schema))
    assert quality.score(odd, odd_labels).count() == len(odd_documents())
    none = labels.limit(0)
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(empty, labels).count() == 0 and quality.score(empty, none).count() == 0


def test_toxicity(spark, odd, empty):
    docs, labels = labelled_corpus(spark)
    got = toxicity.score(docs, labels)
    held = got.where("held_out").join(labels, "doc_id")
    assert held.count() == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(900))
    assert held.where("predicted = 1 and toxic = 0").count() == 0
    assert held.where("predicted = 1").count() >= 0.9 * held.where("toxic = 1").count()
    odd_labels = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 0)], labels.schema))
    assert toxicity.score(odd, odd_labels).count() == len(odd_documents())
    assert {r["score"] for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score(empty, labels).count() == 0
    scored = toxicity.with_scores(odd, toxicity.fit(docs, labels), "score")
    assert scored.columns == [c for c in odd.columns if c != "score"] + ["score"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab É'’12 \t\n!▁漢"), max_size=60))
def test_encoders_equal_their_libraries(text):
    encoder, model = token_store.ByteLevelEncoder.of(BPE), piece_codec.PieceModel.of(PIECES)
    assert encoder.encode([text]) == [np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert model.encode([text]) == model._whole([text])
    parts = [np.frombuffer(x, "<i4").tolist() for x in model.encode(model.cut(text, 7))]
    assert model.joined(parts) == model.processor.encode(text)


def test_added_tokens_are_encoded_as_the_library_does():
    end = "<|endoftext|>"
    texts = [end, f"a{end}", f"word {end} word", f"{end}{end}", f"it's 12{end}\n tests", f"漢 {end}", "<|endoftext", f" {end} "]
    got = token_store.ByteLevelEncoder(BPE).encode(texts)
    assert got == [np.array(PLAIN.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert np.frombuffer(got[0], "<u4").tolist() == [PLAIN.token_to_id(end)]


def test_isotonic_is_monotone():
    from claimweave.llm.isotonic import Isotonic

    f = Isotonic(np.arange(6.0), np.array([0, 2, 1, 3, 1, 5.0]), np.full(6, 5.0))
    y = f(np.linspace(-1, 7, 50))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1
