"""Substring dedup: windows of words that stand more than once, found by phrases that are cut by content.

Each text is parsed from left to right into phrases cut by content: the anchor of a window of WINDOW words is the
ANCHOR-gram in it with the smallest hash (the leftmost of equals), and consecutive windows with one anchor make a
phrase. Equal windows have equal anchors at equal places, whatever surrounds them, so a copied passage is cut into
the same phrases wherever it stands. All phrases of all documents are the reference: a phrase that also stands
elsewhere extends the factor whole; where a factor begins or ends, a phrase has its anchor in common with others but
not all its words, and there each of its windows is checked against the windows of all phrases with that anchor.
Phrases whose anchor stands nowhere else hold no repeated window. The result is exact up to 128-bit hashes.

The shuffles carry about one short row for twelve words; texts are shuffled twice, once to look into phrases at
factor boundaries and once to remove the spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from claimweave.llm.common import Scratch, small_batches

WINDOW = 35
ANCHOR = 8
SPAN = WINDOW - ANCHOR + 1  # anchors to choose from in a window, and at most so many windows in a phrase
PIECE = 1 << 20  # words whose windows are handled at once
_LOW = np.uint64(PIECE - 1)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _M1 + b)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, from the words' hashes."""
    m, power, size, done, out = len(h) - n + 1, h, 1, 0, None
    while done < n:
        if n & size:
            part = power[done : done + m]
            out = part if out is None else _join(out, part)
            done += size
        if done < n:
            power = _join(power[:-size], power[size:])
            size *= 2
    return out


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _windows(words: list[bytes]) -> np.ndarray:
    """Hash of every window."""
    return _grams(_word_hashes(words), WINDOW)


def phrases(words: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (anchor hash, phrase hash, first window, number of windows) for the pieces of one text, in order."""
    step = PIECE - WINDOW
    for at in range(0, len(words) - WINDOW + 1, step):
        h = _word_hashes(words[at : at + step + WINDOW - 1])
        keys, wins = _grams(h, ANCHOR), _grams(h, WINDOW)
        v = (keys & ~_LOW) | np.arange(len(keys), dtype=np.uint64)
        least, size = v, 1
        while size * 2 <= SPAN:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if size < SPAN:
            least = np.minimum(least[: -(SPAN - size)], least[SPAN - size :])
        place = least & _LOW
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        last = np.concatenate((first[1:], [len(place)])) - 1
        p = place[first]
        shape = (last - first).astype(np.uint64) * _M3 + (p - first.astype(np.uint64))
        yield keys[p.astype(np.int64)], _join(_join(wins[first], wins[last]), _mix(shape + _M1)), first + at, last - first + 1


#: What tells rows apart: the id, -1 for null, and a hash of the text that also tells null ids from -1.
ROW = ["id", "th"]


def _identified(docs: DataFrame, id_name: str = "id", th_name: str = "th") -> list[Column]:
    own = F.col("doc_id").cast("long")
    return [F.coalesce(own, F.lit(-1)).alias(id_name), F.xxhash64("text", own.isNull()).alias(th_name)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_identified(docs), "text")


def _parse(docs: DataFrame) -> DataFrame:
    """One row per phrase: id, th, key, run, i0 (first window), n (windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, owner = [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                words = (t or "").encode().split()
                if len(words) >= WINDOW:
                    for part in phrases(words):
                        parts.append(part)
                        owner.append(np.full(len(part[0]), k))
            if parts:
                key, run_, i0, n = (np.concatenate(x) for x in zip(*parts))
                own = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").take(own), b.column("th").take(own), pa.array(key.view(np.int64)), pa.array(run_.view(np.int64)),
                        pa.array(i0.astype(np.int64)), pa.array(n.astype(np.int32))
                    ],
                    ["id", "th", "key", "run", "i0", "n"]
                )

    return _rows(docs).drop("doc_id").mapInArrow(run, "id long, th long, key long, run long, i0 long, n int")


def _look_inside(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs(id, th, key, run, c, i0, n)`` -> one row per window: key, run, c, o (its place in the phrase), h."""
    per = runs.groupBy(*ROW).agg(F.collect_list(F.struct("key", "run", "c", "i0", "n")).alias("runs"))
    # A repeated row is looked into once; the join's own partitions and order serve that, too.
    both = _rows(docs).join(per, ROW).dropDuplicates(ROW).select("text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                words = t.encode().split()
                for r in runs:
                    h = _windows(words[r["i0"] : r["i0"] + r["n"] + WINDOW - 1])
                    for x, y in zip(out, ([r["key"]] * r["n"], [r["run"]] * r["n"], [r["c"]] * r["n"], range(r["n"]), h.view(np.int64).tolist())):
                        x.extend(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["key", "run", "c", "o", "h"]
            )

    return both.mapInArrow(run, "key long, run long, c long, o int, h long")


def repeated_windows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, th, spans``: spans lists (i0, mask) with bit o of mask set if window i0 + o also stands elsewhere.

    Repeated rows count as often as they stand, but share one list of spans.
    """
    small_batches(docs.sparkSession)
    occ = scratch.table(_parse(docs), "phrases")
    # The small side of each join is written first: Spark then splits a hot key's partition, which it cannot do where
    # the join and the aggregation that made the small side are one stage.
    keys = scratch.table(occ.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "keys")
    shared = scratch.table(occ.join(keys, "key", "left_semi"), "shared")
    scratch.drop("phrases")
    runs = shared.groupBy("key", "run").agg(F.count("*").alias("c"), F.min(F.struct(*ROW, "i0", "n")).alias("at"))
    runs = scratch.table(runs.select("key", "run", "c", "at.*"), "runs")
    edges = scratch.table(runs.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "edges")
    inside = scratch.table(_look_inside(docs, runs.join(edges, "key", "left_semi")), "inside")
    twice = scratch.table(inside.groupBy("key", "h").agg(F.sum("c").alias("s")).where("s > 1").select("key", "h"), "twice")
    part = inside.where("c = 1").join(twice, ["key", "h"], "left_semi").groupBy("key", "run").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("mask"))
    full = runs.where("c > 1").select("key", "run", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    found = shared.join(full.unionByName(part), ["key", "run"]).groupBy(*ROW).agg(F.collect_set(F.struct("i0", "mask")).alias("spans"))
    found = scratch.table(found, "spans")
    scratch.drop("keys", "shared", "runs", "edges", "inside", "twice")
    return found


def covered(n: int, spans: list[dict]) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        for o in range(s["mask"].bit_length()):
            if s["mask"] >> o & 1:
                edge[s["i0"] + o] += 1
                edge[s["i0"] + o + WINDOW] -= 1
    return np.cumsum(edge[:n]) > 0


def without_repeats(docs: DataFrame, full: bool = True) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_words, n_removed, kept_sha256`` and ``kept`` (if full).

    Words are cut at ASCII white space and unchanged. Every word in a window of 35 that also starts anywhere else goes,
    all copies alike, judged on the input. ``kept`` is the text itself where nothing goes, else the kept words joined
    by one space; kept_sha256 is of the kept words so joined, in either case. A null text has no words and stays null.
    Texts of fewer than 35 words keep all. Repeated rows are documents of their own, so they repeat each other. Rows
    are told apart by (doc_id, hash of the text); null ids work alike. Other columns are never read. Empty table:
    empty result.
    """
    spans = repeated_windows(docs, Scratch(docs.sparkSession, "substring"))
    both = _rows(docs).join(spans, ROW, "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, kept = [], [], [], []
            for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words = (t or "").encode().split()
                n.append(len(words))
                if s:
                    out = covered(len(words), s)
                    words = [w for w, x in zip(words, out.tolist()) if not x]
                gone.append(n[-1] - len(words))
                joined = b" ".join(words)
                sha.append(hashlib.sha256(joined).hexdigest())
                if full:
                    kept.append(joined.decode() if gone[-1] else t)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * full, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * full
    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * full)


def replace_text(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, if there) replaced by what without_repeats() keeps; no row goes."""
    found = repeated_windows(docs, Scratch(docs.sparkSession, "substring")).toDF("__id", "__th", "__spans")
    both = docs.select("*", *_identified(docs, "__id", "__th")).join(found, ["__id", "__th"], "left").select(*docs.columns, "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for t, s in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist()):
                if s:
                    words = t.encode().split()
                    t = b" ".join(w for w, x in zip(words, covered(len(words), s).tolist()) if not x).decode()
                kept.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.string()) if n == "text" else c for n, c in zip(b.schema.names, b.columns) if n != "__spans"],
                [n for n in b.schema.names if n != "__spans"]
            )

    out = both.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS u(i) WHERE len(w) >= 35),
     rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
     gone AS (SELECT DISTINCT doc_id, j FROM win SEMI JOIN rep USING (h), unnest(range(i, i + 35)) AS u(j)),
     words AS (SELECT doc_id, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(j)),
     kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
