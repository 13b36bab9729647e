"""Periodic runs of words: Lyndon words by a stack, extended by common extensions from rolling hashes.

Every run has a root that is the longest Lyndon word at its place, under one of the two orders of the words. So the
text is scanned right to left under both orders with a stack of suffixes; the word from a place to the next smaller
suffix is the longest Lyndon word there, and each such word is extended to both sides as far as its period holds. Two
places are compared by a binary search over rolling hashes; what the hashes say is checked word for word, each stretch
once. No suffix array is built.

A run of at least 12 words and two periods consists of six-word sequences that stand twice in the document, at one
period's distance. So only stretches of words that repeated six-word sequences cover are scanned, and all runs are in
those.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimweave.llm.common import small_batches

LEAST = 12
_HALF = LEAST // 2
_PRIME, _BASE, _SEED = (1 << 61) - 1, 911_382_323_874_311, 20240607
RUNS = "array<struct<start:long,length:long,period:long>>"


class Extensions:
    """How far equal words go on, to the right and to the left, from two places of a sequence of small integers.

    What is known of a distance is kept: the stretch of places whose words equal those so far on. Stretches that hashes
    found are compared word for word before they are used.
    """

    def __init__(self, words: list[int]):
        self.w, self.n, self.array = words, len(words), np.array(words, np.int64)
        self.hash, self.power, self.known = [0], [1], {}
        h, p = 0, 1
        for x in words:
            h = (h * _BASE + x + 1) % _PRIME
            p = p * _BASE % _PRIME
            self.hash.append(h)
            self.power.append(p)

    def _same(self, i: int, j: int, k: int) -> bool:
        h, p = self.hash, self.power[k]
        return (h[i + k] - h[i] * p - h[j + k] + h[j] * p) % _PRIME == 0

    def _longest(self, fits: Callable[[int], bool], most: int) -> int:
        """The largest k up to ``most`` for which ``fits``, which holds up to some k: doubling, then halving."""
        low, step = 0, 8
        while low + step <= most and fits(low + step):
            low, step = low + step, step * 2
        high = min(low + step, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if fits(middle) else (low, middle)
        return low

    def _checked(self, i: int, j: int, k: int) -> bool:
        return bool((self.array[i : i + k] == self.array[j : j + k]).all())

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        w, d = self.w, j - i
        if j >= self.n or w[i] != w[j]:
            return 0
        low, high, _ = self.known.get(d, (0, 0, False))
        if low <= i < high:
            return high - i
        if i == low - 1:
            self.known[d] = (i, high, False)
            return high - i
        k = self._longest(lambda k: self._same(i, j, k), self.n - j)
        if not self._checked(i, j, k):
            k = int(np.argmin(self.array[i : i + k] == self.array[j : j + k]))
        self.known[d] = (i, i + k, False)
        return k

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        w, d = self.w, j - i
        if not i or w[i - 1] != w[j - 1]:
            return 0
        low, high, ended = self.known.get(d, (0, 0, False))
        if ended and low < i <= high:
            return i - low
        k = self._longest(lambda k: self._same(i - k, j - k, k), i)
        if not self._checked(i - k, j - k, k):
            k = int(np.argmin((self.array[i - k : i] == self.array[j - k : j])[::-1]))
        self.known[d] = (i - k, high if low <= i <= high and low < high else i, True)
        return k


def _scanned(words: list[int]) -> set[tuple[int, int, int]]:
    """All runs (start, length, period) of LEAST words or more of a sequence."""
    n, reach, found = len(words), Extensions(words), set()
    for smaller in (int.__lt__, int.__gt__):
        stack: list[int] = []
        for i in range(n - 1, -1, -1):
            k = 0
            while stack:
                j = stack[-1]
                k = reach.right(i, j)
                if j + k == n or not smaller(words[i + k], words[j + k]):
                    break
                stack.pop()
                k = 0
            j = stack[-1] if stack else n
            stack.append(i)
            before = reach.left(i, j)
            if before + k >= j - i and (length := j - i + before + k) >= LEAST:
                found.add((i - before, length, j - i))
    return found


def _stretches(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches that repeated sequences of six words cover; more may be covered, never less."""
    n = len(ids) - _HALF + 1
    if len(ids) < LEAST:
        return
    mixed = np.zeros(n, np.uint64)
    for k in range(_HALF):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : n + k].astype(np.uint64) + np.uint64(1)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + _HALF, -1)
    inside = np.concatenate(([False], cover.cumsum()[:-1] > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    yield from ((int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= LEAST)


def runs(words: list) -> list[tuple[int, int, int]]:
    """Every maximal run (start, length, smallest period) of at least 12 words and two periods, by start, then period."""
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = {(a + s, length, p) for a, b in _stretches(ids) for s, length, p in _scanned(ids[a:b].tolist())}
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    return cover.cumsum()[:-1] == 0


def planted(doc_id: int | None, words: list) -> list:
    """A tenth of the documents, by crc32 of the id, with a periodic end: see the query. Null ids are left as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(len(words) - a) // p)))[: len(words) - a]


def collapsed(docs: DataFrame, before: Callable[[int | None, list], list] | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_words, runs, text``, in the text each run once.

    Words are what ASCII white space separates, in the whole text; null and blank texts have none. ``runs`` lists every
    run of at least 12 words and two periods; the text keeps the words outside of runs and each run's first period,
    joined by single blanks. ``before`` may change a document's words first. Repeated rows stay repeated rows, null ids
    too; an empty table gives an empty table; columns of other names are never read. A text is one task's work.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            sizes, found, texts = [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words = (text or "").encode().split()
                words = before(doc_id, words) if before else words
                mine = runs(words)
                if mine:
                    words_kept = [w for w, k in zip(words, kept(len(words), mine).tolist()) if k]
                else:
                    words_kept = words
                sizes.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
                texts.append(b" ".join(words_kept))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(entry)), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "text"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, n_words long, runs {RUNS}, text string"
    )


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run (ties: smallest start, then period) and digests of all runs and of the text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    said = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    one = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256")
    )
    start, length, period = -F.col("b.s"), F.col("b.n"), -F.col("b.p")
    return one.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * b.n div -b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
