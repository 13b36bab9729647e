"""SimHash near-duplicates through covering locality-sensitive hashing.

For a radius r every bit position of the 64-bit fingerprints carries a vector of GF(2)^(r+1) whose top coordinate is
1, and mask ``a`` keeps the positions whose vector has inner product 1 with ``a``. The vectors of r positions span at
most r dimensions, so some ``a`` is orthogonal to them all: any two fingerprints that differ in at most r bits are
equal under that mask and share a bucket of that table. There are no false negatives. The vectors are spread so that
every mask keeps 32 of 64 bits, up to radius 6.

Radius 2 needs no comparison of pairs. Fingerprints at distance 2 or less share a midpoint at distance 1 or less from
both, and all fingerprints around one midpoint are within 2 of each other, so one link from each to the smallest of
them joins exactly the right ones. The work is linear in the bucket. Texts under a wider radius are compared in
near_copies.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from claimweave.llm.common import Scratch, small_batches
from claimweave.llm.components import connected_components

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1)-2 masks over BITS positions; one more would be the whole fingerprint, which covers nothing new."""
    given = [1 << radius | i % (1 << radius) for i in range(BITS)]
    return [sum(1 << i for i, g in enumerate(given) if (g & a).bit_count() % 2) for a in range(1, 2 << radius) if a != 1 << radius]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a shorter text is one shingle, a blank one has none."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text is summed piece by piece
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text: see near_duplicates()."""
    return _majority(_hashes(text, shingle))


def fingerprints(text: str | None, shingle: int, many: int) -> list[int]:
    """``many`` fingerprints of one text: the first is fingerprint(), the others are of the same hashes, mixed anew."""
    h, out = _hashes(text, shingle), []
    for k in range(many):
        out.append(_majority(h))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, th, fp``: th is a hash of the text, fp the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def linked(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct ``fp`` -> ``(u, v)``: the component of every fingerprint that is not the smallest of its own."""
    masks = covering_masks()
    cand = fps.select(
        "fp",
        F.explode(
            F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for t, m in enumerate(masks)))
        ).alias("c")
    ).select("fp", "c.t", "c.key")
    shared = cand.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("t", "key")
    near = cand.join(shared, ["t", "key"], "left_semi")
    flips = F.lit(None)
    for t, m in enumerate(masks):
        free = [0] + [1 << i for i in range(BITS) if not m >> i & 1]
        flips = F.when(F.col("t") == t, F.array(*(F.lit(signed(x)).cast("long") for x in free))).otherwise(flips)
    mids = near.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).distinct()
    mids = scratch.table(mids, "mids")
    least = mids.groupBy("mid").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("mid", "lo")
    edges = mids.join(least, "mid").where("fp <> lo").select(F.col("fp").alias("u"), F.col("lo").alias("v"))
    return connected_components(edges, scratch)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, th, fp, component_id``, and the keeper ``keep_id, keep_th``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles of three words, repeats
    included; a bit of the fingerprint is set if it is set in over half of the shingles' XXH64 values. Fingerprints
    within two bits are linked; component_id is the smallest doc_id that links reach. Null, empty and blank texts
    have fingerprint zero and link like any other. Null doc_ids count only where a component has no other: its
    component_id is then null. Repeated rows stay repeated rows. An empty table gives an empty table; other columns
    are never read. The keeper is the row with the smallest (doc_id, hash of the text), null ids last.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(with_fingerprints(docs), "rows")
    who = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    each = scratch.table(rows.groupBy("fp").agg(F.min(who).alias("least")), "each")
    joined = each.join(
        linked(each.select("fp"), scratch), each["fp"] == F.col("u"), "left"
    ).select("fp", "least", F.coalesce("v", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("best"))
    of = joined.join(roots, "root").select(
        "fp", F.col("best.doc_id").alias("component_id"), F.col("best.doc_id").alias("keep_id"), F.col("best.th").alias("keep_th")
    )
    return rows.join(of, "fp").select("doc_id", "th", "fp", "component_id", "keep_id", "keep_th")


def keepers_only(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found(keep_id, keep_th)`` names, with all their columns.

    Of repeated rows with one doc_id and text, one stays.
    """
    keep = found.select("keep_id", "keep_th").distinct()
    mine = docs.select("*", F.xxhash64("text").alias("__th"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")) & (F.col("__th") == F.col("keep_th"))
    return mine.join(keep, on, "left_semi").dropDuplicates(["doc_id", "__th"]).drop("__th")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that near_duplicates() keeps, one for each component, with all their columns."""
    return keepers_only(docs, near_duplicates(docs))
