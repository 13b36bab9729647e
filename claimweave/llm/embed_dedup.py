"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors are one class with a count, so copies cost nothing beyond the first. A table's code is the signs of a
vector's products with BITS random hyperplanes; two vectors at cosine c agree in one sign with probability
1 - acos(c)/pi. BITS follows the number of classes, so buckets stay of one expected size, and the number of tables
follows from the miss probability allowed at the threshold. Within a bucket all pairs are compared in double precision,
block against block, so that no task holds more than two blocks; a pair that meets in several tables counts only in the
first. A block pair returns counts and a spanning forest of its links, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimweave.llm.common import Scratch, small_batches
from claimweave.llm.components import connected_components

THRESHOLD = 0.9
MISS = 0.002
BUCKET = 512
BLOCK = 2048
SEED = 20240607


def shape(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / BUCKET)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; their largest component comes first out, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vec_id, x, h, g`` of the vectors that can link, with 128 bits that tell different ones apart; the other ids."""
    x = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0)
    fine = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    return rows.where(fine).select(
        "vec_id", "x", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g")
    ), rows.where(~fine).select("vec_id")


def _coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``classes(c, x)`` -> ``c, dim, codes, payload``: a code for each table; payload is the vector's bytes and the codes'."""
    whole = np.int32 if bits < 32 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, values = b.column("x").value_lengths().to_numpy(), b.column("x").flatten().to_numpy()
            at = np.concatenate(([0], np.cumsum(size)))
            for dim in np.unique(size):  # one length, but for odd tables
                mine = np.flatnonzero(size == dim)
                x = values[at[mine][:, None] + np.arange(dim)]
                planes = np.random.default_rng([SEED, int(dim)]).standard_normal((tables * bits, int(dim)))
                signs = (_units(x.astype(np.float64)) @ planes.T > 0).reshape(len(mine), tables, bits)
                codes = (signs @ (1 << np.arange(bits, dtype=np.int64))).astype(whole)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
                payload = np.hstack([np.ascontiguousarray(x).view(np.uint8), codes.view(np.uint8)])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("c").take(pa.array(mine)), pa.array(np.full(len(mine), dim, np.int32)), lists,
                        pa.array([p.tobytes() for p in payload], pa.binary())
                    ],
                    ["c", "dim", "codes", "payload"]
                )

    return classes.select("c", "x").mapInArrow(run, f"c long, dim int, codes array<{'int' if bits < 32 else 'long'}>, payload binary")


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index that each index reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(key: tuple, rows: pd.DataFrame, threshold: float, real: type, whole: type) -> pd.DataFrame:
    """Links of one block pair: a row (c, other, links) per class with links; other is its tree's smallest class."""
    dim, table, _, bi, bj = key
    rows = rows.sort_values("c", kind="stable")
    ids, block, many = (rows[k].to_numpy() for k in ("c", "block", "n"))
    raw = np.frombuffer(b"".join(rows["payload"]), np.uint8).reshape(len(rows), -1)
    cut = dim * np.dtype(real).itemsize
    x, codes = _units(raw[:, :cut].copy().view(real).astype(np.float64)), raw[:, cut:].copy().view(whole)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if bi != bj:
        near &= block[:, None] != block[None, :]
    for t in range(table):  # met in an earlier table already
        near &= codes[:, t][:, None] != codes[:, t][None, :]
    has = near.any(axis=1)
    near, ids, many = near[np.ix_(has, has)], ids[has], many[has]
    return pd.DataFrame({"c": ids, "other": ids[forest(near)], "links": near @ many})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Pairs with cosine of at least ``threshold`` in double precision are linked; none below is. At the threshold a
    link is missed with probability ``miss``, less above it; equal vectors always link. Vectors null, empty, zero, or
    with null or non-finite components link with nothing and are their own component; so do null ids, whose
    component_id and kept are null. Vectors of different length never link. Repeated ids are vectors of their own,
    with links of their own. Other columns are never read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    small_batches(spark)
    usable, others = _usable(vectors)
    same = usable.groupBy("h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("x").alias("x"))
    classes = scratch.table(same.withColumn("c", F.monotonically_increasing_id()), "classes")  # written, so numbers stay
    bits, tables = shape(classes.count(), threshold, miss)
    real = np.float32 if classes.schema["x"].dataType.simpleString() == "array<float>" else np.float64
    coded = scratch.table(_coded(classes, bits, tables), "coded")
    met = coded.select("c", "dim", F.posexplode("codes").alias("t", "code"))
    counts = met.groupBy("t", "dim", "code").agg(F.count("*").alias("n")).where("n > 1")
    blocks = scratch.table(counts.select("t", "dim", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "blocks")
    # Ids and codes only until it is known which block pairs there are; then each vector goes to its own.
    placed = met.join(blocks, ["t", "dim", "code"]).withColumn("block", F.pmod(F.xxhash64("c", F.lit(1)), F.col("k")).cast("int"))
    pairs = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    keys = ["dim", "t", "code", "bi", "bj"]
    pairs = pairs.select("c", "dim", "t", "code", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"), "block")
    wide = pairs.join(coded.select("c", "payload"), "c").join(classes.select("c", "n"), "c").select(*keys, "block", "c", "n", "payload")
    # By all keys: by the bucket alone, a bucket's block pairs would share one task.
    dealt = wide.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    whole = np.int32 if bits < 32 else np.int64
    found = dealt.groupBy(*keys).applyInPandas(lambda key, rows: _compare(key, rows, threshold, real, whole), "c long, other long, links long")
    found = scratch.table(found, "links")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("c").alias("u"), F.col("other").alias("v")), scratch)
    each = classes.select("h", "g", "c", "n", "least").join(links, "c", "left").join(
        roots.select(F.col("u").alias("c"), F.col("v").alias("root")), "c", "left"
    )
    each = scratch.table(
        each.select("h", "g", "least", F.coalesce("root", "c").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
        "each"
    )
    each = scratch.table(
        each.join(each.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h", "g", "n_links", "component_id"), "told"
    )
    linked = usable.select("vec_id", "h", "g").join(each, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("component_id") == F.col("vec_id"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS size FROM v),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
           WHERE list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.9),
     r AS (SELECT vec_id, vec_id AS to_id FROM u UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.to_id = l.a),
     c AS (SELECT vec_id, min(to_id) AS component_id FROM r GROUP BY vec_id),
     n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
