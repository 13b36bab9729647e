"""Exact top-k search by inner product over an impact-ordered index.

The candidates are dealt once into shards. A shard's index holds posting segments by the quantised size of a component:
segment L has, for every dimension, the postings (vector, component) whose component is at most 2^-L but over 2^-(L+1)
of the shard's largest. The index is built once and written. Blocks of queries are scored score-at-a-time: segment by
segment in descending impact, every posting once. After a segment, what is left of a vector is known only by its norm,
so its score lies within |query| * norm of what it has gathered; the k-th best lower end is the threshold, and a vector
whose upper end falls below it is proved out. A query stops when few vectors are left or segments run out, and those
left are rescored exactly from the integers. Stopping early changes the cost, never the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from claimweave.llm.common import Scratch, small_batches

SHARD = 16384
BLOCK = 8192
SEGMENTS = 8
SCALE = 256
_AT_ONCE = 64


def integers(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, dim, v``: components floor(256 * x), x as double, of the vectors that take part."""
    x = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and size(x) > 0")
    fine = rows.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    return fine.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))


class ImpactIndex:
    """Posting segments of integer vectors in order of descending impact.

    ``segments`` lists (starts, rows, values): dimension d of a segment has the postings starts[d] to starts[d + 1].
    """

    def __init__(self, ids: np.ndarray, segments: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.ids, self.segments = ids, segments
        self.x = np.zeros((len(ids), len(segments[0][0]) - 1))
        for starts, rows, values in segments:
            self.x[rows, np.repeat(np.arange(len(starts) - 1), np.diff(starts))] = values
        rest, self.left = (self.x**2).sum(axis=1), []
        for _, rows, values in segments:
            rest = rest - np.bincount(rows, values.astype(np.float64) ** 2, len(ids))
            self.left.append(np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + 1e-6)
        self.left[-1] = np.zeros(len(ids))

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> "ImpactIndex":
        """Index the rows of x, in order of their ids."""
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        size = np.abs(x.astype(np.float64))
        impact = np.clip(np.floor(-np.log2(np.maximum(size, 1e-300) / (size.max(initial=0) or 1.0))), 0, SEGMENTS - 1)
        segments = []
        for s in range(SEGMENTS):
            dims, rows = np.nonzero(((impact == s) & (x != 0)).T)
            segments.append((np.searchsorted(dims, np.arange(x.shape[1] + 1)), rows.astype(np.int32), x[rows, dims]))
        return cls(ids, segments)

    def packed(self) -> Iterator[tuple]:
        """Rows (segment, ids, starts, rows, values) as bytes; read() makes the index of them again."""
        for s, (starts, rows, values) in enumerate(self.segments):
            small = len(values) and np.abs(values).max() >= 1 << 31
            yield s, self.ids.tobytes() if not s else b"", starts.astype(np.int32).tobytes(), rows.tobytes(), values.astype(
                np.int64 if small else np.int32
            ).tobytes()

    @classmethod
    def read(cls, stored: pd.DataFrame) -> "ImpactIndex":
        stored, segments = stored.sort_values("segment"), []
        for starts, rows, values in zip(stored["starts"], stored["rows"], stored["vals"]):
            at = np.frombuffer(rows, np.int32)
            segments.append((np.frombuffer(starts, np.int32), at, np.frombuffer(values, np.int32 if len(values) == 4 * len(at) else np.int64)))
        return cls(np.frombuffer(stored["ids"].iloc[0], np.int64), segments)

    def search(self, qid: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query, candidate, score) of each query's k best, ties to smaller ids; a query never finds itself."""
        for at in range(0, len(q), _AT_ONCE):
            yield from self._some(qid[at : at + _AT_ONCE], q[at : at + _AT_ONCE].astype(np.float64), k)

    def _some(self, qid: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        norm = np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
        got = np.zeros((len(self.ids), len(q)))
        own = self.ids[:, None] == qid[None, :]
        for s, (starts, rows, values) in enumerate(self.segments):
            for d in np.flatnonzero(np.diff(starts)):
                here = slice(starts[d], starts[d + 1])
                got[rows[here]] += values[here, None] * q[None, :, d]
            last = s == len(self.segments) - 1
            if s < 2 and not last:
                continue
            slack = self.left[s][:, None] * norm[None, :]
            low = np.where(own, -np.inf, got - slack)
            k_th = np.partition(low, -k, axis=0)[-k] if len(low) > k else np.full(len(q), -np.inf)
            possible = (got + slack >= k_th - 1e-6) & ~own
            few = possible.sum(axis=0) <= 16 * k
            done = np.flatnonzero(few | last)
            for i in done:
                at = np.flatnonzero(possible[:, i])
                score = self.x[at] @ q[i]
                for j in np.lexsort((self.ids[at], -score))[:k]:
                    yield int(qid[i]), int(self.ids[at[j]]), int(score[j])
            if len(done) == len(q):
                return
            if len(done):
                got, own, q, qid, norm = got[:, ~few], own[:, ~few], q[~few], qid[~few], norm[~few]


def build_index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """``vectors(vec_id, dim, v)`` -> posting segments ``dim, shard, shards, segment, ids, starts, rows, vals``."""
    n = vectors.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = vectors.join(n, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        index = ImpactIndex.of(rows["vec_id"].to_numpy(), np.stack(rows["v"].to_list()))
        out = pd.DataFrame(index.packed(), columns=["segment", "ids", "starts", "rows", "vals"])
        return out.assign(dim=key[0], shard=key[1], shards=rows["shards"].iloc[0])[["dim", "shard", "shards", *out.columns]]

    # Dealt by number here and below, since a small group's bytes say little of its work.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(parts, "dim", "shard").groupBy("dim", "shard")
    return grouped.applyInPandas(run, "dim int, shard int, shards int, segment int, ids binary, starts binary, rows binary, vals binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its k best among ``vectors`` (both as integers() gives).

    All candidates take part but those with the query's own id; ties go to the smaller id, and a query with fewer
    candidates gets all of them. Vectors null, empty, or with null or non-finite components, and null ids, take no
    part; vectors of another length than the query's have no inner product with it. Of repeated ids each row is a
    candidate and a query of its own but shares one ranking. Scores are exact below 2^53. Empty tables give none.
    Each shard's index meets each block of queries in one task of bounded size: candidates are copied once for a
    block, queries once for a shard.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = Scratch(spark, "topk").table(build_index(vectors, shard), "index")
    m = queries.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    each = lambda c, i: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(i)
    left = index.join(m, "dim").select("dim", "shard", each("blocks", "block"), "segment", "ids", "starts", "rows", "vals")
    asked = queries.join(m, "dim").join(index.select("dim", "shards").distinct(), "dim")
    right = asked.select("dim", each("shards", "shard"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v")

    def run(stored: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        found = ImpactIndex.read(stored).search(some["vec_id"].to_numpy(), np.stack(some["v"].to_list()), k) if len(stored) and len(some) else ()
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    task = ["dim", "shard", "block"]
    both = left.repartition(parts, *task).groupBy(*task).cogroup(right.repartition(parts, *task).groupBy(*task))
    met = both.applyInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v::DOUBLE[], v.v::DOUBLE[])::BIGINT AS score
           FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.v) = len(v.v)),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
