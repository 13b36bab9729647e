"""Approximate nearest neighbours by cosine: multi-index hashing of learned binary codes, floats reranked.

Codes are signs of the vectors under rotations that are learned (iterative quantisation) on a bounded sample, a fresh
start for each further rotation. A code is cut into substrings, and each substring of each shard has its own table.
Codes within r bits of a query's have, by the pigeonhole principle, some substring within floor(r / substrings) bits of
the query's, so probing every value that near in every table retrieves all of them. Those that are within r bits over the
whole code, and no others, are then ranked by exact cosines.

The radius is learned, too: within it lie, for the sample's vectors against the sample, all but MISS of the true
neighbours. A larger table has nearer neighbours, so there it misses less. Where a shard has fewer than k codes within
it, that query's radius grows there until k are found or the shard is exhausted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from claimweave.llm.common import Scratch, small_batches

BITS = 128
SUBSTRING = 16
TABLES = BITS // SUBSTRING
#: Rows that rotations and the radius are learned from, those with the smallest hashes.
SAMPLE = 8192
ROUNDS = 30
MISS = 0.001
SHARD = 16384
BLOCK = 8192
_AT_ONCE = 64
SEED = 20240607
_NEAR = [np.array([v for v in range(1 << SUBSTRING) if v.bit_count() <= r], np.uint16) for r in range(4)]


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, dim, x`` of the vectors that take part: not null, not zero, all components finite; x as double."""
    x = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and size(x) > 0")
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.size("x").alias("dim"), "x")


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; their largest component comes first out, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotations(units: np.ndarray, dim: int) -> np.ndarray:
    """``dim`` by BITS: orthogonal rotations that bring the sample near the corners of a cube, side by side.

    Each starts at random and alternates between the corners nearest to the rotated sample and the rotation that brings
    the sample nearest to those. Without a sample the random starts stand.
    """
    rng, parts = np.random.default_rng([SEED, dim]), []
    while sum(p.shape[1] for p in parts) < BITS:
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(ROUNDS if len(units) else 0):
            u, _, v = np.linalg.svd(units.T @ np.sign(units @ turn))
            turn = u @ v
        parts.append(turn)
    return np.hstack(parts)[:, :BITS]


def codes(units: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """BITS signs of each row as TABLES substrings of 16 bits."""
    return np.packbits(units @ turn > 0, axis=1, bitorder="little").view(np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which codes differ, row by row."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1, dtype=np.int64)


def cosines(q: np.ndarray, q_size: float, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cosines with each row of x, each summed component after component, so that equal vectors have equal ones."""
    return np.cumsum(x * q, axis=1)[:, -1] / (q_size * sizes)


def _sizes(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])


def learned_radius(units: np.ndarray, own: np.ndarray, k: int) -> int:
    """The radius within which all but MISS of the sample's k nearest pairs lie; BITS where there is nothing to learn from."""
    apart = []
    for at in range(0, len(units), 512):
        near = units[at : at + 512] @ units.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        top = np.argpartition(-near, min(k, len(units) - 1), axis=1)[:, : min(k, len(units) - 1)]
        for i, best in enumerate(top):
            apart.append(distances(np.repeat(own[at + i : at + i + 1], len(best), 0), own[best]))
    found = np.concatenate(apart) if apart else np.zeros(0)
    return int(np.quantile(found, 1 - MISS, method="higher")) if len(found) else BITS


class Model:
    """What is learned for one length of vectors: the rotation and the radius."""

    def __init__(self, sample: np.ndarray, dim: int, k: int):
        units = _units(sample) if len(sample) else np.zeros((0, dim))
        self.turn = rotations(units, dim)
        self.radius = learned_radius(units, codes(units, self.turn), k) if len(units) > 1 else BITS


def _much(met: np.ndarray) -> bool:
    """Whether a sixteenth was retrieved: then whole columns are cheaper to work on than what was picked from them."""
    return int(met.sum()) * 16 > met.size


class Shard:
    """Codes, floats and one table per substring: the values there are, in order, and the rows that have each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, own: np.ndarray):
        self.ids, self.x, self.own, self.sizes = ids, x, own, _sizes(x)
        self.tables = []
        for t in range(TABLES):
            order = np.argsort(own[:, t], kind="stable").astype(np.int32)
            values, starts = np.unique(own[order, t], return_index=True)
            self.tables.append((order, values, np.append(starts, len(order))))

    @classmethod
    def of(cls, rows: pd.DataFrame, dim: int) -> "Shard":
        joined = lambda c, kind, n: np.frombuffer(b"".join(rows[c]), kind).reshape(-1, n)
        return cls(rows["vec_id"].to_numpy(), joined("x", np.float64, dim), joined("code", np.uint16, TABLES))

    def probed(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """Rows by queries: which codes are within ``radius`` bits, retrieved by substring, then held to the whole code.

        Up to radius = each * TABLES + more bits, either one of the first more + 1 substrings differs in at most ``each``
        bits, or one of the others in fewer. A table is looked up value by value while those are fewer than its rows;
        beyond that it is read through.
        """
        each, more = divmod(min(radius, BITS), TABLES)
        met = np.zeros((len(self.ids), len(asked)), bool)
        for t, (order, values, starts) in enumerate(self.tables):
            reach = each if t <= more else each - 1
            if reach < 0:
                continue
            if reach >= len(_NEAR) or len(_NEAR[reach]) > len(values) // 8:
                met |= np.bitwise_count(self.own[:, t, None] ^ asked[None, :, t]) <= reach
                continue
            for i, code in enumerate(asked[:, t]):
                wanted = np.sort(_NEAR[reach] ^ code)
                at = np.searchsorted(values, wanted)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == wanted)]
                for first, last in zip(starts[at].tolist(), starts[at + 1].tolist()):
                    met[order[first:last], i] = True
        if _much(met):
            a, b = self.own.view(np.uint64), np.ascontiguousarray(asked).view(np.uint64)
            return met & (sum(np.bitwise_count(a[:, w, None] ^ b[None, :, w]).astype(np.int16) for w in range(a.shape[1])) <= radius)
        rows, columns = np.nonzero(met)
        met[rows, columns] = distances(self.own[rows], asked[columns]) <= radius
        return met

    def nearest(self, qids: np.ndarray, q: np.ndarray, asked: np.ndarray, radius: int, k: int) -> Iterator[tuple[int, int, float]]:
        """(query, candidate, cosine) of each query's k best within the radius, or within the least that holds k."""
        for at in range(0, len(qids), _AT_ONCE):
            here = slice(at, at + _AT_ONCE)
            yield from self._some(qids[here], q[here], asked[here], radius, k)

    def _some(self, qids: np.ndarray, q: np.ndarray, asked: np.ndarray, radius: int, k: int) -> Iterator[tuple[int, int, float]]:
        met = self.probed(asked, radius) & (self.ids[:, None] != qids[None])
        few = met.sum(axis=0) < k
        if few.any() and radius < BITS:
            yield from self._some(qids[few], q[few], asked[few], radius + TABLES, k)
            met, qids, q = met[:, ~few], qids[~few], q[~few]
        if not len(qids):
            return
        sizes = _sizes(q)
        dense = _much(met)
        rough = self.x @ q.T if dense else None  # in one product where much was retrieved
        for i in range(len(qids)):
            rows = np.flatnonzero(met[:, i])
            about = (rough[rows, i] if dense else self.x[rows] @ q[i]) / (self.sizes[rows] * sizes[i])
            if len(rows) > k:
                rows = rows[about >= np.partition(about, -k)[-k] - 1e-9]
            score = cosines(q[i], sizes[i], self.x[rows], self.sizes[rows])
            for j in np.lexsort((self.ids[rows], -score))[:k]:
                yield int(qids[i]), int(self.ids[rows[j]]), float(score[j])


def learned(vectors: DataFrame, k: int) -> dict[int, Model]:
    """A model for each length in the sample: SAMPLE rows at most, by the hash of id and components."""
    some = vectors.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).select("dim", "x").toPandas()
    return {int(dim): Model(np.stack(rows["x"].to_list()), int(dim), k) for dim, rows in some.groupby("dim")}


def coded(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """``vectors(vec_id, dim, x)`` with x as bytes and ``code``; lengths without a model have random rotations."""
    small_batches(vectors.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = {dim: m.turn for dim, m in models.items()}
        for part in parts:
            for dim, rows in part.groupby("dim"):
                if dim not in turns:
                    turns[dim] = rotations(np.zeros((0, dim)), int(dim))
                x = np.stack(rows["x"].to_list())
                own = codes(_units(x), turns[dim])
                yield pd.DataFrame({"vec_id": rows["vec_id"], "dim": rows["dim"], "x": [v.tobytes() for v in x], "code": [c.tobytes() for c in own]})

    return vectors.mapInPandas(run, "vec_id long, dim int, x binary, code binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its k nearest found among ``vectors`` (as usable() gives).

    Nearness is the largest cosine, in double precision on the original components; ties go to the smaller id. A
    query's own id is no candidate, and vectors of another length are none. Each query gets k rows, or all candidates if
    there are fewer. Vectors null, empty, zero, or with null or non-finite components, and null ids, take no part. Of
    repeated ids each row is a candidate of its own; repeated query rows share one ranking. Empty tables give none.

    Every vector is indexed. Vectors are dealt once into shards of some ``shard`` rows, each a full multi-index with its
    floats; blocks of queries meet each shard in a task of bounded size. Queries are copied once for a shard, shards once
    for ``block`` queries.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    parts, scratch = int(spark.conf.get("spark.sql.shuffle.partitions")), Scratch(spark, "nearest")
    models = learned(vectors, k)
    rows = scratch.table(coded(vectors, models), "codes")
    asked = scratch.table(coded(queries.dropDuplicates(["vec_id", "x"]), models), "queries")
    n = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    m = asked.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    size = n.join(m, "dim")
    each = lambda c, i: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(i)
    deal = lambda c: F.pmod(F.xxhash64("vec_id", "x"), F.col(c)).cast("int")
    left = rows.join(size, "dim").select("dim", deal("shards").alias("shard"), each("blocks", "block"), "vec_id", "x", "code")
    right = asked.join(size, "dim").select("dim", each("shards", "shard"), deal("blocks").alias("block"), "vec_id", "x", "code")
    radius = {dim: model.radius for dim, model in models.items()}

    def run(key: tuple, held: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(held) and len(some):
            dim = int(key[0])
            q, asked = (np.frombuffer(b"".join(some[c]), kind).reshape(len(some), -1) for c, kind in (("x", np.float64), ("code", np.uint16)))
            found += Shard.of(held, dim).nearest(some["vec_id"].to_numpy(), q, asked, radius.get(dim, BITS), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    task = ["dim", "shard", "block"]
    # Dealt by number, since a group's bytes say little of its work.
    both = left.repartition(parts, *task).groupBy(*task).cogroup(right.repartition(parts, *task).groupBy(*task))
    met = both.applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: Exact: the query's rows equal these where no neighbour lies outside of the radius.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS size FROM v),
     s AS (SELECT q.vec_id AS query_id, u.vec_id, list_inner_product(q.x, u.x) / (q.size * u.size) AS score
           FROM u q JOIN u ON q.vec_id <> u.vec_id AND len(q.x) = len(u.x) WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
