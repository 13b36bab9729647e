"""Near copies of texts: SimHash with a covering proposes pairs, the Jaccard similarity of five-word runs decides.

One fingerprint of five-word runs is no use as a filter: texts of similarity 0.8 differ in some 10 of its 64 bits. The
same texts share far more of their two-word shingles, and fingerprints of those differ in 5 or so. A text has PRINTS
fingerprints, from differently mixed hashes; two texts within RADIUS bits under any of them share a bucket for certain,
and many that are somewhat further apart do, too. All links are exact.

First every member is compared with its bucket's lead, the member of most buckets. Only members that this leaves in
different components are then compared with each other, since a link between two that are joined already would change
nothing. That is done block against block: a task holds two blocks of a bucket, in a first pass their fingerprints,
which tell what pairs meet here and in no earlier table, and in a second pass the runs of those members that have such a
pair. It returns a spanning forest of the links that it finds. No pair of documents becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from claimweave.llm import simhash
from claimweave.llm.common import Scratch, small_batches
from claimweave.llm.components import connected_components
from claimweave.llm.embed_dedup import forest

SHINGLE = 5
SIMILARITY = 0.8
PRINTED = 2
PRINTS = 4
RADIUS = 4
SEED = 42
BLOCK = 512
_COLUMNS = 1024


def runs(text: str | None) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's five-word runs; a shorter text is one run, a blank one has none."""
    words = (text or "").encode().translate(simhash.LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64).view(np.int64))


def _with_prints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, th, sh, n, fps``: a hash of the set of runs, its size (0 for blank texts), PRINTS fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            sets = [runs(t) for t in texts]
            sh = np.array([xxhash.xxh64_intdigest(r.tobytes(), SEED) if len(r) else 0 for r in sets], np.uint64).view(np.int64)
            fps = [[simhash.signed(x) for x in simhash.fingerprints(t, PRINTED, PRINTS)] for t in texts]
            columns = [b.column("doc_id"), b.column("th"), pa.array(sh), pa.array(map(len, sets), pa.int32()), pa.array(fps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "sh", "n", "fps"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, sh long, n int, fps array<long>")


def _sets(docs: DataFrame, which: DataFrame) -> DataFrame:
    """``which(sh, doc_id, th)`` -> ``sh, runs``: the runs of one text of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(t) for t in b.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("sh"), lists], ["sh", "runs"])

    asked = which.select("sh", F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    texts = docs.select("doc_id", "text").join(asked, same).select("sh", "text").dropDuplicates(["sh"])
    return texts.mapInArrow(run, "sh long, runs array<long>")


def buckets(prints: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """``prints(sh, fps)`` -> ``key, t, sh, lead, size``: the members of every bucket of several, its table, and that which is in most of them."""
    masks = F.array(*(F.lit(simhash.signed(m)).cast("long") for m in simhash.covering_masks(radius)))
    dealt = prints.select("sh", F.posexplode("fps").alias("k", "fp")).select("sh", "k", "fp", F.posexplode(masks).alias("j", "m"))
    table = (F.col("k") * len(simhash.covering_masks(radius)) + F.col("j")).cast("int").alias("t")
    dealt = dealt.select("sh", table, F.xxhash64("k", "m", F.col("m").bitwiseAND(F.col("fp"))).alias("key"))
    several = dealt.groupBy("key", "t").agg(F.min("sh").alias("a"), F.max("sh").alias("z"), F.count("*").alias("size")).where("a < z")
    # The small side of each join is written first, so that Spark can split a bucket of very many members.
    met = scratch.table(dealt.join(scratch.table(several.select("key", "t", "size"), "several"), ["key", "t"]), "together")
    often = scratch.table(met.groupBy("sh").agg(F.count("*").alias("many")), "often")
    led = met.join(often, "sh").groupBy("key", "t").agg(F.max(F.struct("many", "sh")).alias("l"))
    leads = scratch.table(led.select("key", "t", F.col("l.sh").alias("lead")), "leads")
    return met.join(leads, ["key", "t"]).select("key", "t", "sh", "lead", "size")


def pairs_here(
    fps: np.ndarray, table: int, root: np.ndarray, n: np.ndarray, block: np.ndarray | None, masks: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a bucket's members that are to be compared in this table, some rows at a time.

    Those in different components, of sizes that allow the similarity, of different blocks if there are two, and not
    together in any earlier table: there they were compared, or one was the lead, whom all members are compared with.
    """
    each = len(masks)
    for at in range(0, len(n), 128):
        here = slice(at, at + 128)
        open_ = (root[here, None] != root[None]) & (5 * np.minimum(n[here, None], n[None]) >= 4 * np.maximum(n[here, None], n[None]))
        open_ &= np.arange(at, at + len(n[here]))[:, None] < np.arange(len(n))[None]
        if block is not None:
            open_ &= block[here, None] != block[None]
        i, j = np.nonzero(open_)
        i += at
        for k in range(table // each + 1):
            apart = fps[i, k] ^ fps[j, k]
            for m in masks[: table - k * each]:
                if not len(i):
                    break
                stay = apart & m != 0
                if not stay.all():
                    i, j, apart = i[stay], j[stay], apart[stay]
        if len(i):
            yield i, j


def shared_runs(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sorted sets have in common, by products of their incidence, some values at a time."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    many = np.bincount(column, minlength=len(values)) > 1
    place = many.cumsum() - 1
    row, column = row[many[column]], place[column[many[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(many.sum()), _COLUMNS):
        a, b = np.searchsorted(column, (first, first + _COLUMNS))
        x = np.zeros((len(sets), _COLUMNS), np.float32)
        x[row[a:b], column[a:b] - first] = 1
        out += x @ x.T
    return out


def compared(open_rows: DataFrame, fps: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``open_rows(key, t, sh, root, size)``, ``fps(sh, fps, n)``, ``sets(sh, runs)`` -> links ``(u, v)``, a forest of each block pair."""
    masks = np.array([simhash.signed(m) for m in simhash.covering_masks(RADIUS)], np.int64)
    parts = int(open_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = ["key", "t", "bi", "bj"]
    dealt = open_rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("sh", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "t", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"), "block", "sh", "root")

    def arrays(rows: pa.Table) -> tuple:
        n, root, block = (rows.column(c).to_numpy() for c in ("n", "root", "block"))
        prints = rows.column("fps").combine_chunks().flatten().to_numpy().reshape(len(n), PRINTS)
        bi, bj = rows.column("bi")[0].as_py(), rows.column("bj")[0].as_py()
        return prints, rows.column("t")[0].as_py(), root, n, block if bi != bj else None, masks

    def needed(rows: pa.Table) -> pa.Table:
        use = np.zeros(len(rows), bool)
        for i, j in pairs_here(*arrays(rows)):
            use[i] = use[j] = True
        return rows.filter(pa.array(use))

    def linked(rows: pa.Table) -> pa.Table:
        n, near = rows.column("n").to_numpy(), np.zeros((len(rows), len(rows)), bool)
        lists = rows.column("runs").combine_chunks()
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        common = shared_runs([values[a:b] for a, b in zip(at[:-1], at[1:])])
        for i, j in pairs_here(*arrays(rows)):
            near[i, j] = near[j, i] = 9 * common[i, j] >= 4 * (n[i] + n[j])
        sh = rows.column("sh").to_numpy()
        least = forest(near)
        far = least != np.arange(len(sh))
        return pa.table({"u": np.maximum(sh[far], sh[least[far]]), "v": np.minimum(sh[far], sh[least[far]])})

    own = "key long, t int, bi int, bj int, block int, sh long, root long, n int, fps array<long>"
    told = dealt.join(fps, "sh").select(*(c.split()[0] for c in own.split(", ")))
    some = scratch.table(told.repartition(parts, *task).groupBy(*task).applyInArrow(needed, own), "needed")
    return some.join(sets, "sh").repartition(parts, *task).groupBy(*task).applyInArrow(linked, "u long, v long").distinct()


def alike(pairs: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(u, v)`` whose sets' Jaccard similarity is SIMILARITY or more; sizes tell most others apart."""
    size = lambda p: sizes.select(F.col("sh").alias(p), F.col("n").alias(f"{p}_n"))
    held = lambda p: sets.select(F.col("sh").alias(p), F.col("runs").alias(f"{p}_runs"))
    near = pairs.join(size("u"), "u").join(size("v"), "v").where("5 * least(u_n, v_n) >= 4 * greatest(u_n, v_n)")
    both = near.join(held("u"), "u").join(held("v"), "v")
    return both.where(9 * F.size(F.array_intersect("u_runs", "v_runs")) >= 4 * (F.col("u_n") + F.col("v_n"))).select("u", "v")


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, th``, and the keeper ``keep_id, keep_th`` of its component.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. Texts are linked where they share a bucket
    and the sets of their five-word runs have a Jaccard similarity of 0.8 or more; all blank texts link. No link of
    texts within RADIUS bits is lost; a set has the smallest fingerprints of its texts. The keeper is the row
    of all that links reach with the smallest (doc_id, hash of the text), null ids last. Repeated rows stay repeated
    rows, other columns are never read, and an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    rows = scratch.table(_with_prints(docs), "rows")
    who = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    each = scratch.table(rows.groupBy("sh").agg(F.min(who).alias("least"), F.min("n").alias("n"), F.min("fps").alias("fps")), "each")
    met = scratch.table(buckets(each.where("n > 0").select("sh", "fps"), scratch), "met")
    members = met.select("sh").distinct()
    sizes = scratch.table(each.join(members, "sh").select("sh", "n", "fps", "least.doc_id", "least.th"), "members")
    sets = scratch.table(_sets(docs, sizes), "sets")
    first = scratch.table(
        alike(met.where("sh <> lead").select(F.least("lead", "sh").alias("u"), F.greatest("lead", "sh").alias("v")).distinct(), sizes, sets), "first"
    )
    joined = connected_components(first, scratch, "first").select(F.col("u").alias("sh"), F.col("v").alias("root"))
    # A bucket's lead has been compared with all of its members, so it takes no further part in it.
    others = met.where("sh <> lead").join(joined, "sh", "left")
    placed = scratch.table(others.select("key", "t", "sh", "size", F.coalesce("root", "sh").alias("root")), "placed")
    open_ = scratch.table(
        placed.groupBy("key", "t").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key", "t"), "open"
    )
    left = scratch.table(placed.join(open_, ["key", "t"], "left_semi"), "left")
    second = scratch.table(compared(left, sizes.select("sh", "fps", "n"), sets, scratch), "second")
    links = connected_components(first.unionByName(second), scratch, "all")
    of = each.join(links, each["sh"] == F.col("u"), "left").select("sh", "least", F.coalesce("v", "sh").alias("root"))
    best = of.groupBy("root").agg(F.min("least").alias("best"))
    keep = of.join(best, "root").select("sh", F.col("best.doc_id").alias("keep_id"), F.col("best.th").alias("keep_th"))
    return rows.join(keep, "sh").select("doc_id", "th", "keep_id", "keep_th")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that near_copies() keeps, one for each component, with all their columns."""
    return simhash.keepers_only(docs, near_copies(docs))
