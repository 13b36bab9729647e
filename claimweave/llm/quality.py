"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts turns each into a short vector of statistics. Cosines of random projections of the
standardised vectors approximate a Gaussian kernel; ridge scores come from normal equations that each partition sums
for itself; the scores are calibrated on training rows that the equations did not see.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from claimweave.llm.common import Scratch, small_batches
from claimweave.llm.isotonic import Isotonic

FOLDS = 5
THRESHOLD = 0.3
FEATURES = 256
RIDGE = 1e-4
SEED = 7
SUM_PARTITIONS = 16  # matrices of (FEATURES + 1)^2 doubles that reach the driver
BINS = 400
_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"()-", b"!?", b"|", b"%&$#*@^~=+<>/\\_{}[]`"
)
_KIND = np.zeros(256, np.uint8)
for _k, _c in enumerate(_CLASSES, 1):
    _KIND[list(_c)] = _k
N_STATS = len(_CLASSES) + 1 + 9


def statistics(text: str | None) -> list[float]:
    """Statistics of the whole text; all zero for a null or empty one."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * N_STATS
    data = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_KIND[data], minlength=len(_CLASSES) + 1) / len(raw)
    n, lines = len(words), [x for x in raw.split(b"\n") if x]
    count = Counter(words)
    share = np.bincount(data, minlength=256)
    share = share[share > 0] / len(raw)
    repeated = sum(map(eq, words, words[1:])) / n
    dup_lines = 1 - len(set(lines)) / max(1, len(lines))
    upper = kinds[2] / max(1e-9, kinds[1] + kinds[2])
    return [
        *kinds.tolist(), float(np.log1p(n)), len(raw) / n, len(count) / n, max(count.values()) / n, repeated, dup_lines,
        float(np.log1p(n / max(1, len(lines)))), float(-(share * np.log(share)).sum()), float(upper)
    ]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``rows`` with a column ``label`` (0 or 1) for ids that have one; repeated ids take their largest label."""
    one = labels.where(
        F.col(label).isNotNull() & F.col("doc_id").isNotNull()
    ).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("double").alias("label"))
    return rows.join(one, "doc_id")


class KernelRidge:
    """Standardisation, random features, ridge weights and calibration: small arrays that tasks can carry."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = draw.standard_normal((len(mean), FEATURES)) / np.sqrt(len(mean) / 2)
        self.b = draw.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.calibrate = Isotonic(np.zeros(0), np.zeros(0), np.zeros(0))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("f").values.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, N_STATS))


def _packed(n: int, g: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([g.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["n", "g", "c"])


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, f`` for each row of ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f array<double>")


def fit(rows: DataFrame) -> KernelRidge:
    """Fit on ``rows(doc_id, f, label)``, a quarter of which is set aside for calibration.

    Without rows every score is 0.5; with rows of one label only, scores are that label.
    """
    first = rows.select(*(g(F.col("f")[i]).alias(f"{n}{i}") for n, g in (("m", F.avg), ("s", F.stddev_pop)) for i in range(N_STATS))).first()
    value = lambda n: np.array([first[f"{n}{i}"] or 0.0 for i in range(N_STATS)])
    model = KernelRidge(value("m"), value("s"))
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        n = 0
        for b in batches:
            z = model.features(_matrix(b))
            g += z.T @ z
            c += z.T @ b.column("label").to_numpy()
            n += len(z)
        yield _packed(n, g, c)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for b in batches:
            for row in b.to_pylist():
                n, g, c = n + row["n"], g + np.frombuffer(row["g"]).reshape(g.shape), c + np.frombuffer(row["c"])
        yield _packed(n, g, c)

    # Summed in the partitions there are; only these sums are moved, and SUM_PARTITIONS of them reach the driver.
    ddl = "n long, g binary, c binary"
    parts = rows.where(~aside).mapInArrow(sums, ddl).where("n > 0").repartition(SUM_PARTITIONS).mapInArrow(added, ddl).collect()
    n = sum(p["n"] for p in parts)
    if n:
        g = sum(np.frombuffer(p["g"]) for p in parts).reshape(FEATURES + 1, FEATURES + 1)
        model.beta = np.linalg.solve(g + RIDGE * n * np.eye(FEATURES + 1), sum(np.frombuffer(p["c"]) for p in parts))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bin_ = np.clip(np.rint(model.raw(_matrix(b)) * BINS), -BINS, 2 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), b.column("label")], ["bin", "label"])

    unseen = rows.where(aside)
    for held in (unseen, rows):  # all rows where none is set aside
        found = held.mapInArrow(bins, "bin long, label double").groupBy("bin").agg(
            F.sum("label").alias("good"), F.count("*").alias("total")
        ).collect()
        if found:
            model.calibrate = Isotonic(*(np.array([float(r[k]) for r in found]) for k in ("bin", "good", "total")))
            break
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, held_out, score, predicted``.

    Labels are learned from the ids whose crc32 modulo FOLDS is not 0; only statistics of the whole text enter a
    score. Null and empty texts have statistics of zero and are scored like others; a null id is never a training
    row. Labels that are null, or of ids that have no document, are left out. Repeated rows get equal scores.
    Without labels every score is 0.5. Other columns are never read; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.table(with_statistics(docs), "statistics")
    train = scratch.table(labelled(rows.where(fold(F.col("doc_id"), FOLDS) != 0), labels, label), "train")
    model = fit(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.calibrate(model.raw(_matrix(b)) * BINS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    held = (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out")
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
