"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

The lexicon is a short list of insults and what is learned from training rows: words and word beginnings that stand in
toxic documents and hardly ever in others, whatever the language, each with its log odds. The trees see each training
row through the lexicon of rows other than it, so they learn how far a word can be trusted. Features are its densities,
also after undoing common spellings with digits and signs, its closeness to words of address, and rates of capitals,
punctuation and obfuscated words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from claimweave.llm.boosting import BoostedTrees
from claimweave.llm.common import Scratch, small_batches
from claimweave.llm.isotonic import Isotonic
from claimweave.llm.quality import fold

FOLDS, HELD = 3, 1
THRESHOLD = 0.7
#: At most so many labelled rows are learned from, those with the smallest hash of their id.
MAX_LABELLED = 20_000
LEAST_TOXIC, LEAST_PRECISION, MAX_CHANCE = 3, 0.9, 0.05
SIGNATURES = 4
STEMS = range(3, 9)
NEAR = 5
MEMO_WORDS = 300_000
#: Words that address the reader, in some European languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tú ti vosotros su sus".split()
)
#: Common insults in the same languages, known before anything is learned.
INSULTS = frozenset(
    "idiot moron stupid dumb loser pathetic scum worthless trash disgusting imbecile jerk bastard bitch filth vermin retard idiote débile connard salope ordure crétin dummkopf trottel arschloch abschaum versager miststück estúpido imbécil basura asqueroso inútil escoria pendejo".split()
)
KNOWN_WEIGHT = 3.0
#: Signs and digits that stand for letters.
_PLAIN = str.maketrans("0134578@$!€", "oieastbasie")
_EDGE = "\"'`.,;:!?()[]{}<>|%&$#*@^~=+/\\_-«»„“”‚‘’¡¿…"
_ODD = re.compile(r"[^\W\d_][\d@$!€*.\-_]+[^\W\d_]|[\d@$€]+[^\W\d_]{2}")
_HIT, _HIDDEN, _YOU, _SHAPE = 1, 2, 4, 8
N_FEATURES = 15


def grams(word: str) -> list[str]:
    """What of a word may be in the lexicon: itself, and its beginnings of STEMS letters."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]


class _Memo(dict):
    """Codes of words met before; a new word is looked at by the lexicon."""

    def __init__(self, lexicon: "Lexicon"):
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> int:
        self[raw], weight = self.lexicon.word_code(raw)
        if weight:
            self.lexicon.hits[raw] = weight
        return self[raw]


class Lexicon:
    """Weights of words and word beginnings; word_code() gives what one raw word shows."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.words = {g: w for g, w in weights.items() if not g.endswith("-")}
        of = {n: {g[:-1]: w for g, w in weights.items() if g.endswith("-") and len(g) == n + 1} for n in STEMS}
        self.stems = [(n, found) for n, found in of.items() if found]
        self.starts = {g[:3] for g in (*weights, *INSULTS)}  # of every entry; none is shorter
        self.memo, self.hits = _Memo(self), {}

    def __reduce__(self) -> tuple:
        return Lexicon, (self.weights,)

    def _weight(self, word: str) -> float:
        if word[:3] not in self.starts:
            return 0.0
        best = self.words.get(word, 0.0)
        for n, found in self.stems:
            if len(word) > n and (weight := found.get(word[:n], 0.0)) > best:
                best = weight
        return best or KNOWN_WEIGHT * (word in INSULTS)

    def word_code(self, raw: str) -> tuple[int, float]:
        word = raw.lower().strip(_EDGE)
        code, weight = (_YOU if word in SECOND_PERSON else 0), self._weight(word) if word else 0.0
        if weight:
            code |= _HIT
        elif not word.isalpha() and _ODD.search(raw.lower()):
            code |= _SHAPE
            plain = re.sub(r"[\W\d_]+", "", raw.lower().translate(_PLAIN))
            if weight := self._weight(plain):
                code |= _HIDDEN
        return code, weight

    def codes(self, words: list[str]) -> tuple[np.ndarray, float, float]:
        """The code of every word, and the largest and the summed weight."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
            self.hits.clear()
        code = np.fromiter(map(self.memo.__getitem__, words), np.uint8, len(words))
        found = [self.hits[words[k]] for k in np.flatnonzero(code & (_HIT | _HIDDEN))]
        return code, max(found, default=0.0), sum(found)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Dense features of the whole text; all zero for a null, empty or blank one."""
    words = (text or "").split()
    if not words:
        return [0.0] * N_FEATURES
    n, (code, most, weight) = len(words), lexicon.codes(words)
    hit, you = np.flatnonzero(code & (_HIT | _HIDDEN)), np.flatnonzero(code & _YOU)
    near = 0
    if len(hit) and len(you):
        k = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(hit - you[np.minimum(k, len(you) - 1)]), np.abs(hit - you[np.maximum(k - 1, 0)]))
        near = int((gap <= NEAR).sum())
    size = len(text)
    raw = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(raw, minlength=256)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    signs = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    hidden, shaped = int((code & _HIDDEN > 0).sum()), int((code & _SHAPE > 0).sum())
    return [
        len(hit) / n, float(np.log1p(len(hit))), most, weight / n, hidden / n, float(hidden), shaped / n, len(you) / n, near / n, float(near),
        float(upper / max(1, upper + lower)), float(count[33] / size), float(signs / size), float(count[48:58].sum() / size), float(np.log1p(n))
    ]


def _sample(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` training labels (doc_id, label), the same in every run."""
    rows = labels.where(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
    ).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    train = rows.where(fold(F.col("doc_id"), FOLDS) != HELD)
    n = train.count()
    if n > 2 * limit:  # most rows needn't reach the sort: those kept have hashes near the bottom of the range
        span = 2**64
        train = train.where(F.xxhash64("doc_id") <= -(span // 2) + int(span * min(1.0, 2 * limit / n)))
    return train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def signatures(text: str | None, many: int = SIGNATURES) -> list[int]:
    """Smallest hashes of the text's runs of three words, under several seeds: near copies have some in common."""
    words = (text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    return [min(xxhash.xxh64_intdigest(g, seed) for g in grams) >> 1 for seed in range(many)]


def least_support(spread: list[tuple[int, int, int]], share: float) -> int:
    """From (documents, grams, grams in toxic ones only): the least number of toxic documents to trust a gram.

    Of n grams with k documents each, n * share^k are in toxic ones only by chance; that must be few of those found.
    """
    for k, n, only in sorted(spread):
        if k >= LEAST_TOXIC and n * share**k <= MAX_CHANCE * max(only, 1):
            return k
    return max((k for k, _, _ in spread), default=LEAST_TOXIC) + 1


def learn_lexicon(train: DataFrame) -> tuple[Lexicon, tuple[Lexicon, Lexicon]]:
    """From ``train(doc_id, text, label, half, sigs)``: the lexicon, and for each half that of the other half.

    Of near copies one counts, since what they repeat is no evidence. What is collected here is bounded by the sample
    of labelled documents: every entry stands in several of them.
    """
    ids = train.select("doc_id", *(F.col("sigs")[k].alias(f"s{k}") for k in range(SIGNATURES)))
    for k in range(SIGNATURES):
        ids = ids.groupBy(f"s{k}").agg(F.min_by(F.struct("*"), "doc_id").alias("r")).select("r.*")
    apart = train.join(ids.select("doc_id"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter() for _ in range(4)]
            for t, y, half in zip(*(b.column(c).to_pylist() for c in ("text", "label", "half"))):
                words = {w.strip(_EDGE) for w in set((t or "").lower().split())}
                counts[2 * half + y].update({g for w in words if len(w) > 2 and w not in SECOND_PERSON for g in grams(w)})
            keys = list(set().union(*counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["gram", "c0", "t0", "c1", "t1"]
            )

    totals = {(r["half"], r["label"]): r["count"] for r in apart.groupBy("half", "label").count().collect()}
    toxic, clean = (sum(totals.get((h, y), 0) for h in (0, 1)) for y in (1, 0))
    if not toxic:
        return Lexicon({}), (Lexicon({}), Lexicon({}))
    counted = apart.select("text", "label", "half").mapInArrow(run, "gram string, c0 long, t0 long, c1 long, t1 long")
    found = counted.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))
    found = Scratch(train.sparkSession, "lexicon").table(found.where("t0 + t1 > 0"), "grams")
    spread = found.groupBy(
        (F.col("t0") + F.col("t1") + F.col("c0") + F.col("c1")).alias("k")
    ).agg(F.count("*"), F.count_if(F.expr("c0 + c1 = 0"))).collect()
    least = least_support([tuple(r) for r in spread], toxic / (toxic + clean))
    best = found.where(f"t0 + t1 >= {least} and t0 + t1 >= {LEAST_PRECISION} * (t0 + t1 + c0 + c1)").collect()

    def lexicon(halves: tuple[int, ...]) -> Lexicon:
        nt, nc = (sum(totals.get((h, y), 0) for h in halves) for y in (1, 0))
        rows = ((r["gram"], sum(r[f"t{h}"] for h in halves), sum(r[f"c{h}"] for h in halves)) for r in best)
        return Lexicon(
            {
                g: float(np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))) for g, t,
                c in rows if t >= least * len(halves) / 2 and t >= LEAST_PRECISION * (t + c)
            }
        )

    return lexicon((0, 1)), (lexicon((1,)), lexicon((0,)))


class ToxicityModel:
    """Lexicon, trees and calibration: what a task carries to score texts."""

    def __init__(self, lexicon: Lexicon, trees: BoostedTrees, calibrate: Isotonic):
        self.lexicon, self.trees, self.calibrate = lexicon, trees, calibrate

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.calibrate(self.trees.margin(np.array([features(t, self.lexicon) for t in texts]).reshape(-1, N_FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on the documents of at most ``max_labelled`` training labels; a quarter of them calibrates.

    Of documents that share an id one is learned from, that with the smallest text, so the rows are bounded, too.
    Without training rows every score is 0.5.
    """
    small_batches(docs.sparkSession)
    sample = F.broadcast(_sample(labels, max_labelled))  # its size is bounded by max_labelled
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").join(sample, "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("half")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = pa.array([signatures(t) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, sigs], [*b.schema.names, "sigs"])

    signed = texts.select("doc_id", "text", "label", half).mapInArrow(sign, "doc_id long, text string, label int, half int, sigs array<long>")
    train = Scratch(docs.sparkSession, "toxicity").table(signed, "train")
    lexicon, others = learn_lexicon(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, others[h]) for t, h in zip(b.column("text").to_pylist(), b.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    aside = (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0).alias("aside")
    shown = train.select("doc_id", "text", "label", "half").mapInArrow(run, "doc_id long, label int, x array<double>")
    rows = shown.orderBy("doc_id").select("label", "x", aside).collect()  # max_labelled rows at most
    if not rows:
        return ToxicityModel(lexicon, BoostedTrees(), Isotonic(*np.zeros((3, 0))))
    x, y, aside = np.array([r["x"] for r in rows]), np.array([float(r["label"]) for r in rows]), np.array([r["aside"] for r in rows])
    if not 0 < y[aside].sum() < aside.sum() or not 0 < y[~aside].sum() < (~aside).sum():
        trees, aside = BoostedTrees().fit(x, y), np.ones(len(y), bool)
    else:
        trees = BoostedTrees().fit(x[~aside], y[~aside])
    at, where = np.unique(np.round(trees.margin(x[aside]), 2), return_inverse=True)
    return ToxicityModel(lexicon, trees, Isotonic(at, np.bincount(where, y[aside]), np.bincount(where).astype(float)))


def with_scores(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each text, a double in 0..1; a column of that name is replaced."""
    own = docs.drop(name)
    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])

    return own.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, held_out, score, predicted``.

    Labels are learned from the ids whose crc32 modulo 3 is not 1; only the whole text enters a score. Null, empty
    and blank texts have features of zero and are scored like others. Null ids and null labels are never learned
    from; of repeated label rows the larger counts. Repeated documents get equal scores. Without labels every score
    is 0.5. Other columns are never read; an empty table gives an empty table.
    """
    rows = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    held = (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out")
    return rows.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
