"""SentencePiece encoding and decoding, giant documents split over tasks.

Texts up to GIANT characters are encoded by the library, a row at a time. Longer ones are cut into chunks that
different tasks encode:

* Unigram models: a max-plus scan. The state at a chunk's border is how far the piece that crosses it reaches into
  the next chunk. Each chunk yields the matrix of best scores from entry state to exit state. The matrices combine
  associatively in the max-plus semiring, runs of chunks in tasks of their own; the states at the ends of runs follow
  from the runs' products, those within a run from its own. Then each chunk traces its best path back between its two.
* BPE models: the pieces follow from merges in order of rank, not from a sum of scores, so a max-plus path gives other
  pieces than the model does. Merges never cross a place where a space follows another character, provided no piece
  of the vocabulary does; chunks are cut at such places and encoded apart, which is exact.

A model that normalises its input, or a BPE vocabulary with pieces across word borders, is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimweave.llm.common import Scratch, small_batches

GIANT = 65_536
CHUNK = 16_384
RUN = 256  # chunks whose matrices one task multiplies
MEMO_WORDS = 250_000
SPACE = "▁"
#: Fixed values of the SentencePiece format: model kinds, piece kinds, and the penalty of an unknown character.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNK_PENALTY = 10.0
_LOADED: dict[str, "PieceModel"] = {}


class PieceModel:
    """A model file: the library's processor, and what chunking needs to know of it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.processor = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.kind = proto.trainer_spec.model_type
        plain = not proto.normalizer_spec.precompiled_charsmap and not proto.normalizer_spec.remove_extra_whitespaces and proto.normalizer_spec.escape_whitespaces and proto.normalizer_spec.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix
        crosses = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type in (NORMAL, USER_DEFINED))
        self.chunks = plain and (self.kind == UNIGRAM or self.kind == BPE and not crosses)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        if self.kind == UNIGRAM:
            scores = [p.score for p in proto.pieces if p.type == NORMAL]
            low, high = min(scores, default=0.0), max(scores, default=0.0)
            self.ids = {p.piece: i for i, p in enumerate(proto.pieces)}
            self.score = {
                p.piece: p.score if p.type == NORMAL else len(p.piece) * high - 0.1 for p in proto.pieces if p.type in (NORMAL, USER_DEFINED)
            }
            self.unknown, self.unk_id = low - UNK_PENALTY, self.processor.unk_id()
            self.reach = max(map(len, self.score), default=1)
            self.bytes = [self.ids.get(f"<0x{b:02X}>") for b in range(256)] if proto.trainer_spec.byte_fallback else None

    @classmethod
    def of(cls, path: str) -> "PieceModel":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<i4").tobytes() for x in self.processor.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        Where a BPE model may be cut at spaces, each distinct word is encoded once and then looked up; at most twice
        MEMO_WORDS words are kept, the latest. Texts with runs of spaces or spaces at an end are encoded whole.
        """
        if self.kind != BPE or not self.chunks:
            return self._whole(texts)
        cut = [None if not t or "  " in t or t[0] == " " or t[-1] == " " or SPACE in t else t.split(" ") for t in texts]
        if len(self.words) > MEMO_WORDS:
            self.words, self.old = {}, self.words
        new = set(chain.from_iterable(c for c in cut if c)).difference(self.words)
        for w in new.intersection(self.old):
            self.words[w] = self.old[w]
        fresh = list(new.difference(self.old))
        self.words.update(zip(fresh, self._whole(fresh)))
        whole = iter(self._whole([t for t, c in zip(texts, cut) if c is None]))
        return [next(whole) if c is None else b"".join(map(self.words.__getitem__, c)) for c in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1)

    def cut(self, text: str, size: int) -> list[str]:
        """Chunks of about ``size`` characters, each with what encode_chunk() or the scan needs."""
        if self.kind == UNIGRAM:
            s = SPACE + text.replace(" ", SPACE)
            size = max(size, self.reach)
            return [s[i : i + size + self.reach - 1] for i in range(0, max(1, len(s) - self.reach + 1), size)]
        out, at = [], 0
        while len(text) - at > size:
            end = text.find(" ", at + size)
            while end > 0 and text[end - 1] in (" ", SPACE):
                end = text.find(" ", end + 1)
            if end < 0 or end == len(text) - 1:  # a chunk of nothing would lose the space
                break
            out.append(text[at:end])
            at = end + 1  # the library's dummy prefix stands for the space
        return [*out, text[at:]]

    def _edges(self, s: str, i: int, end: int) -> Iterator[tuple[int, float]]:
        single = False
        for j in range(i + 1, min(i + self.reach, end) + 1):
            if (score := self.score.get(s[i:j])) is not None:
                single |= j == i + 1
                yield j, score
        if not single:
            yield i + 1, self.unknown

    def transfer(self, s: str, last: bool) -> np.ndarray:
        """Max-plus matrix of one chunk, entry state by exit state. ``s`` reaches into the next chunk."""
        r = self.reach
        own = len(s) if last else len(s) - r + 1
        best = np.full((len(s) + r, r), -np.inf)
        for e in range(min(r, own + 1)):
            best[e, e] = 0.0
        for i in range(own):
            for j, score in self._edges(s, i, len(s)):
                np.maximum(best[j], best[i] + score, out=best[j])
        return best[own : own + r].T.copy()

    def trace(self, s: str, last: bool, entry: int, leave: int) -> list[int]:
        """Ids of the best path of one chunk from its entry to its exit state."""
        own = len(s) if last else len(s) - self.reach + 1
        best, back = np.full(len(s) + self.reach, -np.inf), np.full(len(s) + self.reach, -1)
        best[entry] = 0.0
        for i in range(entry, own):
            if best[i] > -np.inf:
                for j, score in self._edges(s, i, len(s)):
                    if best[i] + score > best[j]:
                        best[j], back[j] = best[i] + score, i
        pieces, at = [], own + leave
        while at != entry:
            pieces.append(s[back[at] : at])
            at = back[at]
        out: list[int] = []
        for p in reversed(pieces):
            if p in self.score:
                out.append(self.ids[p])
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(self.unk_id)
        return out

    def joined(self, parts: list[list[int]]) -> list[int]:
        """Ids of a text from those of its chunks; the library makes one of neighbouring unknowns."""
        ids = list(chain.from_iterable(parts))
        if self.kind == UNIGRAM and not self.bytes:
            ids = [x for k, x in enumerate(ids) if x != self.unk_id or not k or ids[k - 1] != x]
        return ids


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two transfer matrices in the max-plus semiring; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of consecutive chunks taken together."""
    out = matrices[0]
    for m in matrices[1:]:
        out = max_plus(out, m)
    return out


def states(matrices: list[np.ndarray], entry: int = 0, leave: int = 0) -> list[tuple[int, int]]:
    """(entry, exit) state of every chunk on the best path from one state before all to one behind all."""
    before = [np.where(np.arange(len(matrices[0])) == entry, 0.0, -np.inf)[None, :]]
    for m in matrices[:-1]:
        before.append(max_plus(before[-1], m))
    out = []
    for v, m in zip(reversed(before), reversed(matrices)):
        start = int((v[0] + m[:, leave]).argmax())
        out.append((start, leave))
        leave = start
    return out[::-1]


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _encode_rows(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = PieceModel.of(path).encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(ids)], [*b.schema.names, "ids"])

    return docs.mapInArrow(run, f"{_schema(docs)}, ids array<int>")


def _encode_giants(docs: DataFrame, path: str, size: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "pieces")
    giants = scratch.table(docs.withColumn("__row", F.monotonically_increasing_id()), "giants")  # written, so numbers stay
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column("__row").to_pylist(), b.column("text").to_pylist()):
                chunks = PieceModel.of(path).cut(text, size)
                n = len(chunks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n), pa.array(range(n), pa.int32()), pa.array([k == n - 1 for k in range(n)]), pa.array(chunks)],
                    ["__row", "part", "last", "s"]
                )

    chunks = giants.select("__row", "text").mapInArrow(cut, "__row long, part int, last boolean, s string").repartition(parts, "__row", "part")

    if PieceModel.of(path).kind == UNIGRAM:
        chunks = scratch.table(chunks, "chunks")

        def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = [PieceModel.of(path).transfer(s, z).tobytes() for s, z in zip(b.column("s").to_pylist(), b.column("last").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("__row"), b.column("part"), pa.array(m, pa.binary())], ["__row", "part", "m"])

        def stacked(rows: pd.DataFrame, order: str) -> tuple[pd.DataFrame, list[np.ndarray]]:
            r, rows = PieceModel.of(path).reach, rows.sort_values(order)
            return rows, [np.frombuffer(m).reshape(r, r) for m in rows["m"]]

        def multiply(rows: pd.DataFrame) -> pd.DataFrame:
            rows, held = stacked(rows, "part")
            return rows[["__row", "run"]].head(1).assign(m=[product(held).tobytes()])

        def walk(rows: pd.DataFrame, order: str) -> pd.DataFrame:
            rows, held = stacked(rows, order)
            ends = (int(rows["entry"].iloc[0]), int(rows["leave"].iloc[0])) if order == "part" else (0, 0)
            found = states(held, *ends)
            return rows[["__row", order]].assign(entry=[e for e, _ in found], leave=[x for _, x in found])

        def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = [_packed(PieceModel.of(path).trace(*x)) for x in zip(*(b.column(c).to_pylist() for c in ("s", "last", "entry", "leave")))]
                yield pa.RecordBatch.from_arrays([b.column("__row"), b.column("part"), _lists(ids)], ["__row", "part", "ids"])

        # A tree of two levels: runs of chunks are multiplied apart, one task walks a text's runs, then each run its chunks.
        each = scratch.table(
            chunks.mapInArrow(matrices, "__row long, part int, m binary").withColumn("run", F.floor(F.col("part") / RUN).cast("int")), "matrices"
        )
        runs = each.groupBy("__row", "run").applyInPandas(multiply, "__row long, run int, m binary")
        ends = runs.groupBy("__row").applyInPandas(lambda rows: walk(rows, "run"), "__row long, run int, entry int, leave int")
        told = each.join(ends, ["__row", "run"]).groupBy("__row", "run")
        found = told.applyInPandas(lambda rows: walk(rows, "part"), "__row long, part int, entry int, leave int")
        done = chunks.join(found, ["__row", "part"]).mapInArrow(trace, "__row long, part int, ids array<int>")
    else:
        done = _encode_rows(chunks.withColumnRenamed("s", "text"), path).select("__row", "part", "ids")

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_packed(PieceModel.of(path).joined([p["ids"] for p in sorted(x, key=lambda p: p["part"])])) for x in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__row"), _lists(ids)], ["__row", "ids"])

    per = done.groupBy("__row").agg(F.collect_list(F.struct("part", "ids")).alias("parts")).mapInArrow(glue, "__row long, ids array<int>")
    return giants.join(per, "__row").select(*docs.columns, "ids")


def encode(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """All columns of ``docs`` and ``ids``, the pieces of ``text`` under the model file at ``path``.

    The ids equal the library's, however long the text; under a unigram model, segmentations of equal score may be
    swapped at chunk borders. Null and empty texts have no ids. Repeated rows stay. A column ``ids`` of docs is
    replaced. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    own = docs.drop("ids")
    if not PieceModel.of(path).chunks:
        return _encode_rows(own, path)
    long = F.coalesce(F.length("text") > giant, F.lit(False))
    return _encode_rows(own.where(~long), path).unionByName(_encode_giants(own.where(long), path, chunk))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of ``ids``; null ids give null."""
    small_batches(encoded.sparkSession)
    own = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids").to_pylist()
            texts = iter(PieceModel.of(path).decode([x for x in ids if x is not None]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([None if x is None else next(texts) for x in ids], pa.string())], [*b.schema.names, "decoded"]
            )

    return own.mapInArrow(run, f"{_schema(own)}, decoded string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, round_trip``: whether decoding gives the text back (null: empty)."""
    import zlib

    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), b.column("round_trip")],
                ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
            )

    same = decode(encoded, path).select(
        F.col("doc_id").cast("long").alias("doc_id"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )
    return same.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
