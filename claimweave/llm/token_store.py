"""Token ids in ORC: encode, write in id order, and read back by stripe.

The store is a folder of ORC files, one per range of doc_id. ORC's integer run-length encoding packs the ids; its row
indexes and a Bloom filter on doc_id let a reader skip stripes and row groups; each stripe can be read by its own task.
Columns: ``block`` (range number), ``doc_id``, ``start_in_block``, ``n_tokens``, ``ids``. A document's start in the
whole corpus is its start in the block plus the sizes of the blocks before it, which the small columns alone give.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimweave.llm.common import Scratch, small_batches

END_ID = 0
CACHE_WORDS = 350_000
STRIPE_BYTES = 64 << 20
BROADCAST_BLOCKS = 100_000
#: Texts of these characters only are cut into words here; the classes of all of them are settled in every Unicode
#: version. Other texts go through the library whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_LOADED: dict[str, "ByteLevelEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


class _Words(dict):
    """Ids of words, as little-endian unsigned 32-bit integers; a word that is missing is encoded by the library."""

    def __init__(self, model):
        self.model, self.letters, self.old = model, _byte_letters(), {}

    def age(self) -> None:
        """Forget the words that were not met since the last call."""
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is not None:
            self[word] = ids
            return ids
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        self[word] = ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids


class ByteLevelEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library, as its plain call gives them.

    The library's pre-tokenizer never merges across words, so the library's model encodes each distinct word once and
    the ids are then looked up; the table holds at most twice CACHE_WORDS words, the latest. Texts that hold one of the
    file's added tokens go through the library whole, which gives such a token its own id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self.tokenizer.model)
        probe = "A probe: it's 12 naïve\n\n  tests, \tÿ!"
        self.by_word = self._cut(probe) == self._whole(probe)

    @classmethod
    def of(cls, path: str) -> "ByteLevelEncoder":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, text: str) -> bytes:
        self.words.age()
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        by_word = lambda t: self.by_word and _PLAIN.fullmatch(t) and not any(a in t for a in self.added)
        return [self._cut(t) if by_word(t) else self._whole(t) for t in texts]


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs(doc_id, text)`` in ascending doc_id (null first), ties by text, with the columns of the store."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, start = ByteLevelEncoder.of(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            ids = [x + end for x in encoder.encode([t or "" for t in b.column("text").to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.concatenate(([0], np.cumsum(n)))
            arrays = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), block, np.int32)), b.column("doc_id"), pa.array(start + offsets[:-1]), pa.array(n), arrays],
                ["block", "doc_id", "start_in_block", "n_tokens", "ids"]
            )
            start += int(offsets[-1])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ranged.mapInArrow(run, "block int, doc_id long, start_in_block long, n_tokens long, ids array<int>")


def write_store(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write the store of ``docs`` to a new folder.

    Null texts count as empty: each document has at least END_ID. Repeated rows and ids are all written. An empty
    table gives a store without rows. Columns other than doc_id and text are never read.
    """
    out = encoded(docs, tokenizer_path).write.option("compression", "zstd").option("orc.create.index", "true")
    out.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.stripe.size", str(STRIPE_BYTES)).orc(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of a store; filters on doc_id reach ORC's indexes."""
    rows = spark.read.schema("block int, doc_id long, start_in_block long, n_tokens long, ids array<int>").orc(path)
    sizes = rows.groupBy("block").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = sizes.select("block", F.coalesce(before, F.lit(0)).alias("before"))
    if len(rows.inputFiles()) <= BROADCAST_BLOCKS:  # at most one block per file: 16 bytes each; beyond that an ordinary join
        blocks = F.broadcast(blocks)
    return rows.join(blocks, "block").select("doc_id", (F.col("before") + F.col("start_in_block")).alias("start"), "n_tokens", "ids")


def digests(store: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, the counts and checksums taken from the stored ids."""
    small_batches(store.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return store.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write a store of ``docs`` to the shared folder, read it back and digest it."""
    path = Scratch(docs.sparkSession, "tokens").path("store")
    write_store(docs, path, tokenizer_path)
    return digests(read_store(docs.sparkSession, path))
