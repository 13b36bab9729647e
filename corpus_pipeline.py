"""The corpus pipeline: from raw documents to a mixed, deduplicated, tokenised corpus.

Each stage works on all that the one before it kept. ``run`` writes what a stage returns to the shared folder and
reads it back for the next, so a lost executor costs at most one stage's lost tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.llm import mixing, near_copies, piece_codec, substring, toxicity
from claimweave.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; labels are those of ``sf_dir``."""
    scored = toxicity.with_scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: those that share four fifths of their five-word runs."""
    return near_copies.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand more than once."""
    return substring.replace_text(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, documents repeated as their rates say."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of each document."""
    import public_tokenizers

    ids = piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: No SQL: fingerprints need XXH64, scores and pieces need trained models. The tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
