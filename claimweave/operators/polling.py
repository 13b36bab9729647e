"""Writing polls: revisions, options, estimates, averages (rows I6, H18-H19, H21-H24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimweave.functions import canon
from claimweave.operators import ingest


def payload(polls: DataFrame) -> DataFrame:
    """``polls`` with ``payload_hash`` over all columns but the source's address."""
    held = sorted(c for c in polls.columns if c not in ("source_url", "payload_hash"))
    return polls.withColumn("payload_hash", canon.poll_hash(F.to_json(F.struct(*held), {"ignoreNullFields": "false"})))


def new_revisions(polls: DataFrame, stored: DataFrame) -> DataFrame:
    """Revisions of polls(poll_id, …) whose payload is new for the poll, numbered on from the stored ones.

    ``stored`` has (poll_id, payload_hash, revision_number). A poll seen twice with one payload is one revision.
    """
    fresh = ingest.absent(payload(polls), stored, ["poll_id", "payload_hash"])
    top = stored.groupBy("poll_id").agg(F.max("revision_number").alias("top"))
    order = F.row_number().over(Window.partitionBy("poll_id").orderBy("payload_hash"))
    numbered = fresh.join(top, "poll_id", "left").withColumn("revision_number", (F.coalesce("top", F.lit(0)) + order).cast("int"))
    return numbered.withColumn("supersedes", F.when(F.col("revision_number") > 1, F.col("revision_number") - 1)).drop("top")


def new_options(options: DataFrame, questions: DataFrame) -> DataFrame:
    """Options take their question's revision."""
    return options.drop("poll_revision_id").join(questions.select(F.col("id").alias("question_id"), "poll_revision_id"), "question_id")


def new_estimates(estimates: DataFrame, options: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Estimates with their revision, and those refused as option and sample are of different ones."""
    of = lambda df, k: df.select(F.col("id").alias(k), F.col("poll_revision_id").alias(f"__{k}"))
    both = estimates.join(of(options, "option_id"), "option_id", "left").join(of(samples, "sample_id"), "sample_id", "left")
    same = F.coalesce(F.col("__option_id") == F.col("__sample_id"), F.lit(False))
    return both.where(same).withColumn(
        "poll_revision_id", F.col("__option_id")
    ).drop("__option_id", "__sample_id"), both.where(~same).drop("__option_id", "__sample_id")


def new_average_revisions(averages: DataFrame, stored: DataFrame) -> DataFrame:
    """As new_revisions(), per average."""
    rename = lambda df: df.withColumnRenamed("poll_average_id", "poll_id")
    return new_revisions(rename(averages), rename(stored)).withColumnRenamed("poll_id", "poll_average_id")


def siblings(revisions: DataFrame, poll_id: str) -> DataFrame:
    """H18."""
    return revisions.where(F.col("poll_id") == poll_id).orderBy("revision_number")


def contest_of(questions: DataFrame) -> DataFrame:
    """The contest of each revision's first question."""
    return questions.groupBy("poll_revision_id").agg(F.min_by("contest_id", "position").alias("contest_id"))
