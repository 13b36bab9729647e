"""Poll timelines and verdicts (rows Q17-Q20, F40, H18-H19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimweave.operators.integrity import followed


def latest_verdicts(decisions: DataFrame) -> DataFrame:
    """Q18: the outcome of the highest seq per target, in one aggregation."""
    return decisions.groupBy("target").agg(F.max_by("outcome", "seq").alias("outcome"), F.max("seq").alias("seq"))


def samples(readings: DataFrame) -> DataFrame:
    """One row per (revision, population): label, size, margin, options, and all readings, largest first."""
    options = readings.groupBy("revision_id", "population", "option_id").agg(F.sum("response_count").alias("n"), F.max("margin").alias("margin"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "option_id")))
    said = F.array_join(F.transform(listed, lambda x: F.concat(x["option_id"], F.lit(" "), (-x["m"]).cast("string"))), ", ")
    found = options.groupBy("revision_id", "population").agg(
        F.sum("n").alias("sample_size"), F.max("margin").alias("margin_of_error"), F.count("*").alias("options"), said.alias("readings")
    )
    # The only sample of a revision is called overall.
    many = F.count("*").over(Window.partitionBy("revision_id"))
    return found.withColumn("sample_label", F.when(many == 1, "overall").otherwise(F.col("population")))


def timeline(
    revisions: DataFrame, readings: DataFrame, decisions: DataFrame, survivors: DataFrame, include_rejected: bool = False, limit: int | None = 500
) -> DataFrame:
    """Q17, Q19: one point per sample of every revision that is not now rejected, under its pollster's survivor.

    ``place`` orders a contest's points: oldest end of fieldwork first, undated ones last, then by label and revision;
    the first ``limit`` are given. ``reviewed`` tells whether anyone ruled on the revision at all.
    """
    verdicts = latest_verdicts(decisions).select(F.col("target").alias("review_key"), "outcome")
    kept = revisions.join(verdicts, "review_key", "left")
    if not include_rejected:
        kept = kept.where("outcome is null or outcome <> 'rejected'")
    named = followed(kept.withColumn("reviewed", F.col("outcome").isNotNull()), survivors, "pollster_id", "pollster")
    order = Window.partitionBy("contest_id").orderBy(F.col("ended").asc_nulls_last(), "sample_label", "revision_id", "population")
    own = readings if include_rejected else readings.join(named.select("revision_id"), "revision_id", "left_semi")
    points = named.join(samples(own), "revision_id").withColumn("place", F.row_number().over(order))
    points = points.where(F.col("place") <= limit) if limit else points
    return points.select(
        "contest_id", "place", "revision_id", "pollster", "started", "ended", "sample_label", "population", "sample_size", "margin_of_error",
        "options", "readings", "reviewed"
    )


def series(readings: DataFrame) -> DataFrame:
    """Percentage of every option in its sample."""
    options = readings.groupBy("revision_id", "population", "option_id").agg(F.sum("response_count").alias("n"))
    whole = options.groupBy("revision_id", "population").agg(F.sum("n").alias("total"))
    joined = options.join(whole, ["revision_id", "population"])
    return joined.select("revision_id", "population", "option_id", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 3).alias("percentage"))
