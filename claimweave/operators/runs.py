"""Import runs over batches (rows I9, I11, I13, I16, O2-O6, H44-H45)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimweave.functions import canon, keys, text
from claimweave.operators import ingest, search


def run_key(importer: str, subject: str, digest: str) -> str:
    """A run is known by importer, subject and content, so the same file twice is one run."""
    import hashlib
    import json

    parts = json.dumps({"content": digest, "importer": importer, "subject": subject}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return f"import:{hashlib.sha256(parts.encode()).hexdigest()}"


def started(spark: SparkSession, runs: DataFrame, key: str, task: str) -> DataFrame:
    """The run's row to append; none if the run is known."""
    row = spark.createDataFrame(
        [(key, task, "running")], "idempotency_key string, task_type string, status string"
    ).withColumn("started_at", F.current_timestamp())
    return row.join(runs.select("idempotency_key"), "idempotency_key", "left_anti")


def finished(states: DataFrame) -> DataFrame:
    """The last state of every run, of states(idempotency_key, status, at)."""
    return states.groupBy("idempotency_key").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def in_context(claims: DataFrame, run: str, origin: str, snapshot: Column, index: Column) -> DataFrame:
    """I16: claims with what attributes them; the key is of run, place and claim."""
    place = F.concat(F.lit("/rows/"), index.cast("string"))
    anchor = canon.anchor_fingerprint(
        snapshot, canon.canonical_object(kind=F.lit('"json"'), json_pointer=canon.json_text(place)), F.lit(None).cast("string")
    )
    whole = ingest.fingerprinted(claims.withColumns({"run_id": F.lit(run), "origin": F.lit(origin), "anchor": anchor}))
    return whole.withColumn(
        "idempotency_key", canon.idempotency_key("assert", run=F.col("run_id"), anchor=F.col("anchor"), claim=F.col("fingerprint"))
    )


def run_import(
    rows: DataFrame, emit: Callable[[DataFrame], DataFrame] | str, error: Column | None, run: str, claims: DataFrame, assertions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """rows(record_id, index, snapshot, …) -> (claims with outcome, report).

    A row with a non-null ``error`` fails alone: it is counted and emits nothing. The rest goes through ``emit`` to
    claims; if that is the name of a record type, rows that its ingestor finds wrong fail alone, too. Claims are
    attributed to their row and compared with what is stored.
    """
    judged = rows.withColumn("error", error if error is not None else F.lit(None).cast("string"))
    if isinstance(emit, str):
        made, wrong = ingest.judged_records(judged.where("error is null").drop("error"), emit)
        found = wrong.select("record_id", F.col("error").alias("__found"))
        judged = judged.join(found, "record_id", "left").withColumn("error", F.coalesce("error", "__found")).drop("__found")
    else:
        made = emit(judged.where("error is null"))
    told_of = made.join(judged.where("error is null").select("record_id", "index", "snapshot"), "record_id")
    told = ingest.outcomes(in_context(told_of, run, "import", F.col("snapshot"), F.col("index")), claims, assertions)
    return told, ingest.import_report(judged, told)


def outcome_counts(told: DataFrame) -> DataFrame:
    """Claims by outcome."""
    return told.groupBy("outcome").agg(F.count("*").alias("claims"))


def division_mentions(kept: DataFrame) -> DataFrame:
    """Divisions as mentions to resolve; they make no claims."""
    ident = F.array(F.struct(F.lit("ocd-division").alias("namespace"), F.col("id").alias("value")))
    return kept.select(
        F.col("id").alias("mention_id"), F.lit("jurisdiction").alias("kind"), F.col("name"),
        text.normalize_name(F.col("name")).alias("normalized_name"), ident.alias("identifiers")
    )


def derived_mention(kind: str, namespace: str, value: Column, label: Column) -> Column:
    """A mention known by a computed key."""
    return F.struct(
        F.lit(kind).alias("kind"), label.alias("name"),
        F.array(F.struct(F.lit(namespace).alias("namespace"), value.alias("value"))).alias("identifiers")
    )


def event_mention(division: Column, kind: Column, at: Column, precision: Column, host: Column, title: Column) -> Column:
    """By its computed key, else by title only."""
    key = keys.event_key(division, kind, at, precision, host)
    ids = F.when(
        key.isNotNull(), F.array(F.struct(F.lit("event-key").alias("namespace"), key.alias("value")))
    ).otherwise(F.from_json(F.lit("[]"), "array<struct<namespace:string,value:string>>"))
    return F.struct(F.lit("event").alias("kind"), title.alias("name"), ids.alias("identifiers"), key.isNotNull().alias("keyed"))


def already_recorded(entities: DataFrame, aliases: DataFrame, claims: DataFrame, name: str, kind: str = "debate") -> tuple[DataFrame, DataFrame]:
    """The persons of a name, and the latest events of a kind that they took part in."""
    people = search.find_entities(entities, aliases, name, "person")
    return people, search.find_events(entities, claims, kind, participants=people.select("id"))


#: How an answer may end that is not whole.
NOT_WHOLE = ("length", "content_filter", "error", "incomplete")


def whole_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O3: ``answers(finish_reason, …)`` -> (those that ended by themselves, those cut short, which fail their run)."""
    cut = F.coalesce(F.lower("finish_reason").isin(*NOT_WHOLE), F.lit(True))
    return answers.where(~cut), answers.where(cut).withColumn(
        "error", F.concat(F.lit("the answer ended by "), F.coalesce("finish_reason", F.lit("nothing")))
    )
