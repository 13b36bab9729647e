"""Reading claims (rows Q1-Q8, R16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimweave.functions import payloads

UNATTRIBUTED = "(unattributed)"
#: The reference's page of claims about one entity.
PAGE = 100


def valid_at(at: Column) -> Column:
    """Q3: whether a claim holds at an instant: half-open intervals, points by equality; timeless and end-only never."""
    inside = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return F.coalesce(inside, F.lit(False)) | F.coalesce(F.col("valid_at") == at, F.lit(False))


def is_open(since: Column, until: Column) -> Column:
    """Q8: begun and not ended."""
    return since.isNotNull() & until.isNull()


def _newest(claims: DataFrame, limit: int | None) -> DataFrame:
    return claims.orderBy(
        F.coalesce("valid_from", "valid_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id"
    ).limit(limit) if limit else claims


def claims_about(
    claims: DataFrame, entity_id: str, predicate: str | None = None, as_object: bool = False, at: Column | None = None, limit: int | None = PAGE,
    merged: DataFrame | None = None, superseded: DataFrame | None = None
) -> DataFrame:
    """Q1: the page of the latest claims of which an entity is the subject, or the object.

    Redirects, supersession and review play no part, unless asked for: ``merged`` (id, survivor_id) adds the claims of
    the entities merged into this one, ``superseded`` (id) leaves out claims that another replaced.
    """
    side = "object_id" if as_object else "subject_id"
    if merged is None:
        found = claims.where(F.col(side) == entity_id)
    else:
        theirs = merged.where(F.col("survivor_id") == entity_id).select(F.col("id").alias("__id"), F.lit(True).alias("__merged"))
        found = claims.join(theirs, F.col(side) == F.col("__id"), "left").where(
            (F.col(side) == entity_id) | F.col("__merged")
        ).drop("__id", "__merged")
    found = found.where(F.col("predicate") == predicate) if predicate else found
    found = found.where(valid_at(at)) if at is not None else found
    return _newest(found if superseded is None else found.join(superseded.select("id"), "id", "left_anti"), limit)


def claims_with(
    claims: DataFrame, predicate: str, subjects: DataFrame | None = None, objects: DataFrame | None = None, at: Column | None = None
) -> DataFrame:
    """Q2: claims of a predicate, with subject or object among the ids (column ``id``) of a table, at an instant."""
    found = claims.where(F.col("predicate") == predicate)
    for ids, c in ((subjects, "subject_id"), (objects, "object_id")):
        if ids is not None:
            found = found.join(ids.select(F.col("id").alias(c)).distinct(), c, "left_semi")
    return found.where(valid_at(at)) if at is not None else found


def latest(claims: DataFrame, side: str = "subject_id", k: int | None = PAGE) -> DataFrame:
    """Q1 for every entity at once: its k latest claims, or all of them, with their rank; all columns break ties."""
    order = Window.partitionBy(side).orderBy(
        F.coalesce("valid_from", "valid_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id", "subject_id", "object_id",
        *(c for c in ("value",) if c in claims.columns)
    )
    ranked = claims.where(F.col(side).isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k) if k else ranked


def provenance(assertions: DataFrame) -> DataFrame:
    """Q6: per claim the number of assertions and the sorted distinct writers; a null writer is not listed."""
    return assertions.groupBy("claim_id").agg(
        F.count("*").alias("assertions"), F.array_join(F.sort_array(F.collect_set("asserted_by")), ",").alias("writers")
    )


def by_stance(assertions: DataFrame) -> DataFrame:
    """Counts of each stance per claim, beside Q6."""
    return assertions.groupBy("claim_id").agg(*(F.count_if(F.col("stance") == s).alias(s) for s in ("supports", "contradicts", "mentions")))


def materialized(claims: DataFrame, entities: DataFrame, assertions: DataFrame, limit: int | None = 100) -> DataFrame:
    """Q4: the latest claims first (nulls last, ties by id), with names and provenance.

    The limit is taken before any join, so names are looked up for one page only.
    """
    page = _newest(claims, limit)
    names = entities.select("id", "kind", "canonical_name")
    as_ = lambda p: names.select(*(F.col(c).alias(f"{p}_{n}") for c, n in (("id", "id"), ("kind", "kind"), ("canonical_name", "name"))))
    seen = provenance(assertions.join(page.select(F.col("id").alias("claim_id")), "claim_id", "left_semi"))
    out = page.join(as_("subject"), "subject_id").join(as_("object"), "object_id", "left").join(seen, page["id"] == seen["claim_id"], "left")
    return out.select(
        "id", "predicate", "subject_id", "subject_kind", "subject_name", "object_id", "object_kind", "object_name", "value", "valid_at", "valid_from",
        "valid_to", F.coalesce("assertions", F.lit(0)).alias("assertions"), F.coalesce("writers", F.lit("")).alias("writers"),
        is_open(F.col("valid_from"), F.col("valid_to")).alias("is_open")
    )


def evidence(claims: DataFrame, assertions: DataFrame, sources: DataFrame) -> DataFrame:
    """Q5: claim -> assertion -> page -> source, with its place in the order of assertions; no writer is named so."""
    joined = claims.select(F.col("id").alias("claim_id")).join(assertions, "claim_id").join(sources, "page_id")
    return joined.select("claim_id", "seq", "stance", F.coalesce("asserted_by", F.lit(UNATTRIBUTED)).alias("asserted_by"), "page_id", "url")


def alignment(assertions: DataFrame, *by: str) -> DataFrame:
    """Share of assertions that fit the ontology, of all or of each group; null where there are none."""
    share = F.try_divide(F.count_if("aligned").cast("double"), F.count("*").cast("double"))
    return assertions.groupBy(*by).agg(F.count("*").alias("assertions"), F.count_if("aligned").alias("aligned_n"), F.round(share, 6).alias("score"))


def values(claims: DataFrame, slug: str | None = None) -> DataFrame:
    """``bad_value``, ``errors`` by field and ``payload``, which is null where anything is wrong; raw text is kept.

    Every claim is read by its own predicate's contract, and its payload is a map of canonical texts; given ``slug``,
    claims are of that predicate and the payload is a struct of its fields' types.
    """
    read = claims.withColumn("__j", payloads.judged(F.lit(slug), F.col("value"), (slug,)) if slug else payloads.judged(F.col("predicate"), F.col("value")))
    errors = F.coalesce("__j.errors", F.array().cast("array<string>"))
    fields = F.when(F.size(errors) == 0, F.col("__j.fields"))
    out = read.withColumns({"errors": errors, "bad_value": F.size(errors) > 0, "payload": payloads.typed(slug, fields) if slug else fields})
    return out.drop("__j")
