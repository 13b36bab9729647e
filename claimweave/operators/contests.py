"""Reading contests (rows Q9-Q16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimweave.functions import keys
from claimweave.operators import claims as C
from claimweave.operators.integrity import followed


def contests(identifiers: DataFrame) -> DataFrame:
    """Q9, Q16: every contest with a readable key, its parts, label and jurisdiction (null if none is known)."""
    parsed = identifiers.where(F.col("namespace") == "contest-key").select(
        F.col("entity_id").alias("contest_id"), F.col("value").alias("contest_key"), keys.contest_parts(F.col("value")).alias("p")
    ).where("p.division is not null")
    places = identifiers.where(F.col("namespace") == "ocd-division").select(
        F.col("entity_id").alias("jurisdiction_id"), F.col("value").alias("division")
    )
    out = parsed.select("contest_id", "contest_key", "p.*", keys.contest_label(F.col("p")).alias("label"))
    return out.join(places, "division", "left").select(
        "contest_id", "contest_key", "division", "office", "cycle", "stage", "party", "label", "jurisdiction_id"
    )


def contests_in(
    identifiers: DataFrame, prefix: str, cycle: int | None = None, office: str | None = None, stage: str | None = None, limit: int | None = 200
) -> DataFrame:
    """Q10: contests whose key begins with a text, in order of the key."""
    near = identifiers.where((F.col("namespace") != "contest-key") | F.col("value").startswith(prefix))
    out = contests(near)
    for c, v in (("cycle", cycle), ("office", office), ("stage", stage)):
        out = out.where(F.col(c) == v) if v is not None else out
    return out.orderBy("contest_key").limit(limit) if limit else out


def contest_by_key(identifiers: DataFrame, key: str, survivors: DataFrame) -> DataFrame:
    """Q11: the entity of a key, through redirects."""
    found = identifiers.where((F.col("namespace") == "contest-key") & (F.col("value") == key)).select(F.col("entity_id").alias("id"))
    return followed(found, survivors, "id", "contest_id").select("contest_id")


def candidates_in(claims: DataFrame, contests: DataFrame | None = None, at=None) -> DataFrame:
    """Q12: stints of candidates, of some contests and at an instant if given."""
    found = C.claims_with(claims, "candidate_in", objects=contests, at=at)
    return found.select(
        F.col("object_id").alias("contest_id"), F.col("subject_id").alias("candidate_id"), F.col("valid_from").alias("entered"),
        F.col("valid_to").alias("left"), C.is_open(F.col("valid_from"), F.col("valid_to")).alias("is_open")
    )


def results(claims: DataFrame) -> DataFrame:
    """Q13, Q15: results with their rank in the contest, most votes first, nulls last. ``won`` stays null if unsaid."""
    parsed = C.values(claims.where(F.col("predicate") == "contest_result"), "contest_result")
    rank = F.row_number().over(Window.partitionBy("object_id").orderBy(F.col("payload.votes").desc_nulls_last(), "subject_id"))
    return parsed.select(
        F.col("object_id").alias("contest_id"), F.col("subject_id").alias("candidate_id"), F.col("payload.votes").alias("votes"),
        F.col("payload.share").cast("decimal(6,3)").alias("share"), F.col("payload.place").cast("int").alias("place"), F.col("payload.won").alias("won"), rank.alias("rank")
    )


def winners_by_office(claims: DataFrame) -> DataFrame:
    """Q14: per office those who are said to have won; one office for a contest. Null is not a win."""
    offices = claims.where(
        F.col("predicate") == "contest_for_office"
    ).groupBy(F.col("subject_id").alias("contest_id")).agg(F.min("object_id").alias("office_id"))
    return results(claims).where("won").join(offices, "contest_id").select("office_id", "contest_id", "candidate_id", "votes")
