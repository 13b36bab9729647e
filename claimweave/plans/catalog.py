"""The predicate and namespace catalogues (rows S26, R20, H1-H3, H34, Q33). Both tables are fixed values."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from claimweave.operators import ingest


class Predicate(NamedTuple):
    slug: str
    target: str
    time: str
    subjects: tuple[str, ...]
    objects: tuple[str, ...]
    value: str | None


_WHO = ("person", "organization", "party")
#: slug, target, temporal mode, kinds of subject, kinds of object, payload.
PREDICATES = (
    Predicate("participated_in", "qualified", "optional", ("person", "organization"), ("event",), "role STRING"),
    Predicate("endorsed", "qualified", "optional", _WHO, ("person", "organization", "option"), "strength STRING, context STRING"),
    Predicate("donated_to", "qualified", "optional", _WHO, ("person", "organization", "contest"), "amount STRING, currency STRING, kind STRING, supporting BOOLEAN, purpose STRING"),
    Predicate("candidate_in", "entity", "optional", ("person",), ("contest",), None),
    Predicate("event_kind", "value", "timeless", ("event",), (), "kind STRING"),
    Predicate("public_statement", "value", "required", ("person", "organization"), (), "topic STRING, position STRING, summary STRING"),
    Predicate("contest_of_election", "entity", "timeless", ("contest",), ("election",), None),
    Predicate("contest_for_office", "entity", "timeless", ("contest",), ("office",), None),
    Predicate("office_for_jurisdiction", "entity", "optional", ("office",), ("jurisdiction",), None),
    Predicate("contest_in_jurisdiction", "entity", "timeless", ("contest",), ("jurisdiction",), None),
    Predicate("market_for_contest", "entity", "timeless", ("market",), ("contest",), None),
    Predicate("event_about_contest", "entity", "timeless", ("event",), ("contest",), None),
    Predicate("event_in_jurisdiction", "entity", "timeless", ("event",), ("jurisdiction",), None),
    Predicate("event_occurrence", "value", "required", ("event",), (), "status STRING"),
    Predicate("contest_result", "qualified", "optional", ("person", "organization", "option"), ("contest",), "votes BIGINT, share STRING, place INT, won BOOLEAN"),
    Predicate("contest_stage", "value", "timeless", ("contest",), (), "stage STRING"),
    Predicate("contest_party", "entity", "timeless", ("contest",), ("party",), None),
    Predicate("advances_to", "entity", "timeless", ("contest",), ("contest",), None),
    Predicate("party_affiliation", "entity", "optional", ("person", "organization"), ("party",), None),
    Predicate("assessed", "qualified", "required", ("person", "organization"), ("person", "organization", "event", "contest"), "rating STRING, basis STRING"),
)
#: namespace, status, precedence.
NAMESPACES = (
    ("ocd-division", "active", 5), ("wikidata", "active", 10), ("fec", "active", 20), ("bioguide", "active", 20), ("kalshi", "active", 30),
    ("ballotpedia", "active", 50), ("contest-key", "active", 60), ("office-key", "active", 60), ("election-key", "active", 60),
    ("event-key", "active", 60)
)
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "claimweave/predicates")


def predicate(slug: str) -> Predicate:
    """H2: an unknown slug raises KeyError."""
    return {p.slug: p for p in PREDICATES}[slug]


def version_id(slug: str, version: int = 1) -> str:
    """The id of a predicate's version."""
    predicate(slug)
    return str(uuid.uuid5(SPACE, f"{slug}/{version}"))


def by_version(version: str) -> Predicate:
    """H3."""
    return {version_id(p.slug): p for p in PREDICATES}[version]


def predicates(spark: SparkSession) -> DataFrame:
    """The catalogue as a table; a constant of the library, so it may be broadcast."""
    rows = [(p.slug, version_id(p.slug), p.target, p.time, list(p.subjects), list(p.objects), p.value) for p in PREDICATES]
    return spark.createDataFrame(
        rows, "slug string, version_id string, target string, time string, subjects array<string>, objects array<string>, value_ddl string"
    )


def namespaces(spark: SparkSession) -> DataFrame:
    """H34."""
    return spark.createDataFrame(list(NAMESPACES), "namespace string, status string, precedence int")


def active_namespaces(spark: SparkSession) -> DataFrame:
    """Q33: by precedence, then name."""
    return namespaces(spark).where("status = 'active'").orderBy("precedence", "namespace")


def seed(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """Predicates to insert; a stored contract that differs is an error."""
    now = predicates(spark)
    differs = stored.join(now, "slug").where((stored["target"] != now["target"]) | (stored["time"] != now["time"]))
    if found := differs.select("slug").limit(3).collect():
        raise ValueError(f"contracts have changed: {[r['slug'] for r in found]}")
    return ingest.absent(now, stored, ["slug"])
