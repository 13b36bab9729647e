"""Declared schemas of the graph's tables, and their bootstrap (rows H28, H53).

Ids are strings, JSON is text with SQL null kept apart from JSON null, times are UTC timestamps. The table is fixed
values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from claimweave.operators import ingest
from claimweave.plans.commits import LoggedTable

TABLES = {
    "entity": "id STRING, kind STRING, canonical_name STRING, created_at TIMESTAMP",
    "entity_identifier": "id STRING, entity_id STRING, namespace STRING, value STRING, research_run_id STRING, created_at TIMESTAMP",
    "entity_alias": "id STRING, entity_id STRING, name STRING, normalized_name STRING, language STRING, created_at TIMESTAMP",
    "entity_redirect": "duplicate_entity_id STRING, canonical_entity_id STRING, reason STRING, created_by STRING, created_at TIMESTAMP",
    "identifier_namespace": "namespace STRING, label STRING, authority STRING, uri_template STRING, status STRING, superseded_by STRING, precedence INT, created_at TIMESTAMP",
    "predicate": "id STRING, slug STRING, label STRING, description STRING, created_at TIMESTAMP",
    "predicate_version": "id STRING, predicate_id STRING, version INT, target_kind STRING, temporal_mode STRING, value_model_path STRING, value_schema STRING, schema_hash STRING, created_at TIMESTAMP",
    "predicate_subject_kind": "predicate_version_id STRING, entity_kind STRING",
    "predicate_object_kind": "predicate_version_id STRING, entity_kind STRING",
    "claim": "id STRING, predicate_version_id STRING, target_kind STRING, subject_id STRING, object_id STRING, value STRING, valid_at TIMESTAMP, valid_at_precision STRING, valid_from TIMESTAMP, valid_from_precision STRING, valid_to TIMESTAMP, valid_to_precision STRING, fingerprint STRING, created_at TIMESTAMP",
    "evidence_anchor": "id STRING, source_snapshot_id STRING, locator_kind STRING, locator STRING, excerpt STRING, fingerprint STRING, created_at TIMESTAMP",
    "claim_assertion": "id STRING, seq BIGINT, idempotency_key STRING, claim_id STRING, evidence_anchor_id STRING, research_run_id STRING, supersedes_assertion_id STRING, stance STRING, origin STRING, asserted_by STRING, confidence DECIMAL(5,4), ontology_aligned BOOLEAN, ontology_violation STRING, details STRING, created_at TIMESTAMP",
    "claim_supersession": "id STRING, idempotency_key STRING, predecessor_claim_id STRING, successor_claim_id STRING, origin STRING, created_by STRING, reason STRING, created_at TIMESTAMP",
    "source": "id STRING, kind STRING, canonical_url STRING, title STRING, publisher_id STRING, publisher_name STRING, author_entity_id STRING, author_name STRING, created_at TIMESTAMP",
    "artifact": "id STRING, sha256 STRING, storage_uri STRING, storage_version_id STRING, byte_length BIGINT, media_type STRING, original_filename STRING, created_at TIMESTAMP",
    "source_snapshot": "id STRING, source_id STRING, artifact_id STRING, retrieved_at TIMESTAMP, published_at TIMESTAMP, retrieval_metadata STRING, created_at TIMESTAMP",
    "artifact_derivation": "parent_artifact_id STRING, derived_artifact_id STRING, kind STRING, research_run_id STRING, processor_name STRING, processor_version STRING, parameters STRING, created_at TIMESTAMP",
    "research_run": "id STRING, idempotency_key STRING, workflow_id STRING, workflow_run_id STRING, task_type STRING, subject_entity_id STRING, status STRING, input_data STRING, raw_output STRING, agent_name STRING, model_id STRING, prompt_version STRING, output_schema_version STRING, started_at TIMESTAMP, completed_at TIMESTAMP, error_message STRING",
    "research_run_input": "research_run_id STRING, source_snapshot_id STRING, role STRING, created_at TIMESTAMP",
    "poll": "id STRING, external_namespace STRING, external_id STRING, created_at TIMESTAMP",
    "poll_revision": "id STRING, poll_id STRING, revision_number INT, supersedes_revision_id STRING, source_snapshot_id STRING, research_run_id STRING, origin STRING, created_by STRING, payload_hash STRING, pollster_id STRING, sponsor_id STRING, fieldwork_started_on DATE, fieldwork_ended_on DATE, published_at TIMESTAMP, collection_mode STRING, methodology STRING, created_at TIMESTAMP",
    "poll_sample": "id STRING, poll_revision_id STRING, position INT, label STRING, population STRING, sample_size INT, margin_of_error DECIMAL(6,3), attributes STRING, created_at TIMESTAMP",
    "poll_question": "id STRING, poll_revision_id STRING, contest_id STRING, position INT, text STRING, created_at TIMESTAMP",
    "poll_option": "id STRING, question_id STRING, poll_revision_id STRING, position INT, choice_entity_id STRING, label STRING, created_at TIMESTAMP",
    "poll_estimate": "id STRING, option_id STRING, sample_id STRING, poll_revision_id STRING, percentage DECIMAL(6,3), response_count INT, created_at TIMESTAMP",
    "poll_average": "id STRING, aggregator_id STRING, contest_id STRING, series_name STRING, external_namespace STRING, external_id STRING, created_at TIMESTAMP",
    "poll_average_revision": "id STRING, poll_average_id STRING, revision_number INT, supersedes_revision_id STRING, source_snapshot_id STRING, research_run_id STRING, as_of TIMESTAMP, model_version STRING, payload_hash STRING, origin STRING, created_by STRING, created_at TIMESTAMP",
    "poll_average_estimate": "id STRING, poll_average_revision_id STRING, choice_entity_id STRING, percentage DECIMAL(6,3), lower_bound DECIMAL(6,3), upper_bound DECIMAL(6,3), created_at TIMESTAMP",
    "review_decision": "id STRING, seq BIGINT, idempotency_key STRING, claim_assertion_id STRING, poll_revision_id STRING, poll_average_revision_id STRING, outcome STRING, reviewer_kind STRING, reviewer_identifier STRING, reason STRING, created_at TIMESTAMP",
    "review_task": "id STRING, claim_assertion_id STRING, poll_revision_id STRING, poll_average_revision_id STRING, created_by_run_id STRING, status STRING, priority INT, assigned_to STRING, reason STRING, created_at TIMESTAMP, completed_at TIMESTAMP",
    "political_event_projection": "entity_id STRING, event_kind STRING, contest_id STRING, location_id STRING, starts_at TIMESTAMP, starts_at_precision STRING, ends_at TIMESTAMP, ends_at_precision STRING, details STRING, projection_version INT, refreshed_at TIMESTAMP",
    "political_event_projection_claim": "event_entity_id STRING, claim_id STRING, field_name STRING, created_at TIMESTAMP",
}
#: Tables that only ever grow.
APPEND_ONLY = (
    "claim", "claim_assertion", "claim_supersession", "evidence_anchor", "artifact", "source_snapshot", "artifact_derivation", "poll_revision",
    "poll_sample", "poll_question", "poll_option", "poll_estimate", "poll_average_revision", "poll_average_estimate", "review_decision",
    "entity_redirect"
)


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


class Tables:
    """The graph's tables under one path, each with a log of its versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str) -> LoggedTable:
        return LoggedTable(self.spark, f"{self.path}/{name}", schema(name))

    def create(self) -> None:
        """Empty tables where there are none."""
        for name in TABLES:
            if not self._table(name).version():
                self._table(name).add(lambda stored: stored)

    def read(self, name: str) -> DataFrame:
        return self._table(name).read()

    def append(self, name: str, rows: DataFrame, keys: Sequence[str] = ()) -> None:
        """The only way to add rows: columns that are missing are null, unknown ones an error.

        Given keys, rows whose keys are stored already are left out, also those that another writer stores meanwhile.
        """
        if unknown := set(rows.columns) - set(schema(name).names):
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        full = self.spark.createDataFrame([], schema(name)).unionByName(rows, allowMissingColumns=True)
        self._table(name).add(lambda stored: ingest.absent(full, stored, list(keys)) if keys else full)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Refused for tables that only grow."""
        if name in APPEND_ONLY:
            raise PermissionError(f"{name} is append-only")
        self._table(name).add(lambda stored: rows, replace=True)
