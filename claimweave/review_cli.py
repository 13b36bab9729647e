"""The reviewer's commands over parquet tables (row V10): list, show, next, accept, reject, merge.

``python -m claimweave.review_cli --tables FOLDER COMMAND …`` reads FOLDER/tasks (id, target, status, priority,
created_at), FOLDER/decisions (seq, target, outcome, reviewer, token, reason, task_id) and FOLDER/redirects
(duplicate_id, canonical_id, reason, created_by), and appends to the last two. Tables are only added to: a task with a decision is closed.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.operators import review

SCHEMAS = {
    "tasks": "id string, target string, status string, priority int, created_at timestamp",
    "decisions": "seq long, target string, outcome string, reviewer string, token string, reason string, task_id string",
    "redirects": "duplicate_id string, canonical_id string, reason string, created_by string",
}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="review")
    top.add_argument("--tables", required=True)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list"), commands.add_parser("next")
    for name in ("show", "accept", "reject"):
        command = commands.add_parser(name)
        command.add_argument("task", help="the beginning of a task's id")
        if name != "show":
            command.add_argument("--reviewer", required=True)
            command.add_argument("--reason", default="" if name == "accept" else None, required=name == "reject")
    merge = commands.add_parser("merge")
    merge.add_argument("duplicate"), merge.add_argument("canonical")
    merge.add_argument("--reviewer", required=True), merge.add_argument("--reason", required=True)
    return top


class Desk:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = jvm.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
        return self.spark.read.schema(SCHEMAS[name]).parquet(path) if there else self.spark.createDataFrame([], SCHEMAS[name])

    def tasks(self) -> DataFrame:
        """All tasks; those that have a decision are completed."""
        done = self.table("decisions").select(F.col("task_id").alias("id")).distinct().withColumn("done", F.lit(True))
        tasks = self.table("tasks").join(done, "id", "left")
        return tasks.withColumn("status", F.when(F.col("done"), "completed").otherwise(F.col("status"))).drop("done")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*self.table(name).columns).write.mode("append").parquet(f"{self.folder}/{name}")

    def decide(self, prefix: str, outcome: str, reviewer: str, reason: str) -> str:
        task = review.find_task(self.tasks(), prefix).first()
        token = F.lit(f"{outcome}:{task['id']}")
        wanted = self.spark.range(1).select(
            F.lit(task["id"]).alias("task_id"), F.lit(outcome).alias("outcome"), F.lit(reviewer).alias("reviewer"), token.alias("token"),
            F.lit(reason).alias("reason")
        )
        appended, refused = review.decide(self.tasks(), self.table("decisions"), wanted)
        if why := refused.first():
            raise ValueError(why["why"])
        self.append("decisions", appended)
        return f"{outcome} {task['id']}"

    def merge(self, duplicate: str, canonical: str, reviewer: str, reason: str) -> str:
        redirects = self.table("redirects")
        wanted = self.spark.createDataFrame([(duplicate, canonical, reason)], "duplicate_id string, canonical_id string, reason string")
        done, refused = review.merges(redirects, wanted)
        if why := refused.first():
            raise ValueError(why["why"])
        end = done.first()["canonical_id"]
        self.append("redirects", self.spark.createDataFrame([(duplicate, end, reason.strip(), reviewer.strip())], SCHEMAS["redirects"]))
        return f"{duplicate} is now {end}"


def _said(row) -> str:
    return "\t".join("" if row[c] is None else str(row[c]) for c in ("id", "status", "priority", "target"))


def run(spark: SparkSession, arguments: Sequence[str]) -> list[str]:
    """The lines that a command prints. A refusal raises ValueError, an unknown or ambiguous task LookupError."""
    given = _parser().parse_args(arguments)
    desk = Desk(spark, given.tables)
    if given.command in ("list", "next"):
        return [_said(r) for r in review.pending(desk.tasks(), limit=50 if given.command == "list" else 1).collect()]
    if given.command == "show":
        return [_said(review.find_task(desk.tasks(), given.task).first())]
    if given.command == "merge":
        return [desk.merge(given.duplicate, given.canonical, given.reviewer, given.reason)]
    return [desk.decide(given.task, {"accept": "accepted", "reject": "rejected"}[given.command], given.reviewer, given.reason)]


if __name__ == "__main__":
    import sys

    print("\n".join(run(SparkSession.builder.getOrCreate(), sys.argv[1:])))
