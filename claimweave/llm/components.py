"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge already points from the larger to the smaller end."""
    least = edges.groupBy("u").agg(F.min("v").alias("w"))
    moved = edges.join(least, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return moved.union(least.select("u", F.col("w").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``edges(u, v)`` of any integer type -> ``(u, v)``: v is the smallest node that u, not itself smallest, reaches.

    Nodes without an edge to a smaller node are absent: they are their own component. Loops and repeated edges are
    ignored; no edges give an empty table. Each round is aggregations and joins, which Spark can split where one
    node has very many neighbours, and is written to the shared folder. Nothing is collected but a checksum.
    """
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    mark, k = _mark(now), 0
    while mark[0]:
        after = scratch.table(_small_star(_large_star(now)), f"{name}{k + 1}")
        scratch.drop(f"{name}{k}")
        k, now, before, mark = k + 1, after, mark, _mark(after)
        if mark == before:
            break
    return now
