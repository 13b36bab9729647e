"""Connected components of an undirected graph, as joins and aggregations (used by resolution within a batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimweave.plans.materialize import cut, dealt


def connected(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``id, root``: the smallest node that each node reaches, for every node of an edge.

    Each round a node takes the smallest root among its own and its neighbours', and then the root of that root, so
    that distances halve. A round is written to the shared folder; only how many labels changed is asked of it.
    """
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).where("u is not null and v is not null").distinct())
    if both.isEmpty():
        return both.select(F.col("u").alias("id"), F.col("u").alias("root"))
    now = cut(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        seen = both.join(dealt(now.select(F.col("id").alias("v"), "root")), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("near"))
        hooked = now.join(dealt(seen), "id").select("id", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        # What a node learned is passed on to its old root, so that whole trees are hooked, not single leaves.
        told = hooked.select(F.col("old").alias("id"), "new").union(hooked.select("id", "new")).groupBy("id").agg(F.min("new").alias("new"))
        jump = told.select(F.col("id").alias("new"), F.col("new").alias("further"))
        after = told.join(dealt(jump), "new", "left").select("id", F.coalesce("further", "new").alias("root"))
        now = cut(after.join(dealt(now.select("id", F.col("root").alias("was"))), "id"), now)
        if now.where("root <> was").isEmpty():
            return now.select("id", "root")
