"""Redirects and graph integrity (rows R1, G1-G4, H6-H11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimweave.plans.materialize import cut

MAX_DEPTH = 16


def edges(rows: DataFrame, source: str, target: str) -> DataFrame:
    """H6: (src, dst) of rows that have a target."""
    return rows.where(F.col(target).isNotNull()).select(F.col(source).alias("src"), F.col(target).alias("dst"))


def survivors(redirects: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``id, survivor_id, depth`` of every merged entity.

    Pointer doubling: after k rounds every pointer has gone 2^k steps or to its end, so the number of rounds is the
    logarithm of the longest chain, and of ``max_depth`` at most. Each round is a join that Spark can split, cut from
    the one before; only whether any pointer can go on is asked of it. A node on or before a cycle, or over
    ``max_depth`` from its end, has a null survivor_id; its depth is null, too.
    """
    moving = redirects.select(F.col("duplicate_id").alias("end"), F.lit(True).alias("more")).distinct()
    now = redirects.select(F.col("duplicate_id").alias("id"), F.col("canonical_id").alias("end"), F.lit(1).cast("long").alias("depth"))
    now = cut(now.join(moving, "end", "left").select("id", "end", "depth", F.coalesce("more", F.lit(False)).alias("more")))
    for _ in range(max(1, (max_depth - 1).bit_length())):
        if now.where("more").isEmpty():
            break
        on = now.select(F.col("id").alias("end"), F.col("end").alias("next"), F.col("depth").alias("further"), F.col("more").alias("still"))
        joined = now.join(on, "end", "left")
        now = cut(
            joined.select(
                "id", F.coalesce("next", "end").alias("end"), (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"),
                F.coalesce("still", F.lit(False)).alias("more")
            ), now
        )
    done = ~F.col("more") & (F.col("depth") <= max_depth)
    return now.select("id", F.when(done, F.col("end")).alias("survivor_id"), F.when(done, F.col("depth")).alias("depth"))


def resolve(ids: DataFrame, redirects: DataFrame, column: str = "id") -> DataFrame:
    """``ids`` with ``survivor_id``, the id itself where it was not merged; null where the walk has no end."""
    through = survivors(redirects).select(F.col("id").alias(column), F.col("survivor_id").alias("__s"), F.lit(True).alias("__m"))
    return ids.join(through, column, "left").withColumn("survivor_id", F.when(F.col("__m"), F.col("__s")).otherwise(F.col(column))).drop("__s", "__m")


def followed(rows: DataFrame, survivors_: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the survivor of the entity in ``column``, from the table of survivors().

    An entity on or before a cycle, or too far from its end, is an error when its row is read: it must not pass for
    one that was never merged.
    """
    through = survivors_.select(F.col("id").alias("__id"), F.col("survivor_id").alias("__s"), F.lit(True).alias("__m"))
    lost = F.raise_error(F.concat(F.lit("the redirects of "), F.col(column), F.lit(" go in a cycle or too far")))
    end: Column = F.when(F.col("__m") & F.col("__s").isNull(), lost).otherwise(F.coalesce("__s", column))
    return rows.join(through, F.col(column) == F.col("__id"), "left").withColumn(name, end).drop("__id", "__s", "__m")


def rings(graph: DataFrame) -> DataFrame:
    """G1: ``id, leader, position, next`` of the nodes that are on a cycle of (src, dst), at most one edge from each node.

    Walks double in length each round, and carry the smallest node that they meet. A round in which no walk ends shows
    that none ever will, and one in which no two walks come together that all end on cycles; nodes that only lead into
    a cycle are not listed. So rounds are the logarithm of the longest path outside of cycles, not of the graph. The
    leader is the cycle's smallest node, found by doubling on among its nodes; a node's position is its distance from
    the leader, found by list ranking with the leader's ring opened.
    """
    steps = cut(graph.select("src", "dst").where("src is not null and dst is not null").distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.count_distinct("dst")).first())
    walks, reach, was = steps.withColumn("leader", F.least("src", "dst")), 1, state(steps)

    def doubled(df: DataFrame) -> DataFrame:
        on = df.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("leader").alias("theirs"))
        return df.join(on, "dst").select("src", F.col("next").alias("dst"), F.least("leader", "theirs").alias("leader"), F.col("leader").alias("was"))

    while was[0]:
        walks, reach = cut(doubled(walks).drop("was"), walks), 2 * reach
        if (now := state(walks)) == was:
            break
        was = now
    ends = walks.select(F.col("dst").alias("src")).distinct()
    held = cut(steps.join(walks.select("src", F.col("dst").alias("far"), "leader"), "src").join(ends, "src", "left_semi"))
    size = held.count()
    if not size:
        return held.select(F.col("src").alias("id"), "leader", F.lit(0).cast("long").alias("position"), F.col("dst").alias("next"))
    named, held = held.select("src", F.col("far").alias("dst"), "leader"), held.select("src", "dst")
    while reach < size:
        named = cut(doubled(named), named)
        reach *= 2
        if named.where("leader <> was").isEmpty():
            break
    led = cut(held.join(named.select("src", "leader"), "src"))
    # Distance to the leader along the ring: the leader's own edge is left out, so that every walk ends.
    left = led.select("src", "leader", F.when(F.col("src") == F.col("leader"), F.col("src")).otherwise(F.col("dst")).alias("at"))
    left = left.withColumn("far", F.when(F.col("src") == F.col("leader"), 0).otherwise(1).cast("long"))
    while not left.where("at <> leader").isEmpty():
        on = left.select(F.col("src").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"))
        left = cut(left.join(on, "at").select("src", "leader", F.col("next").alias("at"), (F.col("far") + F.col("more")).alias("far")), left)
    sizes = left.groupBy("leader").agg(F.count("*").alias("n"))
    placed = left.join(sizes, "leader").select("src", "leader", F.pmod(F.col("n") - F.col("far"), F.col("n")).alias("position"))
    return placed.join(held, "src").select(F.col("src").alias("id"), "leader", "position", F.col("dst").alias("next"))


def cycle_members(graph: DataFrame) -> DataFrame:
    """G1: the nodes that are on a cycle."""
    return rings(graph).select("id")


def paths(graph: DataFrame) -> DataFrame:
    """G1: ``leader, path`` of every cycle, as text from the leader and back to it; a path is as long as its cycle."""
    found = rings(graph).groupBy("leader").agg(F.sort_array(F.collect_list(F.struct("position", "id"))).alias("p"))
    return found.select("leader", F.concat(F.array_join("p.id", " > "), F.lit(" > "), "leader").alias("path"))


def chains(redirects: DataFrame) -> DataFrame:
    """Redirects whose target is itself redirected."""
    on = redirects.select(F.col("duplicate_id").alias("canonical_id"))
    return redirects.join(on, "canonical_id", "left_semi").select("duplicate_id", "canonical_id")


def check(graphs: dict[str, DataFrame]) -> DataFrame:
    """(graph, id, leader, position) of every node on a cycle, over the named edge tables, in one pass."""
    names = sorted(graphs)
    node = lambda k, c: F.struct(F.lit(k).alias("g"), F.col(c).cast("string").alias("n")).alias(c)
    parts = [graphs[n].select(node(k, "src"), node(k, "dst")) for k, n in enumerate(names)]  # by number, since rounds shuffle them
    out = parts[0].where("src.n is not null and dst.n is not null")
    for p in parts[1:]:
        out = out.unionByName(p.where("src.n is not null and dst.n is not null"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("id.g") + 1)
    return rings(out).select(name.alias("graph"), F.col("id.n").alias("id"), F.col("leader.n").alias("leader"), "position")


def assert_sound(graphs: dict[str, DataFrame]) -> None:
    """Raises if any graph has a cycle."""
    if found := check(graphs).limit(5).collect():
        raise ValueError(f"cycles: {[(r['graph'], r['id']) for r in found]}")


def terminal(graph: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The last successor of every superseded row."""
    return survivors(graph.select(F.col("src").alias("duplicate_id"), F.col("dst").alias("canonical_id")), max_depth)
