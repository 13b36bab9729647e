"""The closest names of many queries at once, by trigram similarity (rows F33, Q29).

A threshold finds too much where names are alike: of names that differ by a number only, each query matches all. So the
threshold falls in steps, and a query that has its hits at one step does not go on to the next. Names of one trigram set
are one class, of which the first bearers count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimweave.functions import text, trigram
from claimweave.plans.materialize import cut

#: Thresholds before the last one, which is the caller's.
STEPS = (0.8, 0.65)
#: Below this two sets may share one trigram only, and pairs of trigrams would miss them.
LEAST_FLOOR = 0.34


def _coded(name: Column) -> Column:
    """The trigrams of a name as numbers: three code points of 21 bits each."""
    at = lambda g, i, bits: F.shiftleft(F.ascii(F.substring(g, i, 1)).cast("long"), bits)
    return F.transform(trigram.trigrams(name), lambda g: at(g, 1, 42) + at(g, 2, 21) + at(g, 3, 0))


def _ordered(rows: DataFrame, key: str, frequencies: DataFrame) -> DataFrame:
    """``key, g``: the trigrams that have a frequency, rarest first."""
    each = rows.select(key, F.explode("g").alias("gram")).join(frequencies, "gram")
    rare = F.array_sort(F.collect_list(F.struct("n", "gram")))
    return each.groupBy(key).agg(rare.alias("r")).select(key, F.col("r.gram").alias("g"))


def _pairs(size: Column, g: Column, length: Column) -> Column:
    """The pairs of the first ``length`` trigrams, with the size of the set that is looked for."""
    first = F.slice(g, 1, F.greatest(F.lit(0), length))
    return F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda b: F.xxhash64(size, a, b))))


def closest(aliases: DataFrame, queries: DataFrame, floor: float, limit: int) -> DataFrame:
    """``query, rank, entity_id, name, whole``: the ``limit`` most similar of aliases(entity_id, name, normalized_name).

    Best first, by similarity to nine places, name and id. Sets of n and s trigrams that are as similar as f share
    f * (n + s) / (1 + f) at least. So with their trigrams in one order, rarest first, the two rarest that they share
    are among the first of each, as many as it may lack and two; sets that share no such pair are never compared.
    """
    if floor < LEAST_FLOOR:
        raise ValueError(f"the floor must be {LEAST_FLOOR} at least")
    named = aliases.select("entity_id", "name", F.array_sort(_coded(F.col("normalized_name"))).alias("g")).where(F.size("g") > 0)
    named = named.withColumn("class", F.sha2(F.array_join("g", " "), 256)).distinct()
    best = Window.partitionBy("class").orderBy("name", "entity_id")
    bearers = cut(named.withColumn("k", F.row_number().over(best)).where(F.col("k") <= limit).drop("k"))
    sets = bearers.dropDuplicates(["class"]).select("class", "g")
    frequencies = cut(sets.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))
    size = F.size("g")
    lack = lambda held, least: held - F.ceil(least - F.lit(1e-9)).cast("int") + 2
    posted = _ordered(sets, "class", frequencies).select("class", "g", F.explode(_pairs(size, F.col("g"), lack(size, F.lit(floor) * size))).alias("pair"))
    posted = cut(posted.withColumnsRenamed({"g": "theirs"}))
    sizes = cut(sets.select(size.alias("s")).distinct())
    asked = queries.select("query").distinct().select("query", _coded(text.ascii_name(F.col("query"))).alias("g"))
    known = _ordered(asked, "query", frequencies).withColumnRenamed("g", "ours")
    left = cut(asked.select("query", size.alias("n")).join(known, "query"))
    done = None
    for f in (*(f for f in STEPS if f > floor), floor):
        met = left.withColumn("s", F.explode(F.sequence(F.ceil(F.lit(f - 1e-9) * F.col("n")).cast("int"), F.floor(F.col("n") / F.lit(f - 1e-9)).cast("int"))))
        least = F.lit(f / (1 + f)) * (F.col("n") + F.col("s"))
        probes = met.join(sizes, "s").select("query", "n", "ours", F.explode(_pairs(F.col("s"), F.col("ours"), lack(F.size("ours"), least))).alias("pair"))
        shared = probes.join(posted, "pair").withColumn("shared", F.array_intersect("ours", "theirs"))
        # A pair of sets counts where it meets by the two rarest that it shares, so once.
        here = F.col("pair") == F.xxhash64(F.size("theirs"), F.get("shared", F.lit(0)), F.get("shared", F.lit(1)))
        whole = F.size("shared") / (F.col("n") + F.size("theirs") - F.size("shared"))
        alike = shared.where((F.size("shared") >= 2) & here).select("query", "class", whole.alias("whole")).where(F.col("whole") >= f)
        order = Window.partitionBy("query").orderBy(F.round("whole", 9).desc(), "name", "entity_id")
        hits = alike.join(bearers.select("class", "name", "entity_id"), "class").drop("class")
        hits = cut(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit))
        # What is just at the step may tie with what is just below it.
        full = hits.where((F.col("rank") == limit) & (F.col("whole") > f + 1e-8)).select("query") if f > floor else left.select("query")
        kept = hits.join(full, "query", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        if f > floor:
            left = cut(left.join(full, "query", "left_anti"))
    return done.select("query", "rank", "entity_id", "name", "whole")
