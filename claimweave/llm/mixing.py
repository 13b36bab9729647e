"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source; targets follow from the weights by water-filling with a cap; each document is then
emitted floor(rate) times, plus once more where a uniform number seeded by its id and text is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimweave.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
BROADCAST_BYTES = 4 << 20
SALTS = 64


def n_words(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of seed, id and text: the same in every run."""
    seeded = F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(seeded.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size)``, one row per source -> the same with ``target`` and ``rate``.

    A source's target is the smaller of its cap (MOST_REPEATS times its size) and level * weight; the level is the
    one at which targets sum to all sizes. Sources with the smallest cap/weight reach their caps first, so the level
    is found from running sums in that order: the first that no further source's cap undercuts, which is the largest
    of those that hold. The table has one row per source, not per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    capped = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy((F.col("cap").cast("double") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("w").over(rest)
    held = capped.withColumn("level", level)
    held = held.withColumn("level", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
    final = held.withColumn("level", F.max("level").over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST_REPEATS)), target / F.col("source_size"))).otherwise(F.lit(0.0))
    return final.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _with_source(sized: DataFrame, per: DataFrame) -> DataFrame:
    """Each document with its source's row.

    Sources of up to BROADCAST_BYTES in all are broadcast, so documents stay where they are. Larger tables are joined
    by source and salt, which cuts a source of any size into SALTS parts.
    """
    same = F.col("source").eqNullSafe(F.col("__source"))
    size = per.agg(F.sum(64 + F.coalesce(F.octet_length("__source"), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return sized.join(F.broadcast(per), same)
    salted = per.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    drawn = sized.withColumn("__mine", F.floor(F.col("__u") * SALTS).cast("int"))
    return drawn.join(salted, same & (F.col("__mine") == F.col("__salt"))).drop("__salt", "__mine")


def _drawn(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__size, __source_size, __target, __rate, __copies``."""
    sized = docs.withColumns({"__size": n_words(F.col("text")), "__u": uniform(F.col("doc_id"), F.col("text"))})  # so texts needn't pass the join
    per = targets(sized.groupBy("source").agg(F.sum("__size").alias("source_size")))
    per = per.select(*(F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target", "rate")))
    joined = _with_source(sized, Scratch(docs.sparkSession, "mixing").table(per, "sources")).drop("__source")
    whole = F.floor("__rate")
    return joined.withColumn("__copies", (whole + (F.col("__u") < F.col("__rate") - whole).cast("long")).cast("long")).drop("__u")


def with_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies``: how often the mix takes each row.

    A null text has size 0; a null source is a source of its own, ordered last. Texts of size 0 are taken by the same
    rule and add nothing; where all documents of a source are empty its rate is 0. Repeated rows get equal decisions.
    Columns of docs with these names are replaced. No row is dropped; an empty table gives an empty table.
    """
    names = ("size", "source_size", "target", "rate", "copies")
    return _drawn(docs.drop(*names)).withColumnsRenamed({f"__{n}": n for n in names})


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as with_copies() says."""
    many = _drawn(docs).where("__copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return many.select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
           FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
     w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM s),
     l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                     / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
     m AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS held FROM l),
     t AS (SELECT source, source_size, CASE WHEN held IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, held * w) END AS target FROM m),
     r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target, (d.size * (floor(r.rate)::BIGINT + (d.u < r.rate - floor(r.rate))::BIGINT))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
