"""Constraints as queries that return the rows which break them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

HASH = "^[0-9a-f]{64}$"


def _named(rows: DataFrame, constraint: str, key: Column) -> DataFrame:
    return rows.select(F.lit(constraint).alias("constraint"), key.cast("string").alias("key"))


def broken(rows: DataFrame, constraint: str, key: str, holds: Column) -> DataFrame:
    """Shape, format, range, pairing, state: rows where the condition is false; null passes, as in SQL."""
    return _named(rows.where(~F.coalesce(holds, F.lit(True))), constraint, F.col(key))


def repeated(rows: DataFrame, constraint: str, keys: list[str], where: str = "true") -> DataFrame:
    """Unique, also with nulls alike or over part of the rows: keys that stand more than once."""
    many = rows.where(where).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return _named(many, constraint, F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)))


def dangling(rows: DataFrame, constraint: str, column: str, parents: DataFrame, parent: str) -> DataFrame:
    """Foreign key: values that no parent has."""
    known = parents.select(F.col(parent).alias(column))
    return _named(rows.where(F.col(column).isNotNull()).join(known, column, "left_anti").select(column).distinct(), constraint, F.col(column))


def one_of(*columns: str) -> Column:
    """Exactly one of the columns is set."""
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNotNull().cast("int")
    return total == 1


def member(column: str, values: Iterable[str]) -> Column:
    """A checked enumeration."""
    return F.col(column).isin(*values)


def matched(column: str, pattern: str = HASH) -> Column:
    return F.col(column).rlike(pattern)


def run_state() -> Column:
    """A running run has no end and no error, a finished one an end, a failed one an error."""
    status = F.col("status")
    return ((status == "running") == F.col("completed_at").isNull()) & ((status == "failed") == F.col("error_message").isNotNull())


def paired(a: str, b: str) -> Column:
    """Both or neither."""
    return F.col(a).isNull() == F.col(b).isNull()


def all_of(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
