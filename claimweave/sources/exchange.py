"""Market records of an exchange, from landed JSON (rows S22, S23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Prices are decimal strings of dollars.
DOLLARS = ("yes_bid_dollars", "yes_ask_dollars", "no_bid_dollars", "no_ask_dollars", "last_price_dollars")
_MARKET = "ticker STRING, title STRING, status STRING, open_time STRING, close_time STRING, volume BIGINT, " + ", ".join(
    f"{c} STRING" for c in DOLLARS
)
EVENT = f"event STRUCT<event_ticker: STRING, title: STRING, category: STRING>, markets ARRAY<STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in _MARKET.split(', '))}>>"


def events(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed event, markets nested."""
    return spark.read.schema(EVENT).json(path, multiLine=True)


def markets(found: DataFrame) -> DataFrame:
    """One row per market: dollars as DECIMAL(28,6), times as timestamps, null where unreadable."""
    rows = found.select(F.col("event.event_ticker").alias("event_ticker"), F.explode("markets").alias("m"))
    money = [F.col(f"m.{c}").try_cast("decimal(28,6)").alias(c) for c in DOLLARS]
    times = [F.try_to_timestamp(f"m.{c}").alias(c) for c in ("open_time", "close_time")]
    return rows.select("event_ticker", "m.ticker", "m.title", "m.status", "m.volume", *money, *times)
