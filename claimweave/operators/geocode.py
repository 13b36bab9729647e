"""Batch geocoding with a pluggable backend (rows P1-P5, S24, H41-H42)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimweave.functions import parse

BATCH = 10_000
ATTEMPTS = 3
BACKOFF = 2.0
#: Columns of the batch service's answer.
ANSWER = ("key", "input", "match", "match_type", "matched_address", "coordinates", "line_id", "side", "state", "county", "tract", "block")
_DDL = ", ".join(f"{c} STRING" for c in ANSWER)
RESULT = "key string, quality string, matched_address string, lon double, lat double, geoid string"


def request_line(key, street, city, state, postcode):
    """A line of the request."""
    return F.to_csv(
        F.struct(key.alias("a"), street.alias("b"), city.alias("c"), state.alias("d"), postcode.alias("e")), {"quoteAll": "true", "escape": '"'}
    )


def parsed(answers: DataFrame) -> DataFrame:
    """answers(line) -> results. A match without coordinates is none; located only if a point is there."""
    row = answers.select(F.from_csv("line", _DDL, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    point = parse.coordinates(F.col("coordinates"))
    found = (F.lower("match") == "match") & point["lon"].isNotNull()
    quality = F.when(
        found & (F.lower("match_type") == "exact"), "exact"
    ).when(found, "approximate").when(F.lower("match") == "tie", "tie").otherwise("no_match")
    keep = lambda c: F.when(found, c)
    return row.select(
        "key", quality.alias("quality"), keep(F.col("matched_address")).alias("matched_address"), keep(point["lon"]).alias("lon"),
        keep(point["lat"]).alias("lat"), keep(parse.geoid(F.col("state"), F.col("county"), F.col("tract"), F.col("block"))).alias("geoid")
    )


class Unavailable(Exception):
    """What a service raises when it failed but may answer if it is asked again."""


def geocode(
    addresses: DataFrame, service: Callable[[list[str]], list[str]], batch: int = BATCH, attempts: int = ATTEMPTS, backoff: float = BACKOFF
) -> DataFrame:
    """One result per address(key, street, city, state, postcode); what is not answered is no match.

    ``service`` takes at most ``batch`` request lines and returns answer lines; it runs in the tasks. If it raises
    Unavailable, or the network fails, the batch is asked again, up to ``attempts`` times in all, after ``backoff``
    seconds times the number of failures; another error is final.
    """

    def answered(lines: list[str]) -> pa.RecordBatch:
        for failed in range(1, attempts + 1):
            try:
                return pa.RecordBatch.from_arrays([pa.array(service(lines), pa.string())], ["line"])
            except (Unavailable, OSError) as error:
                if failed == attempts:
                    raise RuntimeError(f"the geocoder failed {attempts} times for a batch of {len(lines)}") from error
                time.sleep(backoff * failed)
        raise AssertionError("at least one attempt")

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for part in parts:
            held += part.column("line").to_pylist()
            while len(held) >= batch:
                yield answered(held[:batch])
                held = held[batch:]
        if held:
            yield answered(held)

    lines = addresses.select(request_line(*(F.col(c) for c in ("key", "street", "city", "state", "postcode"))).alias("line"))
    answers = parsed(lines.mapInArrow(ask, "line string")).dropDuplicates(["key"])
    return addresses.select("key").join(answers, "key", "left").withColumn("quality", F.coalesce("quality", F.lit("no_match")))


def broken(results: DataFrame) -> DataFrame:
    """Results whose quality and point disagree."""
    located = F.col("quality").isin("exact", "approximate")
    return results.where(located != F.col("lon").isNotNull())
