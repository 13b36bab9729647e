"""Fetching documents through a client that is given as a function (rows S19, S20, O1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimweave.functions import canon
from claimweave.sources.store import MAX_BYTES

#: Statuses of 400 and more are refusals, and a client may wait so many seconds.
REFUSED, TIMEOUT_SECONDS = 400, 120.0
RESULT = "url string, status int, content binary, error string, retryable boolean"


def fetched(urls: DataFrame, get: Callable[[str, float], tuple[int, bytes]]) -> DataFrame:
    """One row per distinct ``urls(url)``: status and content, or an error and whether trying again may help.

    ``get(url, seconds)`` returns a status and a body and runs in the tasks; OSError is a failure of transport, which
    is worth another try. A refusal and a body over the store's limit are not. A null url is left out.
    """

    def one(url: str) -> tuple:
        try:
            status, body = get(url, TIMEOUT_SECONDS)
        except OSError as failure:
            return url, None, None, f"{type(failure).__name__}: {failure}", True
        if status >= REFUSED:
            return url, status, None, f"status {status}", False
        if len(body) > MAX_BYTES:
            return url, status, None, f"{len(body)} bytes", False
        return url, status, body, None, False

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.string(), pa.bool_())
        names = ["url", "status", "content", "error", "retryable"]
        for part in parts:
            for url in part.column("url").to_pylist():  # a body may be large, so each is a batch of its own
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one(url), kinds)], names)

    return urls.where("url is not null").select("url").distinct().mapInArrow(run, RESULT)


def cited(records: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O1: ``records(record_id, url)`` -> (those whose source was fetched, with its digest, those skipped, with the error).

    A source that cannot be had costs its own records only.
    """
    told = records.join(found.select("url", F.sha2("content", 256).alias("sha256"), "error", "retryable"), "url", "left")
    fine = told.where("sha256 is not null").select("record_id", "url", "sha256", canon.content_key(F.col("sha256")).alias("content_key"))
    return fine, told.where("sha256 is null").select(
        "record_id", "url", F.coalesce("error", F.lit("no url")).alias("error"), F.coalesce("retryable", F.lit(False)).alias("retryable")
    )
