"""Batches are added once, whoever else writes; records fail alone."""

import datetime as dt
import threading

from pyspark.sql import functions as F

from claimweave.operators import ingest as I, runs
from claimweave.plans.commits import LoggedTable
from claimweave.sources.store import ObjectStore


def fresh(rows):
    return lambda stored: rows.join(stored.select("k"), "k", "left_anti")


def test_a_writer_that_was_overtaken_makes_its_rows_anew(spark, tmp_path):
    t = LoggedTable(spark, str(tmp_path / "t"), "k long, by string")
    batch = spark.range(10).select(F.col("id").alias("k"))
    calls = []

    def slow(stored):
        calls.append(stored.count())
        if len(calls) == 1:  # another writer commits the same batch while this one is at work
            assert LoggedTable(spark, str(tmp_path / "t"), "k long, by string").add(fresh(batch.withColumn("by", F.lit("other")))) == 1
        return fresh(batch.withColumn("by", F.lit("slow")))(stored)

    assert t.add(slow) == 2 and calls == [0, 10]
    assert {r["by"] for r in t.read().collect()} == {"other"} and t.read().count() == 10
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == 2  # what lost was dropped


def test_writers_at_the_same_time_leave_one_copy(spark, tmp_path):
    store = str(tmp_path / "s")
    contents = spark.createDataFrame([(bytes([k]),) for k in range(20)], "content binary")
    threads = [threading.Thread(target=lambda: ObjectStore(spark, store).put(contents)) for _ in range(4)]
    [x.start() for x in threads], [x.join() for x in threads]
    objects = ObjectStore(spark, store).objects()
    assert objects.count() == 20 == objects.select("sha256").distinct().count() and ObjectStore(spark, store).table.version() == 4


def test_a_killed_writer_leaves_nothing(spark, tmp_path):
    t = LoggedTable(spark, str(tmp_path / "t"), "k long")
    t.add(lambda stored: spark.range(3).select(F.col("id").alias("k")))
    spark.range(9).select(F.col("id").alias("k")).write.parquet(str(tmp_path / "t" / "data-lost"))  # written, never claimed
    (tmp_path / "t" / "_log" / ".draft").write_text("[")
    assert t.read().count() == 3
    t.add(lambda stored: stored.where("k = 1"), replace=True)
    assert [r["k"] for r in t.read().collect()] == [1] and t.version() == 2


def test_records_fail_alone(spark):
    s = "array<struct<entered:timestamp,left:timestamp,entered_precision:string>>"
    day = lambda x: dt.datetime.fromisoformat(x)
    rows = [
        ("fine", "c", "k", [(day("2026-01-01"), day("2026-02-01"), "month")]), ("overlap", "c", "k", [(day("2026-01-01"), None, None), (day("2026-03-01"), None, None)]),
        ("backwards", "c", "k", [(day("2026-02-01"), day("2026-01-01"), None)]), ("bare", "c", "k", None)
    ]
    claims, errors = I.judged_records(spark.createDataFrame(rows, f"record_id string, candidate_id string, contest_id string, stints {s}"), "candidacy")
    assert {tuple(r) for r in errors.collect()} == {("overlap", "stints overlap"), ("backwards", "ends before it begins")}
    assert {(r["record_id"], r["valid_from_precision"], r["valid_to_precision"]) for r in claims.collect()} == {("fine", "month", "day"), ("bare", None, None)}
    gifts = spark.createDataFrame([("a", "d", "r", "5.50", None), ("b", "d", "r", "-5", None), ("c", "d", "r", "1", "gift")], "record_id string, donor_id string, recipient_id string, amount string, kind string")
    gifts = gifts.withColumns({c: F.lit(None).cast("string") for c in ("currency", "purpose")} | {"supporting": F.lit(None).cast("boolean"), "given": F.lit("2026-01-01").cast("timestamp")})
    claims, errors = I.judged_records(gifts, "donation")
    assert [r["record_id"] for r in claims.collect()] == ["a"]
    assert {r[0]: r[1] for r in errors.collect()} == {"b": "donated_to: amount is less than 0", "c": "donated_to: kind is none of the allowed"}
    claims, errors = I.judged_records(gifts, "banquet")
    assert claims.count() == 0 and {r["error"] for r in errors.collect()} == {"unknown type banquet"}
    none = spark.createDataFrame([], "idempotency_key string, fingerprint string")
    told, report = runs.run_import(gifts.withColumns({"index": F.lit(0), "snapshot": F.lit("s")}), "donation", None, "run", none, none)
    assert report.first().asDict() == {"imported": 1, "failed": 2, "created": 1, "corroborated": 0, "unchanged": 0}
