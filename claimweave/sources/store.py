"""Content-addressed objects in a logged table (rows S15-S17, S20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimweave.functions import canon
from claimweave.plans.commits import LoggedTable

MAX_BYTES = 32 << 20
DDL = "sha256 string, content binary, byte_length long"


class ObjectStore:
    """Objects under their digest. Any path that Spark can write to will do: local, HDFS or an object store."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = LoggedTable(spark, path, DDL)

    def objects(self) -> DataFrame:
        return self.table.read()

    def put(self, contents: DataFrame) -> DataFrame:
        """Store ``contents(content)`` once each; objects over the size limit are refused. -> (sha256, key).

        Writers that put the same object at the same time leave one.
        """
        hashed = contents.where("content is not null").select(
            F.sha2("content", 256).alias("sha256"), "content", F.octet_length("content").cast("long").alias("byte_length")
        )
        fine = hashed.where(F.col("byte_length") <= MAX_BYTES)
        self.table.add(lambda stored: fine.dropDuplicates(["sha256"]).join(stored.select("sha256"), "sha256", "left_anti"))
        return fine.select("sha256", canon.content_key(F.col("sha256")).alias("key")).distinct()

    def get(self, digests: DataFrame) -> DataFrame:
        """The objects of some digests; the digest reaches the scan as a semi-join."""
        return self.objects().join(digests.select("sha256").distinct(), "sha256", "left_semi")

    def missing(self, digests: DataFrame) -> DataFrame:
        """Digests that are not stored."""
        return digests.select("sha256").distinct().join(self.objects().select("sha256"), "sha256", "left_anti")


def already_archived(snapshots: DataFrame) -> DataFrame:
    """Artifacts that more than one snapshot shows."""
    return snapshots.groupBy("sha256").agg(F.count("*").alias("snapshots")).where("snapshots > 1")
