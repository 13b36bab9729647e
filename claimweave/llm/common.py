"""What the training-data operators share: the shared scratch folder and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 256
BATCH_BYTES = 8 << 20
_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs in one process, as in tests, a temporary folder stands in. On a
    cluster a missing setting is an error, since executors could not see a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _FALLBACK:
        _FALLBACK[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="claimweave-")
    return _FALLBACK[context.applicationId]


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor re-reads them instead of recomputing.

    The folder goes when the driver's process ends, since plans that callers still hold read from it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/claimweave/{name}-{uuid.uuid4().hex}"
        path, files = self._handle(self.base)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _handle(self, where: str) -> tuple:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no remaining plan reads."""
        for name in names:
            path, files = self._handle(self.path(name))
            files.delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes, since a single document can be very long.

    The bounds are the same for all operators, so that plans built one after the other don't change each other's.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
