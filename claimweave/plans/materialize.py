"""Cutting lineage between the rounds of an iterative plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="claimweave-")
    return _LOCAL[context.applicationId]


def landing(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder; what is there goes when the driver's process ends."""
    parent = f"{_folder(spark)}/claimweave/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{parent}/data"


_WHERE = "_claimweave_folder"


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: survives lost executors, and later plans know its size.

    ``done`` are tables that cut() gave and that no plan reads after this one: a loop's last round. They are removed.
    """
    spark, where = df.sparkSession, landing(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(where)
    for old in done:
        if folder := getattr(old, _WHERE, None):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    out = spark.read.schema(df.schema).parquet(where)
    setattr(out, _WHERE, where.rsplit("/", 1)[0])
    return out


#: Files of this many bytes hold some ten times as many in memory.
LARGE = 1 << 20


def large(df: DataFrame) -> bool:
    """Whether a table that cut() gave is too large to send to every executor."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(getattr(df, _WHERE))
    files = path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(path).getLength() > LARGE


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for joins that deal the rows of both sides by key.

    Spark judges tables read from files by the size of these, which compression makes a small part of the rows' in
    memory, and would send the whole of one through the driver to every executor.
    """
    return df.hint("merge")


def kept(df: DataFrame) -> DataFrame:
    """cut(), for a table whose joins deal rows by key if it is large."""
    out = cut(df)
    return dealt(out) if large(out) else out
