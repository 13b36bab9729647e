"""A kept index of names by trigram (rows F33-F35, Q22, Q29).

Postings are written once, partitioned by a hash of the gram and in order of gram within a file, with how many trigrams
the name has; with them the frequency of each gram, and who bears each name. A search reads the buckets of its rarest
grams only, drops names whose size rules the similarity out, and compares what is left.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from claimweave.functions import text, trigram
from claimweave.plans.materialize import cut, landing

NAMES_PER_BUCKET = 50_000
MOST_BUCKETS = 4096
_KEPT: dict[tuple[str, str], "NameIndex"] = {}


def _grams(names: DataFrame) -> DataFrame:
    each = names.select("name", "normalized_name", trigram.trigrams(F.col("normalized_name")).alias("g"))
    return each.select("name", "normalized_name", F.size("g").alias("size"), F.explode("g").alias("gram"))


class NameIndex:
    """Tables under one path: postings(bucket, gram, size, name, normalized_name), frequency(gram, n), bearer(name, normalized_name, entity_id)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int")

    @classmethod
    def build(cls, aliases: DataFrame, names_per_bucket: int = NAMES_PER_BUCKET) -> "NameIndex":
        """Index ``aliases(entity_id, name, normalized_name)`` under a new path of the shared folder."""
        spark = aliases.sparkSession
        index = cls(spark, landing(spark, "names"), 1)
        aliases.select("entity_id", "name", "normalized_name").distinct().write.parquet(f"{index.path}/bearer")
        names = index.bearers().select("name", "normalized_name").distinct()
        index.buckets = min(MOST_BUCKETS, max(8, math.ceil(names.count() / names_per_bucket)))
        index._post(names)
        return index

    def _post(self, names: DataFrame) -> None:
        parts = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        postings = _grams(names).withColumn("bucket", self._bucket())
        dealt = postings.repartition(parts, "bucket").sortWithinPartitions("bucket", "gram", "size")
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        counted = self.postings().groupBy("gram").agg(F.count("*").alias("n"))
        counted.write.mode("overwrite").parquet(f"{self.path}/frequency")

    def add(self, aliases: DataFrame) -> None:
        """Add aliases: postings of names that are new, and bearers that are; frequencies are counted again from the postings."""
        fresh = aliases.select("entity_id", "name", "normalized_name").distinct()
        fresh = cut(fresh.join(self.bearers(), ["entity_id", "name", "normalized_name"], "left_anti"))
        names = cut(fresh.select("name", "normalized_name").distinct().join(self.bearers().select("name", "normalized_name"), ["name", "normalized_name"], "left_anti"))
        fresh.write.mode("append").parquet(f"{self.path}/bearer")
        self._post(names)

    @classmethod
    def kept(cls, aliases: DataFrame) -> "NameIndex":
        """The index of these aliases, built by the first search of an application that needs it.

        It is known by the plan and by the files that the plan reads, their sizes and times. Aliases that do not all come
        from files are indexed for this search only.
        """
        spark = aliases.sparkSession
        plan = aliases._jdf.queryExecution().analyzed()
        leaves = plan.collectLeaves()
        kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
        if kinds != {"LogicalRelation"}:
            return cls.build(aliases)
        said = [str(aliases.semanticHash()), plan.canonicalized().toString()]
        for name in sorted(aliases.inputFiles()):
            where = spark._jvm.org.apache.hadoop.fs.Path(name)
            status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
            said.append(f"{name} {status.getLen()} {status.getModificationTime()}")
        key = (spark.sparkContext.applicationId, hashlib.sha256("\n".join(said).encode()).hexdigest())
        if key not in _KEPT:
            _KEPT[key] = cls.build(aliases)
        return _KEPT[key]

    def postings(self) -> DataFrame:
        ddl = "gram string, size int, name string, normalized_name string, bucket int"
        return self.spark.read.schema(ddl).parquet(f"{self.path}/postings")

    def frequencies(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long").parquet(f"{self.path}/frequency")

    def bearers(self) -> DataFrame:
        return self.spark.read.schema("entity_id string, name string, normalized_name string").parquet(f"{self.path}/bearer")

    def probed(self, queries: DataFrame, floor: float) -> DataFrame:
        """``query, q, name, normalized_name, size`` of the names that may reach ``floor``, from the pruned buckets.

        A name as similar as that has at least floor * n of the query's n trigrams, so it has one of any n + 1 less
        that many; the rarest are looked up. Only the numbers of their buckets come to the driver.
        """
        asked = queries.select("query", trigram.trigrams(text.ascii_name(F.col("query"))).alias("q")).distinct()
        each = asked.select("query", "q", F.explode("q").alias("gram")).join(self.frequencies(), "gram", "left")
        rare = F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "gram"))
        least = F.size("q") - F.ceil(F.lit(floor) * F.size("q") - F.lit(1e-9)) + 1
        first = each.withColumn("k", rare).where((F.col("k") <= least) & F.col("n").isNotNull()).select("query", "q", "gram", self._bucket().alias("bucket"))
        wanted = sorted(r["bucket"] for r in first.select("bucket").distinct().collect())
        held = self.postings().where(F.col("bucket").isin(wanted) if wanted else F.lit(False))
        n = F.size("q")
        met = held.join(first.drop("bucket"), "gram").where(F.least(n, "size") >= floor * F.greatest(n, "size"))
        return met.select("query", "q", "name", "normalized_name", "size").distinct()

    def matches(self, queries: DataFrame, floor: float) -> DataFrame:
        """``query, name, normalized_name, whole`` with a similarity of at least ``floor``."""
        shared = F.size(F.array_intersect("q", trigram.trigrams(F.col("normalized_name"))))
        told = self.probed(queries, floor).withColumn("shared", shared)
        whole = F.col("shared") / (F.size("q") + F.col("size") - F.col("shared"))
        return told.select("query", "name", "normalized_name", whole.alias("whole")).where(F.col("whole") >= floor)
