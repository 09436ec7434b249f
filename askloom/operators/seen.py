"""Keep-first deduplication across runs: an index of the pairs that have been kept.

The index is a Parquet folder of keys, the SHA-256 of a pair's normalised texts, in a fixed number of buckets by key and
sorted within each file. A later run joins its own pairs to it: they are shuffled to the index's buckets, which is read
where it lies, so the cost of a run follows the run's size, not that of all runs before. New keys are added to the buckets
as further files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.storage import folder, materialise, qualified
from .pairs import deduplicate


def pair_key(question: str = "question", answer: str = "answer") -> Column:
    """Of normalised texts, each after its length, so that no two pairs run into one another; missing texts are empty."""
    texts = [normalize(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in (question, answer)]
    return F.unhex(F.sha2(F.concat_ws("\n", *[x for t in texts for x in (F.length(t).cast("string"), t)]), 256))


class SeenPairs:
    """The index at a path on shared storage. buckets: for a new index; more than the session's shuffle partitions, or they would be shuffled.

    The session's catalog holds a table over the folder, so any session with the same path and buckets goes on with it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200):
        self.spark, self.path = spark, qualified(spark, folder(spark, path))
        self.buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = f"askloom_seen_{re.sub(r'[^0-9a-zA-Z]', '_', self.path)}"[-120:].lower().lstrip("_")
        if not spark.catalog.tableExists(self.table):
            spark.sql(f"CREATE TABLE {self.table} (key BINARY) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        else:
            spark.catalog.refreshTable(self.table)

    def keys(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, pairs: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
        """The pairs whose key is not in the index, with it; the index's side is not shuffled."""
        keyed = pairs.withColumn("_key", pair_key(question, answer))
        return keyed.join(self.keys().hint("merge"), F.col("_key") == F.col("key"), "left_anti")

    def keep(self, pairs: DataFrame, order: list[str], question: str = "question", answer: str = "answer") -> DataFrame:
        """The first, in order, of those pairs alike that no run before has kept, on shared storage; their keys join the index."""
        fresh = materialise(deduplicate(self.unseen(pairs, question, answer), order, question, answer), "fresh")
        keys = fresh.select(F.col("_key").alias("key")).repartition(self.buckets, "key")
        keys.write.format("parquet").mode("append").bucketBy(self.buckets, "key").sortBy("key").option("path", self.path).saveAsTable(self.table)
        return fresh.drop("_key")

    def forget(self) -> None:
        """Drop the session's table; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
