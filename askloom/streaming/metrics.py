"""Metrics of a stream of results by windows of event time, written so that a batch may be written twice.

Each micro-batch writes the windows that it changed under its own number, in place of whatever a former attempt at the same
batch has left; a window's metrics are those of the last batch that has it. Sums are kept in the stream's state until the
watermark has passed a window; rows that come later are left out and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.storage import folder

METRICS = "begin timestamp, end timestamp, total_chunks long, successful_chunks long, failed_chunks long, total_pairs_generated long, avg_latency_seconds double, avg_tokens_per_second double, total_completion_tokens long"


def windowed_metrics(results: DataFrame, time_column: str, length: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """A run's metrics (as `run_summary`) for each window of the stream's time; late by more than delay: left out."""
    ok, tps = F.col("error").isNull(), F.col("tokens_per_second")
    found = results.withWatermark(time_column, delay).groupBy(F.window(time_column, length).alias("w")).agg(
        F.count("*").alias("total_chunks"), F.count_if(ok).alias("successful_chunks"), F.count_if(~ok).alias("failed_chunks"), F.sum("pairs_generated").cast("long").alias("total_pairs_generated"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("latency_seconds"))), F.lit(0.0)), 4).alias("avg_latency_seconds"), F.round(F.coalesce(F.avg(F.when(tps > 0, tps)), F.lit(0.0)), 2).alias("avg_tokens_per_second"),
        F.sum("completion_tokens").cast("long").alias("total_completion_tokens"),
    )
    return found.select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *found.columns[1:])


def write_metrics(windows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing to path; by default all that is there, in batches, and then no more."""

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    return windows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of every window, as its last batch has them."""
    batches = spark.read.schema(f"{METRICS}, batch long").parquet(folder(spark, path))
    last = F.row_number().over(Window.partitionBy("begin", "end").orderBy(F.desc("batch")))
    return batches.withColumn("_last", last).where("_last = 1").drop("_last", "batch")


def late_rows(query: StreamingQuery) -> int:
    """How many rows of the query's batches came after the watermark had passed their window."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
