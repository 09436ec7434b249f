"""Metrics of chunks and of a run, and quantiles over runs from sketches that can be merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chunk_metrics(found: DataFrame) -> DataFrame:
    """doc_id and the metrics of each chunk, from results with their pairs."""
    return found.select(
        "doc_id", "chunk_index", F.size("pairs").alias("pairs_generated"), "error",
        F.coalesce("latency_seconds", F.lit(0.0)).alias("latency_seconds"), F.coalesce("tokens_per_second", F.lit(0.0)).alias("tokens_per_second"),
        F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"),
    )


def run_summary(metrics: DataFrame, elapsed_seconds: float = 0.0) -> DataFrame:
    """One row. Latency is averaged over chunks without an error, throughput over those where it is positive."""
    ok, tps = F.col("error").isNull(), F.col("tokens_per_second")
    return metrics.agg(
        F.count("*").alias("total_chunks"),
        F.count_if(ok).alias("successful_chunks"),
        F.count_if(~ok).alias("failed_chunks"),
        F.coalesce(F.sum("pairs_generated"), F.lit(0)).cast("long").alias("total_pairs_generated"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("latency_seconds"))), F.lit(0.0)), 4).alias("avg_latency_seconds"),
        F.round(F.coalesce(F.avg(F.when(tps > 0, tps)), F.lit(0.0)), 2).alias("avg_tokens_per_second"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).cast("long").alias("total_completion_tokens"),
        F.lit(round(elapsed_seconds, 4)).alias("total_elapsed_seconds"),
    )


#: Values that a sketch keeps about; its ranks are within some 1.7 % at 200.
SKETCH_SIZE = 200
_SKETCHES = "run string, metric string, n long, sketch binary"


def run_sketches(metrics: DataFrame, run: str) -> DataFrame:
    """run, metric, n and sketch (KLL) of the latencies of chunks without an error, and of the throughputs above 0, as their averages have them."""
    ok, tps = F.col("error").isNull(), F.col("tokens_per_second")
    kept = {"latency_seconds": F.when(ok, F.col("latency_seconds")), "tokens_per_second": F.when(tps > 0, tps)}
    one = metrics.agg(*[x for name, c in kept.items() for x in (F.count(c).alias(f"n_{name}"), F.kll_sketch_agg_double(c, SKETCH_SIZE).alias(name))])
    rows = F.array(*[F.struct(F.lit(run).alias("run"), F.lit(name).alias("metric"), F.col(f"n_{name}").alias("n"), F.col(name).alias("sketch")) for name in kept])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def save_sketches(metrics: DataFrame, run: str, path: str) -> None:
    """Add a run's sketches to those at path; the same run again takes the place of its former ones."""
    run_sketches(metrics, run).drop("run").coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}")


def saved_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SKETCHES).parquet(path)


def quantiles(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """metric, n and a column for each rank (p50, p95, p99) of the sketches' runs together; null of a metric without values."""
    merged = sketches.where("n > 0").groupBy("metric").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select("metric", "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(r)).alias(f"p{100 * r:g}") for r in ranks])
