"""A training corpus from documents: quality, near duplicates, contamination, source weights, token files.

Every stage works on all rows that the stage before kept, read again from Parquet, which goes when the next is written.
Rows with a null doc_id take part in all stages; the near duplicates among them are found like any others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm import decontamination, mixing, quality, simhash, token_output
from askloom.llm.common import comparable, discard, materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject."""
    metadata = tuple(c for c in quality.METADATA if c in docs.columns)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels"), metadata=metadata))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row with the group's smallest doc_id; without one, where no row has one.

    Of rows that share this id and text the least by all columns, in their order.
    """
    mark = F.xxhash64("text").alias("mark")
    found = simhash.components(docs, mark)
    # Rows may share a doc_id, so a group goes by its root, and its row by doc_id and text. No text is needed to choose.
    rows = found.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("copies"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "copies")).alias("least"))
    kept = materialise(least.select("least.*").select(F.col("doc_id").alias("kept"), F.col("mark").alias("kept_mark"), (F.col("copies") > 1).alias("repeated")), "kept")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), mark)
    met = F.col("id").eqNullSafe(F.col("kept")) & (F.col("mark") == F.col("kept_mark"))
    once = own.join(kept.where("not repeated"), met, "left_semi").select("row.*")
    if kept.where("repeated").isEmpty():
        return once
    # Rows of one id and text: the least by all columns, chosen before they are shuffled as well as after.
    order = F.struct(*[comparable(F.col("row")[f.name], f.dataType).alias(f"c{i}") for i, f in enumerate(docs.schema.fields)])
    repeated = own.join(kept.where("repeated"), met, "left_semi").groupBy("id", "mark").agg(F.min_by("row", order).alias("row"))
    return once.unionByName(repeated.select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contract's rule allows."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"), unnamed=True)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights draw them, in global random order."""
    return mixing.mix(docs, mixing.WEIGHTS).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens and ids_crc32, read back."""
    return token_output.token_output(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_id_output),
]

#: A trained classifier, XXH64 and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage{i}")
            if before is not None:
                discard(before)
            before = docs
    return docs
