"""Pairs from streams of replies and of text files.

Chunking, parsing and scoring keep no state and are the batch operators themselves. Deduplication on a stream keeps the
first pair to arrive within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.replies import parse_pairs
from ..functions.text import normalize
from ..operators.chunking import OVERLAP, SIZE, chunk
from ..operators.pairs import score_pairs


def stream_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, text) of the text files that come into a folder."""
    files = spark.readStream.schema("value string").option("wholetext", True).text(folder)
    return files.select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def stream_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return chunk(docs.select("doc_id", "text"), size, overlap)


def stream_pairs(replies: DataFrame, min_score: float = 0.5, content: str = "content") -> DataFrame:
    """Scored pairs of a stream of replies, with all columns of the reply but its content."""
    rest = [F.col(f"`{c}`") for c in replies.columns if c != content]
    found = replies.select(*rest, F.posexplode(parse_pairs(content)).alias("pair_index", "pair")).select(*rest, "pair_index", "pair.question", "pair.answer")
    return score_pairs(found).where(F.col("_score") >= min_score).withColumn("_score", F.round("_score", 4))


def stream_distinct(pairs: DataFrame, time_column: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first pair to arrive of those alike; with a time column the state is dropped after the delay."""
    keyed = pairs.withColumns({"_q": normalize("question"), "_a": normalize("answer")})
    if time_column is None:
        return keyed.dropDuplicates(["_q", "_a"]).drop("_q", "_a")
    return keyed.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["_q", "_a"]).drop("_q", "_a")
