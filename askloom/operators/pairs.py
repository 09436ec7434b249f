"""Question-answer pairs: from conversation turns, scored, filtered and deduplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scores import score
from ..functions.text import normalize


def pairs_from_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question and answer of each user turn that an assistant turn follows; a turn without a number is the last."""
    following = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"))
    both = turns.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(following).alias("next"), F.lead("text").over(following).alias("answer"))
    return both.where((F.col("role") == "user") & (F.col("next") == "assistant")).select("conv_id", "turn", "question", "answer")


def score_pairs(pairs: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    return pairs.withColumn("_score", score(question, answer))


def deduplicate(pairs: DataFrame, order: list[str], question: str = "question", answer: str = "answer", scope: list[str] | None = None) -> DataFrame:
    """The first pair, in order, of those that are alike but for case and white space.

    scope: columns within which pairs are compared (a document's, say); none compares the whole corpus. Each task sends
    at most one row for each pair of normalised texts.
    """
    alike = Window.partitionBy(*(scope or []), "_q", "_a").orderBy(*order)
    ranked = pairs.withColumns({"_q": normalize(F.coalesce(question, F.lit(""))), "_a": normalize(F.coalesce(answer, F.lit("")))}).withColumn("_rank", F.row_number().over(alike))
    return ranked.where("_rank = 1").drop("_q", "_a", "_rank")


def filter_pairs(pairs: DataFrame, order: list[str], min_score: float = 0.5, dedup: bool = True, question: str = "question", answer: str = "answer", scope: list[str] | None = None, seen: Observation | None = None) -> DataFrame:
    """Pairs of at least min_score with their _score, rounded to four places; then the first of those alike.

    seen is told, when the result is written, how many pairs there were (total) and how many passed the score (passed).
    """
    scored = score_pairs(pairs, question, answer)
    if seen is not None:
        scored = scored.observe(seen, F.count("*").alias("total"), F.count_if(F.col("_score") >= min_score).alias("passed"))
    good = scored.where(F.col("_score") >= min_score).withColumn("_score", F.round("_score", 4))
    return deduplicate(good, order, question, answer, scope) if dedup else good


def preview(pairs: DataFrame, order: list[str], n: int = 20, question_key: str = "question", answer_key: str = "answer") -> DataFrame:
    """The first n pairs in order; missing texts are empty."""
    return pairs.orderBy(*order).limit(n).select(*order, F.coalesce("question", F.lit("")).alias(question_key), F.coalesce("answer", F.lit("")).alias(answer_key))
