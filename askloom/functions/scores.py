"""Quality of a question-answer pair, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column, is_blank, strip

MIN_QUESTION, MIN_ANSWER, MAX_ANSWER = 10, 5, 2000
#: Words that make a text look like a question.
QUESTION_WORDS = ("what", "who", "where", "when", "why", "how", "which", "is", "are", "does", "do", "can", "could", "should", "would")


def non_blank(question: Column | str, answer: Column | str) -> Column:
    return ~is_blank(question) & ~is_blank(answer)


def long_enough(question: Column | str, answer: Column | str) -> Column:
    return (F.length(column(question)) >= MIN_QUESTION) & (F.length(column(answer)) >= MIN_ANSWER)


def short_enough(answer: Column | str) -> Column:
    return F.length(column(answer)) <= MAX_ANSWER


def looks_like_question(question: Column | str) -> Column:
    q = column(question)
    return F.endswith(strip(q), F.lit("?")) | q.rlike(rf"(?iU)\b({'|'.join(QUESTION_WORDS)})\b")


def score(question: Column | str, answer: Column | str) -> Column:
    """0 where either is blank, else the share of the three rules that hold."""
    rules = long_enough(question, answer).cast("int") + short_enough(answer).cast("int") + looks_like_question(question).cast("int")
    return F.when(non_blank(question, answer), rules / F.lit(3.0)).otherwise(F.lit(0.0))


def tokens_per_second(completion_tokens: Column | str, latency: Column | str) -> Column:
    n, s = column(completion_tokens), column(latency)
    return F.when((s > 0) & (n > 0), n / s).otherwise(F.lit(0.0))
