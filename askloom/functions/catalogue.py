"""The functions of a run in SQL: `register` makes them known to a session.

qa_normalize(text), qa_score(question, answer) and qa_pairs(content) are SQL functions whose bodies are the column
expressions of this library, so Catalyst sees through them. qa_chunks(text, size, overlap) is a table function for LATERAL,
and qa_keep_chunks the one whose chunks keep their separators. qa_ask(prompt), if a client is given, asks a model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import split_keeping, split_text
from ..operators.clients import Client
from .replies import PAIRS, parse_pairs
from .scores import score
from .text import normalize

#: A string in quotes, an operator where a function's name stands, or a number with a fraction.
_TOKEN = re.compile(r"""('(?:[^'\\]|\\.)*')|(?<=[\s(\[,])(<=|>=|!=|=|<|>|\+|-|\*|/|!|and|or)(?=\()|(?<=[\s(\[,])(\d+\.\d+)(?=[\s)\],])""")


def sql_text(expression: Column) -> str:
    """The SQL of an unresolved expression; operators are called by name, which SQL wants in back quotes, and numbers with a fraction are doubles."""
    said = expression._jc.node().sql()
    return _TOKEN.sub(lambda m: m[1] or (f"`{m[2]}`" if m[2] else f"{m[3]}D"), f" {said} ").strip()


def register(spark: SparkSession, client: Client | None = None) -> None:
    """Make the functions known to the session, in place of former ones."""

    def define(name: str, arguments: str, returns: str, body: Column) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {sql_text(body)}")

    define("qa_normalize", "qa_text STRING", "STRING", normalize("qa_text"))
    define("qa_score", "qa_question STRING, qa_answer STRING", "DOUBLE", score("qa_question", "qa_answer"))
    define("qa_pairs", "qa_content STRING", PAIRS, parse_pairs("qa_content"))

    for name, split in (("qa_chunks", split_text), ("qa_keep_chunks", split_keeping)):
        spark.udtf.register(name, F.udtf(_table_function(split), returnType="chunk_index int, chunk string", useArrow=True))
    if client is not None:

        @F.pandas_udf("string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for prompts in batches:
                yield prompts.map(lambda p: client.complete(p or "").content)

        spark.udf.register("qa_ask", ask)


def _table_function(split) -> type:
    class Chunks:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(split(text, size, overlap))

    return Chunks
