"""A whole run: documents to a dataset of pairs and its metrics."""

from __future__ import annotations

import logging
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import render_prompt
from ..operators.chunking import OVERLAP, SIZE, SPLITTERS, checked, chunk
from ..operators.clients import Client
from ..operators.generate import PROMPT, flat_pairs, replies, results
from ..operators.metrics import chunk_metrics, run_summary, save_sketches
from ..operators.pairs import filter_pairs
from ..sources.readers import ingest
from ..sources.storage import materialise
from ..sources.writers import checked_format, export, metrics_path, save_metrics_csv


log = logging.getLogger(__name__)


@dataclass
class Run:
    pairs: DataFrame
    output_path: Path | str
    metrics: dict
    chunk_metrics: DataFrame


def run_pipeline(
    spark: SparkSession,
    source: str | DataFrame,
    client: Client,
    output_path: str | Path = "output/dataset.jsonl",
    fmt: str = "jsonl",
    chunk_size: int = SIZE,
    chunk_overlap: int = OVERLAP,
    num_pairs: int = 5,
    max_workers: int = 4,
    threads: int = 1,
    min_quality_score: float = 0.5,
    deduplicate_pairs: bool = True,
    question_key: str = "question",
    answer_key: str = "answer",
    include_score: bool = False,
    text_columns: list[str] | None = None,
    prompt_template: str = PROMPT,
    save_metrics: bool = False,
    scope: str = "document",
    progress: str | None = None,
    separators: str = "kept",
    sketches: str | None = None,
    typed_cells: bool = False,
) -> Run:
    """source: a path (a glob gives many documents) or a table (doc_id, text). All settings are checked before any call.

    Pairs are scored and compared under their own names; output names apply only to what is written. progress: a folder on
    shared storage that keeps the replies, so that a run that died goes on with the calls it had not made. separators: how
    chunks are cut (`chunking.SPLITTERS`). sketches: a folder to which the run adds its sketches of latency and throughput.
    typed_cells: CSV cells as values of their columns (1.0 for 1 where the column has gaps), not as the file has them.
    """
    fmt = checked_format(fmt)
    checked(chunk_size, chunk_overlap)
    render_prompt(prompt_template, chunk=F.lit(""), num_pairs=F.lit(num_pairs))
    if separators not in SPLITTERS:
        raise ValueError(f"separators must be one of {', '.join(SPLITTERS)}")
    if scope not in ("document", "corpus"):
        raise ValueError(f"unknown scope {scope!r}")
    if question_key.lower() == answer_key.lower():
        raise ValueError("question_key and answer_key must differ")
    began = time.perf_counter()
    docs = ingest(spark, source, text_columns, typed_cells) if isinstance(source, str) else source
    chunks = chunk(docs.select("doc_id", "text"), chunk_size, chunk_overlap, separators=separators)
    found = results(replies(chunks, client, num_pairs, prompt_template, max_workers, threads, progress))
    order = ["doc_id", "chunk_index", "pair_index"]
    seen, left = Observation("scored pairs"), Observation("kept pairs")
    filtered = filter_pairs(flat_pairs(found), order, min_quality_score, deduplicate_pairs, scope=["doc_id"] if scope == "document" else None, seen=seen)
    kept = materialise(filtered.observe(left, F.count("*").alias("n")), "pairs")
    total, passed, n = seen.get["total"], seen.get["passed"], left.get["n"]  # counted while the pairs were written
    log.info("Deduplication removed %d pairs", passed - n)
    log.info("Kept %d of %d pairs (least score %.2f)", n, total, min_quality_score)
    path = export(kept, output_path, fmt, question_key, answer_key, include_score)
    each = chunk_metrics(found)
    if save_metrics:
        save_metrics_csv(each, metrics_path(path))
    if sketches:
        save_sketches(each, uuid.uuid4().hex, sketches)
    summary = run_summary(each, time.perf_counter() - began).first().asDict()
    return Run(kept, path, summary | {"total_pairs_kept": n}, each)
