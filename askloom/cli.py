"""Command line: `python -m askloom.cli generate FILE ...` and `version`."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__
from .functions.text import title
from .operators.clients import OfflineClient, create_client
from .operators.generate import PROMPT
from .plans.run import run_pipeline

log = logging.getLogger("askloom")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="askloom", description="Turn documents into question-answer datasets.")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    g = commands.add_parser("generate", help="make a dataset from a file", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    g.add_argument("file", help="a .pdf, .txt or .csv file, or a pattern of such, also on shared storage")
    g.add_argument("--output", "-o", default="output/qa_dataset.jsonl")
    g.add_argument("--format", "-f", default=None, help="json or jsonl; by default the output's suffix")
    g.add_argument("--mode", "-m", default="online", choices=["online", "offline", "test"], help="test answers without a model")
    g.add_argument("--provider", "-p", default="openai")
    g.add_argument("--model", default=None)
    g.add_argument("--api-key", default=None, help="by default the provider's environment variable")
    g.add_argument("--base-url", default=None)
    g.add_argument("--temperature", "-t", type=float, default=0.3)
    g.add_argument("--max-tokens", type=int, default=1024)
    g.add_argument("--timeout", type=float, default=120.0)
    g.add_argument("--chunk-size", type=int, default=1000)
    g.add_argument("--chunk-overlap", type=int, default=200)
    g.add_argument("--separators", default="kept", choices=["kept", "lost"], help="whether separators stay in the chunks")
    g.add_argument("--num-pairs", "-n", type=int, default=5)
    g.add_argument("--workers", "-w", "--max-workers", dest="max_workers", type=int, default=4)
    g.add_argument("--min-score", type=float, default=0.5)
    g.add_argument("--no-dedup", action="store_true")
    g.add_argument("--question-key", default="question")
    g.add_argument("--answer-key", default="answer")
    g.add_argument("--include-score", action="store_true")
    g.add_argument("--text-column", "-c", action="append", default=None, help="a CSV column; may be given several times")
    g.add_argument("--text-columns", default=None, help="CSV columns, separated by commas")
    g.add_argument("--typed-cells", action="store_true", help="CSV cells as values of their columns, not as the file has them")
    g.add_argument("--prompt-template", default=None, help="a file with {chunk} and {num_pairs}")
    g.add_argument("--save-metrics", action="store_true")
    g.add_argument("--progress", default=None, help="a folder on shared storage that keeps the replies; a run that died goes on with it")
    g.add_argument("--verbose", "-v", action="store_true")
    return top


def listed(value: str | None) -> list[str] | None:
    """Names between commas, without blanks; none is None."""
    return [x.strip() for x in value.split(",") if x.strip()] or None if value else None


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    got = parser().parse_args(args)
    if got.command == "version":
        print(__version__)
        return 0
    logging.basicConfig(level=logging.DEBUG if got.verbose else logging.INFO)
    local = "://" not in got.file and not set("*?[{") & set(got.file)
    if local and not os.path.exists(got.file):
        print(f"File not found: {got.file}", file=sys.stderr)
        return 1
    try:
        if got.mode == "test":
            client = OfflineClient(got.num_pairs)
        else:
            client = create_client(got.mode, got.provider, got.model, got.api_key, got.base_url, got.temperature, got.max_tokens, got.timeout)
        spark = spark or SparkSession.builder.appName("askloom").getOrCreate()
        run = run_pipeline(
            spark, os.path.abspath(got.file) if local else got.file, client, got.output, got.format or Path(got.output).suffix or "jsonl", got.chunk_size, got.chunk_overlap, got.num_pairs, got.max_workers,
            min_quality_score=got.min_score, deduplicate_pairs=not got.no_dedup, question_key=got.question_key, answer_key=got.answer_key, include_score=got.include_score,
            text_columns=[*(got.text_column or []), *(listed(got.text_columns) or [])] or None, prompt_template=Path(got.prompt_template).read_text("utf-8") if got.prompt_template else PROMPT, save_metrics=got.save_metrics, progress=got.progress, separators=got.separators, typed_cells=got.typed_cells,
        )
    except Exception as error:
        log.debug("failed", exc_info=True)
        print(f"Failed: {error}", file=sys.stderr)
        return 1
    for name, value in run.metrics.items():
        print(f"{title(name):28} {value}")
    print(f"{'Output':28} {run.output_path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
