"""Datasets of pairs as JSON Lines or JSON arrays, and metrics as CSV.

A path with a scheme, or one that ends with a slash, is a dataset on shared storage, a folder of ordered parts that the
executors write. Any other path is one file on the driver's disk, written a partition at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dataset import array_pieces, csv_pieces, line_pieces, write_dataset

FORMATS = ("json", "jsonl")
METRICS = ("chunk_index", "pairs_generated", "error", "latency_seconds", "tokens_per_second", "prompt_tokens", "completion_tokens")
_ORDER = ("doc_id", "chunk_index", "pair_index")


def checked_format(fmt: str) -> str:
    got = fmt.lower().strip(".")
    if got not in FORMATS:
        raise ValueError(f"Unsupported export format '{fmt}'; supported are {', '.join(FORMATS)}")
    return got


def apply_schema(pairs: DataFrame, question_key: str = "question", answer_key: str = "answer", include_score: bool = True, src_question: str = "question", src_answer: str = "answer") -> DataFrame:
    """The pairs under their output names first, then all other columns; names that clash raise."""
    rest = [c for c in pairs.columns if c not in (src_question, src_answer) and (include_score or c != "_score")]
    names = [n for src, n in ((src_question, question_key), (src_answer, answer_key)) if src in pairs.columns] + rest
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"output names clash: {names}")
    own = [F.col(f"`{src}`").alias(n) for src, n in ((src_question, question_key), (src_answer, answer_key)) if src in pairs.columns]
    return pairs.select(*own, *[F.col(f"`{c}`") for c in rest])


def is_shared(path: str | Path) -> bool:
    return isinstance(path, str) and ("://" in path or path.startswith("file:/") or path.endswith("/"))


def _sorted(pairs: DataFrame, drop: tuple[str, ...], **names) -> DataFrame:
    order = [c for c in _ORDER if c in pairs.columns]
    return apply_schema((pairs.orderBy(*order) if order else pairs).drop(*drop), **names)


def _records(rows: DataFrame) -> Iterator[dict]:
    for row in rows.toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)


def _write(path: str | Path, pieces: Iterable[str]) -> Path:
    """One UTF-8 file of the pieces, in a folder that is made if need be."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8", newline="") as out:
        out.writelines(pieces)
    return path


def export_jsonl(pairs: DataFrame, output_path: str | Path, question_key: str = "question", answer_key: str = "answer", include_score: bool = False, drop: tuple[str, ...] = ("doc_id", "pair_index")) -> Path | str:
    """One object a line, in order."""
    rows = _sorted(pairs, drop, question_key=question_key, answer_key=answer_key, include_score=include_score)
    return write_dataset(rows, output_path, "jsonl") if is_shared(output_path) else _write(output_path, line_pieces(_records(rows)))


def export_json(pairs: DataFrame, output_path: str | Path, question_key: str = "question", answer_key: str = "answer", include_score: bool = False, indent: int = 2, drop: tuple[str, ...] = ("doc_id", "pair_index")) -> Path | str:
    """One array, in order; on shared storage an array for each part."""
    rows = _sorted(pairs, drop, question_key=question_key, answer_key=answer_key, include_score=include_score)
    return write_dataset(rows, output_path, "json") if is_shared(output_path) else _write(output_path, array_pieces(_records(rows), indent))


def export(pairs: DataFrame, output_path: str | Path, fmt: str = "jsonl", question_key: str = "question", answer_key: str = "answer", include_score: bool = False) -> Path | str:
    write = export_json if checked_format(fmt) == "json" else export_jsonl
    return write(pairs, output_path, question_key, answer_key, include_score)


def metrics_path(output_path: str | Path) -> str | Path:
    """Where a run's metrics go: beside its dataset."""
    if isinstance(output_path, Path):
        return output_path.with_suffix(".metrics.csv")
    stem, _, last = output_path.rstrip("/").rpartition("/")
    return f"{stem}/{last.rpartition('.')[0] or last}.metrics.csv"


def export_folder(pairs: DataFrame, folder: str, question_key: str = "question", answer_key: str = "answer", include_score: bool = False) -> None:
    """JSON Lines files under a folder, written by the executors: the way for large datasets."""
    apply_schema(pairs, question_key, answer_key, include_score).write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def save_metrics_csv(metrics: DataFrame, path: str | Path) -> Path | str:
    """The metrics of each chunk, in order; a missing error is an empty cell."""
    ordered = metrics.orderBy(*[c for c in ("doc_id", "chunk_index") if c in metrics.columns]).select(*METRICS)
    if is_shared(path):
        return write_dataset(ordered, path, "csv")
    return _write(path, csv_pieces(list(METRICS), map(list, ordered.toLocalIterator(prefetchPartitions=True))))
