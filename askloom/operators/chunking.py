"""Texts to ordered, overlapping chunks."""

from __future__ import annotations

import functools
import itertools
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, column, folded, is_blank, split_literal

SIZE, OVERLAP = 1000, 200
#: Separators, from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Those of the splitter that keeps them.
KEPT_SEPARATORS = ("\n\n", "\n", " ", "")


def checked(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError(f"chunk_overlap ({overlap}) must be less than chunk_size ({size}), and neither negative")


def _pieces(text: str, begin: int, end: int, separator: str) -> Iterator[tuple[int, int]]:
    """Spans of text[begin:end] between separators."""
    at = begin
    while (found := text.find(separator, at, end)) >= 0:
        yield at, found
        at = found + len(separator)
    yield at, end


def _spans(text: str, begin: int, end: int, size: int, overlap: int, level: int) -> Iterator[tuple[int, int]]:
    """Chunk spans of text[begin:end]. Pieces that are packed together are neighbours, so a buffer is one span."""
    if not SEPARATORS[level]:  # single characters: windows
        while end - begin > size:
            yield begin, begin + size
            begin += size - overlap
        yield begin, end
        return
    firsts: deque[int] = deque()  # where the buffered pieces start
    reach = begin

    def flushed() -> Iterator[tuple[int, int]]:
        if reach - firsts[0] > size:
            yield from _spans(text, firsts[0], reach, size, overlap, level + 1)
        else:
            yield firsts[0], reach

    for a, b in _pieces(text, begin, end, SEPARATORS[level]):
        if firsts and b - firsts[0] > size:
            yield from flushed()
            while firsts and reach - firsts[0] > overlap:
                firsts.popleft()
        firsts.append(a)
        reach = b
    if firsts:
        yield from flushed()


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most size characters; separators where chunks meet are lost, blank chunks dropped."""
    if not text or text.isspace():
        return []
    chunks = (text[a:b] for a, b in _spans(text, 0, len(text), size, overlap, 0))
    return [c for c in chunks if c and not c.isspace()]


def _merged(pieces: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of neighbouring pieces of at most size characters; the next one begins with what the overlap and its first new piece leave room for."""
    first = 0
    for k, (a, b) in enumerate(pieces):
        if k > first and b - pieces[first][0] > size:
            yield pieces[first][0], pieces[k - 1][1]
            while first < k and (a - pieces[first][0] > overlap or b - pieces[first][0] > size):
                first += 1
    if pieces:
        yield pieces[first][0], pieces[-1][1]


def _kept_spans(text: str, begin: int, end: int, size: int, overlap: int, level: int) -> Iterator[tuple[int, int]]:
    """Chunk spans of text[begin:end], where a piece keeps the separator before it, and only separators that occur are used."""
    while KEPT_SEPARATORS[level] and text.find(KEPT_SEPARATORS[level], begin, end) < 0:
        level += 1
    separator, short = KEPT_SEPARATORS[level], []
    if separator:
        cuts = [begin, *(a - len(separator) for a, _ in _pieces(text, begin, end, separator) if a > begin), end]
    else:
        cuts = list(range(begin, end + 1))
    for a, b in itertools.pairwise(cuts):
        if b - a < size:
            if a < b:
                short.append((a, b))
            continue
        yield from _merged(short, size, overlap)
        short = []
        if separator:
            yield from _kept_spans(text, a, b, size, overlap, level + 1)
        else:
            yield a, b
    yield from _merged(short, size, overlap)


def split_keeping(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most size characters in which separators stay, without white space at their ends; blank ones dropped.

    The longest separator that occurs cuts first; pieces shorter than size are merged, the others cut by the next one.
    """
    if not text or text.isspace():
        return []
    chunks = (text[a:b].strip() for a, b in _kept_spans(text, 0, len(text), size, overlap, 0))
    return [c for c in chunks if c]


#: Bytes of text that a Python worker cuts at a time.
STEP_BYTES = 1 << 20


def slices(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[pa.Array]:
    """texts in slices of at most limit bytes, or of one text, so that a worker's memory doesn't follow the rows of a batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield texts.slice(at, end - at)
        at = end


#: How separators are treated: those between chunks are lost, or every piece keeps its own.
SPLITTERS = {"lost": split_text, "kept": split_keeping}


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text_column: str = "text", splitter: Callable[[str], list[str]] | None = None, separators: str = "lost") -> DataFrame:
    """All columns but the text, then chunk_index and chunk, a row for each chunk. separators: lost or kept; or a splitter of one's own."""
    checked(size, overlap)
    split = splitter or functools.partial(SPLITTERS[separators], size=size, overlap=overlap)

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in slices(texts):
                yield pa.array([split(t) if t else [] for t in part.to_pylist()], pa.list_(pa.string()))

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_column]
    return docs.select(*rest, F.posexplode(cut(F.col(text_column))).alias("chunk_index", "chunk"))


def _packed_level(segment: Column, separator: str, size: int, overlap: int) -> Column:
    """A segment's pieces between separators, packed into strings of at most size characters (longer ones where a piece is too long), overlapping by whole pieces."""
    gap = len(separator)

    def place(now: Column, part: Column) -> tuple[Column, Column]:
        return now + part["length"] + gap, F.struct(now.alias("a"), (now + part["length"]).alias("b"))

    def packed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.struct(F.length(p).alias("length")))
        spots = folded(lengths, F.lit(0), place, "struct<a:int,b:int>")["out"]
        return bound(spots, lambda at: chunks(parts, at))

    def chunks(parts: Column, at: Column) -> Column:
        def step(first: Column, k: Column) -> tuple[Column, Column]:
            full = (k > first) & (F.get(at, k)["b"] - F.get(at, first)["a"] > size)
            back = F.filter(F.sequence(first, F.greatest(k - 1, first)), lambda i: F.get(at, k - 1)["b"] - F.get(at, i)["a"] <= overlap)
            return F.when(full, F.coalesce(F.get(back, 0), k)).otherwise(first), F.when(full, F.struct(first.alias("first"), (k - 1).alias("last")))

        found = folded(F.transform(parts, lambda p, i: i), F.lit(0), step, "struct<first:int,last:int>")
        spans = bound(found, lambda x: F.concat(x["out"], F.array(F.struct(x["state"].alias("first"), (F.size(parts) - 1).alias("last")))))
        return F.transform(spans, lambda span: F.array_join(F.slice(parts, span["first"] + 1, span["last"] - span["first"] + 1), separator))

    return bound(split_literal(segment, separator), packed)


@functools.lru_cache(maxsize=32)
def _level(separator: str, size: int, overlap: int, gateway: object) -> Column:
    """The column _segments with what is too long cut at one separator; built once for each gateway to a JVM, as it has hundreds of parts."""

    def cut(segment: Column) -> Column:
        parts = _packed_level(segment, separator, size, overlap) if separator else char_windows(segment, size, overlap)
        return F.when(F.length(segment) <= size, F.array(segment)).otherwise(parts)

    return F.flatten(F.transform("_segments", cut))


def chunk_native(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text_column: str = "text") -> DataFrame:
    """As chunk, with separators lost and without Python: one pass a level over all segments of a text.

    Each level cuts, packs and hands on what is still too long, as expressions on arrays of one row: nothing is shuffled.
    """
    checked(size, overlap)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_column]
    rows = docs.select(*rest, F.array(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("_segments"))
    for separator in SEPARATORS:
        rows = rows.select(*rest, _level(separator, size, overlap, SparkContext._gateway).alias("_segments"))
    return rows.select(*rest, F.posexplode(F.filter("_segments", lambda c: ~is_blank(c))).alias("chunk_index", "chunk"))


def char_windows(c: Column | str, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Sliding windows of size characters, size - overlap apart, without Python.

    A substring is found from the beginning of its string, so windows are cut out of blocks of about the square root of
    their number, and those out of the text: a long text takes no time in proportion to its square.
    """
    checked(size, overlap)
    text, step = column(c), size - overlap
    last = F.floor(F.greatest(F.length(text) - 1 - overlap, F.lit(0)) / step).cast("int")

    def cut(place: Column) -> Column:
        """place: the number of the last window, and how many a block has."""
        last, n = place["last"], place["n"]

        def block(j: Column) -> Column:
            body = F.substring(text, j * n * step + 1, (n - 1) * step + size)
            return bound(body, lambda b: F.transform(F.sequence(F.lit(0), F.least(n - 1, last - j * n)), lambda i: F.substring(b, i * step + 1, F.lit(size))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(last / n).cast("int")), block))

    return bound(bound(last, lambda x: F.struct(x.alias("last"), F.ceil(F.sqrt(x + 1)).cast("int").alias("n"))), cut)


def greedy_pack(c: Column | str, separator: str, size: int = SIZE) -> Column:
    """Parts between separators packed in order into strings of at most size characters (longer parts alone), without Python."""
    step_ = F.lit(len(separator))

    def pack(now: Column, part: Column) -> tuple[Column, Column]:
        """now: where the string begins and how long it is; part: its place and length."""
        longer = now["length"] + step_ + part["length"]
        fits = (now["first"] >= 0) & (longer <= size)
        after = F.struct(F.when(fits, now["first"]).otherwise(part["place"]).alias("first"), F.when(fits, longer).otherwise(part["length"]).alias("length"))
        return after, F.when((now["first"] >= 0) & ~fits, F.struct(now["first"].alias("first"), part["place"].alias("end")))

    def packed(parts: Column) -> Column:
        sized = F.transform(parts, lambda part, i: F.struct(i.alias("place"), F.length(part).alias("length")))
        found = folded(sized, F.struct(F.lit(-1).alias("first"), F.lit(0).alias("length")), pack, "struct<first:int,end:int>")
        spans = bound(found, lambda x: F.concat(x["out"], F.array(F.struct(x["state"]["first"].alias("first"), F.size(parts).alias("end")))))
        return F.transform(spans, lambda span: F.array_join(F.slice(parts, span["first"] + 1, span["end"] - span["first"]), separator))

    return bound(split_literal(c, separator), packed)
