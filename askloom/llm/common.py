"""What the operators share: word splitting over Arrow batches, shared storage, partition counts."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import discard, materialise, shared_dir, shared_path, until_exit  # noqa: F401

#: Bytes of text that one step of a Python worker handles at a time.
STEP_BYTES = 6 << 20

_BYTES = np.arange(256)
#: Words are runs of anything but ASCII white space.
SPACED = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Words are runs of ASCII letters and digits and of any non-ASCII characters (after lower-casing A-Z).
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle partitions at most: beyond, each takes more than 128 MB.
MOST_PARTITIONS = 100_000


def partitions(df: DataFrame, each: int = 128 << 20) -> int:
    """Shuffle partitions for df: the session's number, or one for each 128 MB of the tables it reads where that is more.

    The tables' sizes are added up, whatever is done with them, so joins do not multiply them.
    """
    own, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        n = int(str(leaves.apply(i).stats().sizeInBytes()))
        size += n if n < 1 << 58 else 0  # beyond: unknown
    return max(own, min(-(-size // each), MOST_PARTITIONS))


def comparable(c: Column, kind: T.DataType) -> Column:
    """c in a form of the same content that can be grouped by and hashed: maps as sorted entries, intervals and variants as text."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: comparable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[comparable(c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))
    return c.cast("string") if kind.typeName() in ("interval", "calendarinterval", "variant") else c


def share(spark: SparkSession, value):
    """A broadcast of value that workers can open without this package; for values of a bounded size."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared):
    return pickle.loads(shared.value)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which the worker gives freed memory back; workers outlive their tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return tidied


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most limit bytes of column each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    got = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    return [x or b"" for x in got.to_pylist()]


def looked_up(text: bytes, table: np.ndarray) -> np.ndarray:
    """Each byte's entry in a table of 256 small numbers; faster than indexing."""
    return np.frombuffer(text.translate(table.astype(np.uint8).tobytes()), np.uint8)


class Words:
    """Words of many texts in one buffer, each followed by one space.

    data: the buffer; offsets: where each word starts, one more at the end; docs: the first word of each text,
    one more at the end; ids: each word's place among the distinct words, exactly; distinct: those words as bytes,
    space included.
    """

    def __init__(self, texts: list[bytes], word: np.ndarray, index: bool = True):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        inside = looked_up(joined, word).astype(bool)
        inside[np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1] = False
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & ~before)
        lengths = np.flatnonzero(before & ~inside) - starts
        kept = raw[inside | before]
        self.offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths + 1, out=self.offsets[1:])
        kept[self.offsets[1:] - 1] = 32
        self.data = kept
        firsts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=firsts[1:])
        self.docs = np.searchsorted(starts, firsts)
        if index:
            self.ids, self.distinct = dictionary(self.offsets, self.data)

    def __len__(self) -> int:
        return len(self.offsets) - 1


def dictionary(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The id of each slice of data among the distinct slices, and those."""
    coded = pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(data)]
    ).dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def as_bytes(values: pa.BinaryArray) -> list[bytes]:
    """The values of an array without nulls; faster than to_pylist."""
    if not len(values):
        return []
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    data = values.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def chained(values: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit polynomial hash of every run of `length` values (uint64), by doubling: as many as there are runs."""
    out, done, have = None, 0, 1
    run, power = values, 0x9E3779B97F4A7C15
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    while True:
        step = np.uint64(power)
        if length & have:
            part = run[done : done + n]
            out = part.copy() if out is None else out * step + part
            done += have
        if done == length:
            return out
        run = run[: len(run) - have] * step + run[have:]
        power = power * power % (1 << 64)
        have *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output (uint64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
