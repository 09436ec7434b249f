"""Keep-first deduplication on a stream in document order, whatever the order of arrival.

Pairs are alike if their normalised texts are; they are told by a SHA-256 of both and dealt into buckets, and a bucket's state
is read and written as a whole, not pair by pair. It holds the rows that wait (of a batch, the first in order of those alike)
and the digests of what has been sent. A timer of event time waits until the watermark has passed a pair's time by `wait`; then
its first row is sent, once, and whatever is like it later is dropped. Rows that the watermark has passed already are dropped
by Spark, so if rows come within the watermark's delay the result is that of the batch operator.

A task has one bucket's rows in memory. A batch that sends rows of a bucket reads all that wait in it and writes the rest
again, so a stream on which very many pairs wait takes more buckets; their number is fixed with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import normalize

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SLICE = 500  # rows in one message


class KeepFirst(StatefulProcessor):
    def __init__(self, schema: T.StructType, order: list[str]):
        self.schema, self.order = schema, [schema.names.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("_key", T.StringType()), T.StructField("_until", T.LongType()), *self.schema.fields]))
        self.sent = handle.getMapState("sent", "_key string", "sent boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _plain(self, said: dict[str, Any]) -> tuple:
        """With whole numbers as such, which come as strings, and without pandas' signs of what is missing."""
        found = [None if pd.api.types.is_scalar(v) and pd.isna(v) else v for v in (said[c] for c in self.schema.names)]
        return tuple(int(v) if v is not None and isinstance(f.dataType, T.IntegralType) else v for v, f in zip(found, self.schema.fields, strict=True))

    def _rank(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in self.order)  # missing first, as Spark sorts

    def _wake(self, at: int) -> None:
        """One timer a bucket, for the row that is due first."""
        known = self.timer.get()[0] if self.timer.exists() else None
        if known is None or at < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        met: dict[str, tuple[int, tuple]] = {}
        for pdf in rows:
            for name, until, said in zip(pdf["alike"], pdf["until"], pdf["said"], strict=True):
                row = self._plain(said)
                before = met.get(name)
                met[name] = (int(until), row) if before is None else (max(before[0], int(until)), min(before[1], row, key=self._rank))
        found = [(name, until, *row) for name, (until, row) in met.items()]
        for i in range(0, len(found), _SLICE):
            self.waiting.appendList(found[i : i + _SLICE])
        self._wake(min(until for until, _ in met.values()))
        return
        yield

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        met: dict[str, tuple[int, tuple]] = {}
        for name, until, *said in self.waiting.get():
            before = met.get(name)  # of a pair, what came first says how long to wait
            met[name] = (until, tuple(said)) if before is None else (before[0], min(before[1], tuple(said), key=self._rank))
        self.waiting.clear()
        self.timer.clear()
        rest = [(name, until, *row) for name, (until, row) in met.items() if until > now]
        for i in range(0, len(rest), _SLICE):
            self.waiting.appendList(rest[i : i + _SLICE])
        if rest:
            self._wake(min(until for _, until, *_ in rest))
        due = [(name, row) for name, (until, row) in met.items() if until <= now and not self.sent.containsKey((name,))]
        for i in range(0, len(due), _SLICE):
            for name, _ in due[i : i + _SLICE]:
                self.sent.updateValue((name,), (True,))
            columns = zip(*(row for _, row in due[i : i + _SLICE]), strict=True)
            yield pd.DataFrame({f.name: pd.Series(list(v), dtype=object if isinstance(f.dataType, T.IntegralType) else None) for f, v in zip(self.schema.fields, columns, strict=True)})

    def close(self) -> None:
        pass


def stream_keep_first(
    pairs: DataFrame, order: list[str], time_column: str, delay: str = "1 hour", wait_seconds: float = 0.0, question: str = "question", answer: str = "answer", buckets: int = 4096
) -> DataFrame:
    """The first pair in order of those alike, sent when the watermark has passed it; the session's state store must be RocksDB."""
    if pairs.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    texts = pairs.withWatermark(time_column, delay).withColumns({"_q": normalize(F.coalesce(question, F.lit(""))), "_a": normalize(F.coalesce(answer, F.lit("")))})
    # Whole numbers travel as strings: pandas would turn them into floats where some are missing.
    said = [F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.IntegralType) else F.col(f"`{f.name}`") for f in pairs.schema.fields]
    keyed = texts.select(
        F.col(time_column).alias("at"), F.sha2(F.concat(F.length("_q").cast("string"), F.lit(":"), "_q", "_a"), 256).alias("alike"),
        F.coalesce(F.unix_millis(time_column) + int(wait_seconds * 1000), F.lit(0)).alias("until"), F.struct(*said).alias("said"),
    ).withColumn("bucket", F.pmod(F.xxhash64("alike"), F.lit(buckets)))
    return keyed.groupBy("bucket").transformWithStateInPandas(KeepFirst(pairs.schema, order), outputStructType=pairs.schema, outputMode="Append", timeMode="EventTime")
