"""Quality classifier: a factorisation machine.

Features of a text: its words (A-Z lower-cased), hashed to `BUCKETS` places and weighted by the square root of their
counts, together of length 1; statistics of its structure (shares of letters, capitals, digits, marks, repeated words,
the most common word and words said twice running, word and line lengths and so on); and metadata: the values of the
columns that the caller names (n_chars in op9 and the pipeline), each hashed as name=value, numbers by the half power of
two that they lie in. All pairs of features interact through vectors of `RANK` numbers; with the sum-of-squares
identity, sum over pairs of <v_i, v_j> x_i x_j = half of sum over factors of (sum v x)^2 - sum (v x)^2, scoring takes
linear time.

Trained in numpy on a bounded sample of labelled rows: the `sample` rows (3,000) with the smallest hash of their id, each
with all its words. Their features are computed on the executors; the driver gets those only, 6 bytes for each of the
different words of a row, of which there are `BUCKETS` at most. Scoring reads all words of all texts.

Defined results: doc_ids are whole numbers or null; null text is empty; empty texts are scored by their structure; labels other than 0 and 1 are not
learned; a doc_id with several labels counts once for each, one with several texts by the first in order; null metadata
are no feature; a score of exactly the threshold is predicted 1; without labelled rows every score is 0.5; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, Words, as_bytes, looked_up, opened, share, steps, table, tidy, utf8

BUCKETS, RANK, SAMPLE, THRESHOLD, METADATA = 1 << 15, 8, 3000, 0.7, ("n_chars",)
META = "metadata "  # before the names of metadata columns on their way to the workers
_CLASSES = np.zeros(256, np.int64)
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 3, 4
for _c in b" \t\r\x0b\x0c":
    _CLASSES[_c] = 5
_CLASSES[10] = 6
for _c in b".,;:?!'\"()-":
    _CLASSES[_c] = 7
_KINDS = 8  # other marks are kind 0


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    metadata: tuple[str, ...] = ()


def features(texts: list[bytes], metadata: dict[str, list[str | None]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and metadata (text, place, weight), text by text, and the dense features of each text."""
    n = len(texts)
    words = Words([t.lower() for t in texts], SPACED)
    counts = np.diff(words.docs)
    owner = np.repeat(np.arange(n), counts)
    place = np.fromiter((xxhash.xxh32_intdigest(w) % BUCKETS for w in as_bytes(words.distinct)), np.int64, len(words.distinct))
    size = max(len(words.distinct), 1)
    key, times = np.unique(owner * size + words.ids, return_counts=True)
    text, at = key // size, place[key % size]
    most = np.zeros(n)
    np.maximum.at(most, text, times)
    distinct = np.bincount(text, minlength=n)
    weight = np.sqrt(times)
    weight /= np.sqrt(np.bincount(text, weights=weight * weight, minlength=n))[text]
    for name, values in (metadata or {}).items():
        known = [i for i, v in enumerate(values) if v is not None]
        hashed = [xxhash.xxh32_intdigest(f"{name}={values[i]}") % BUCKETS for i in known]
        text, at, weight = (np.concatenate([x, np.array(y, x.dtype)]) for x, y in ((text, known), (at, hashed), (weight, [1.0] * len(known))))
    if metadata:
        order = np.argsort(text, kind="stable")
        text, at, weight = text[order], at[order], weight[order]
    # Structure: shares of the kinds of bytes, word and line statistics.
    sizes = np.fromiter(map(len, texts), np.int64, n)
    kind, some = looked_up(b"".join(texts), _CLASSES), np.flatnonzero(sizes)
    kinds = np.zeros((n, _KINDS), np.int64)
    for k in range(_KINDS) if len(some) else ():
        kinds[some, k] = np.add.reduceat(kind == k, (np.cumsum(sizes) - sizes)[some], dtype=np.int64)
    shares = kinds / np.maximum(sizes, 1)[:, None]
    per_word = np.maximum(counts, 1)
    lengths = np.diff(words.offsets) - 1
    mean_length = np.bincount(owner, weights=lengths, minlength=n) / per_word
    last = words.data[words.offsets[1:] - 2] if len(words) else np.empty(0, np.uint8)
    marked = np.bincount(owner, weights=_CLASSES[last] == 0, minlength=n) / per_word
    loud = np.bincount(owner, weights=last == 33, minlength=n) / per_word
    again = np.bincount(owner[1:], weights=(words.ids[1:] == words.ids[:-1]) & (owner[1:] == owner[:-1]), minlength=n) if len(words) else np.zeros(n)
    lines = kinds[:, 6] + 1
    dense = np.column_stack([shares, marked, loud, distinct / per_word, most / per_word, again / per_word, np.log1p(again) / 5, mean_length / 10, np.log1p(counts) / 10, np.log1p(sizes) / 10, np.log1p(counts / lines) / 5, kinds[:, 1] / np.maximum(kinds[:, 1] + kinds[:, 2], 1), counts == 0])
    return text, at, weight, dense


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The sums of each of the factors' values in each of n groups (n, factors); group ascends."""
    out = np.zeros((n, len(values)))
    if len(group):
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for f, row in enumerate(values):
            out[group[heads], f] = np.add.reduceat(row, heads)
    return out


def _parts(m: Machine, text: np.ndarray, at: np.ndarray, weight: np.ndarray, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The margins, each factor's sum over a text's features, and the hashed features' products with the factors."""
    vx = np.ascontiguousarray(m.factors[at].T) * weight
    own = m.factors[BUCKETS:]
    total = scaled @ own + _sums(vx, text, len(scaled))
    squares = (scaled * scaled) @ (own * own) + _sums(vx * vx, text, len(scaled))
    linear = m.bias + scaled @ m.linear[BUCKETS:] + np.bincount(text, weights=m.linear[at] * weight, minlength=len(scaled))
    return linear + 0.5 * (total * total - squares).sum(axis=1), total, vx


def _margins(m: Machine, text: np.ndarray, at: np.ndarray, weight: np.ndarray, dense: np.ndarray) -> np.ndarray:
    return _parts(m, text, at, weight, (dense - m.mean) / m.scale)[0]


def probabilities(m: Machine, texts: list[bytes], metadata: dict[str, list[str | None]] | None = None) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_margins(m, *features(texts, metadata)), -30, 30)))


def train(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], labels: list[int], metadata: tuple[str, ...] = (), seed: int = 11, updates: int = 1000, batch: int = 128, rate: float = 0.02, decay: float = 2e-4) -> Machine:
    """Adagrad on the logistic loss of the found features, about `updates` steps or 20 rounds; label 0, where rare, weighs up to four times as much."""
    rng = np.random.default_rng(seed)
    text, at, weight, dense = found
    y = np.array(labels, np.float64)
    m = Machine(0.0, np.zeros(BUCKETS + dense.shape[1]), rng.normal(0, 0.01, (BUCKETS + dense.shape[1], RANK)), dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3), metadata)
    m.scale = m.scale * 2
    positive = min(max(y.mean(), 1e-6), 1 - 1e-6)
    cost = np.where(y == 1, 1.0, min(4.0, max(1.0, positive / (1 - positive))))
    first = np.searchsorted(text, np.arange(len(y) + 1))
    # Only features that occur are trained: hashed ones by their place among those, then the dense ones.
    used, at = np.unique(at, return_inverse=True)
    spots = np.concatenate([used, np.arange(BUCKETS, BUCKETS + dense.shape[1])])
    linear, factors, bias, k = np.zeros(len(spots)), m.factors[spots].T.copy(), 0.0, len(used)
    seen_linear, seen_factors, seen_bias = np.full(linear.shape, 1e-2), np.full(factors.shape, 1e-2), 1e-2
    scaled = (dense - m.mean) / m.scale
    for _ in range(max(20, -(-updates // -(-len(y) // batch)))):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            rows = np.sort(order[a : a + batch])
            many = first[rows + 1] - first[rows]
            pick = np.repeat(first[rows], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            t, i, w, d = np.repeat(np.arange(len(rows)), many), at[pick], weight[pick], scaled[rows]
            vx = factors[:, i] * w
            total = d @ factors[:, k:].T + _sums(vx, t, len(rows))
            squares = (d * d) @ (factors[:, k:] ** 2).T + _sums(vx * vx, t, len(rows))
            z = bias + d @ linear[k:] + np.bincount(t, weights=linear[i] * w, minlength=len(rows)) + 0.5 * (total * total - squares).sum(axis=1)
            g = cost[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            gw, by_text = g[t] * w, total.T[:, t]
            by_text -= vx
            by_text *= gw
            d_linear = np.concatenate([np.bincount(i, weights=gw, minlength=k), g @ d]) + decay * linear
            words = np.stack([np.bincount(i, weights=x, minlength=k) for x in by_text])
            d_factors = np.concatenate([words, (d.T @ (g[:, None] * total)).T - factors[:, k:] * (g @ (d * d))], axis=1) + decay * factors
            seen_linear += d_linear**2
            seen_factors += d_factors**2
            seen_bias += g.sum() ** 2
            linear -= rate * d_linear / np.sqrt(seen_linear)
            factors -= rate * d_factors / np.sqrt(seen_factors)
            bias -= rate * g.sum() / np.sqrt(seen_bias)
    m.bias, m.linear[spots], m.factors[spots] = float(bias), linear, factors.T
    return m


def _held(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _value(docs: DataFrame, name: str) -> Column:
    """A metadata column as text; numbers by the half power of two that they lie in."""
    c = F.col(f"`{name}`")
    if not isinstance(docs.schema[name].dataType, T.NumericType):
        return c.cast("string")
    return F.concat(F.when(c < 0, "-").otherwise(""), F.round(2 * F.log2(1 + F.abs(c.cast("double")))).try_cast("int").cast("string"))


def _featured(metadata: tuple[str, ...], words_a_text: int | None):
    """The features of each row (id, quality, text and metadata): of all words, or those said most often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 6 << 20):
            text, at, weight, dense = features(utf8(batch, "text"), {c: batch.column(3 + i).to_pylist() for i, c in enumerate(metadata)})
            order = np.lexsort((at, -weight, text))
            first = np.searchsorted(text, np.arange(batch.num_rows + 1))
            most = len(order) if words_a_text is None else words_a_text + len(metadata)
            kept = [np.sort(order[a : min(b, a + most)]) for a, b in zip(first[:-1], first[1:], strict=True)]
            packed = [[at[i].astype(np.uint16).tobytes() for i in kept], [weight[i].astype(np.float32).tobytes() for i in kept], [x.tobytes() for x in dense]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in packed)], names=["id", "quality", "at", "weight", "dense"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, metadata: tuple[str, ...] = (), words_a_text: int | None = None) -> Machine | None:
    """The machine of a bounded sample of the labelled rows that are not held out."""
    if {"doc_id", "text"} & set(metadata):
        raise ValueError("doc_id and text are no metadata")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~_held()).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    # The ids are chosen from the labels alone; texts are read for these, one for each id.
    chosen = known.orderBy(F.xxhash64("id"), "id", "quality").limit(sample).collect()
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame([(r["id"], r["quality"]) for r in chosen], "id long, quality int")
    of = F.struct(F.coalesce("text", F.lit("")).alias("text"), *[_value(docs, c).alias(f"{META}{c}") for c in metadata])
    met = docs.select("doc_id", of.alias("of")).join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    texts = met.groupBy("id", "quality").agg(F.min("of").alias("of")).select("id", "quality", "of.*")
    found = texts.mapInArrow(tidy(_featured(metadata, words_a_text)), "id long, quality int, at binary, weight binary, dense binary")
    rows = sorted(found.collect(), key=lambda r: (r["id"], r["quality"]))
    if not rows:
        return None
    at, weight, dense = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("at", np.uint16), ("weight", np.float32), ("dense", np.float64)))
    text = np.repeat(np.arange(len(rows)), [len(r["at"]) // 2 for r in rows])
    return train((text, at.astype(np.int64), weight.astype(np.float64), dense.reshape(len(rows), -1)), [r["quality"] for r in rows], metadata)


def _score(batch: pa.RecordBatch, m: Machine | None) -> np.ndarray:
    if m is None:
        return np.full(batch.num_rows, 0.5)
    return probabilities(m, utf8(batch, "text"), {c: batch.column(batch.num_columns - len(m.metadata) + i).to_pylist() for i, c in enumerate(m.metadata)})


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared)
        for batch in steps(batches, "text", 6 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_score(batch, m), pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def _passed(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared)
        for batch in steps(batches, "text", 6 << 20):
            yield batch.select(list(range(batch.num_columns - len(m.metadata)))).filter(pa.array(_score(batch, m) >= threshold, pa.bool_()))

    return run


def quality_scores(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text and the machine's metadata)."""
    sent = share(docs.sparkSession, machine)
    more = [_value(docs, c).alias(f"{META}{c}") for c in (machine.metadata if machine else ())]
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held().alias("held_out"), F.col("text"), *more).mapInArrow(tidy(_scored(sent)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the machine predicts as 1, with all columns; without a machine all rows."""
    if machine is None:
        return docs
    # The metadata as texts follow the columns, whose names they may share.
    named = docs.select("*", *[_value(docs, c).alias(f"{META}{c}") for c in machine.metadata])
    return named.mapInArrow(tidy(_passed(share(docs.sparkSession, machine), threshold)), docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels"), metadata=METADATA))
