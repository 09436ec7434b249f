"""Language identification with a byte convolutional network.

Texts become batches of fixed-length byte windows. A byte embedding, filters of several widths, max pooling over the
window and a softmax layer give each window's probabilities; a text's are the mean over all its windows, weighted by
their length. The network is trained in numpy on a bounded sample: of every language `per_language` different labelled
rows (300), those with the smallest hash of id and text, and of all windows of those rows `sample` (24,000, the same number
of each language, one at least) with the smallest hashes. No language is left out, and no part of a row. The windows are
cut and drawn on the executors; the driver gets 6 MB of them, or a window a language. Scoring reads all windows of all
texts. For scoring, embedding and filters fold into tables indexed by byte pairs, so a filter of width w costs about w / 2
look-ups a byte.

Defined results: doc_ids are whole numbers or null; a text that is null or has no letter (a character of a Unicode category L) is `und` with score 0; a
null label is never learned; rows that share an id or repeat are told apart by their text, and equal rows are learned
once; of equal probabilities the first language in order is predicted; without any labelled row every text is `und`
with score 0; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, steps, table, tidy, utf8

LENGTH, EMBED, FILTERS, WIDTHS, PER_LANGUAGE, SAMPLE = 256, 8, 16, (2, 3, 4), 300, 24_000
#: Windows that training looks at: more rounds on small samples.
VISITS = 40_000
_WORD = re.compile(r"[^\W\d_]")  # letters, and numerals that are no digits


def has_letter(text: bytes) -> bool:
    return any(m[0].isalpha() for m in _WORD.finditer(text.decode("utf-8", "replace")))


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray  # 256, EMBED
    filters: dict[int, np.ndarray]  # width: (width, EMBED, FILTERS)
    bias: np.ndarray  # FILTERS of each width
    dense: np.ndarray  # all filters, languages
    dense_bias: np.ndarray


def windows(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All fixed-length windows of the lower-cased texts (padded with zeros), the text and the bytes of each."""
    counts = np.fromiter((-(-len(t) // length) for t in texts), np.int64, len(texts))
    body = b"".join(t.lower() + b"\0" * (-len(t) % length) for t in texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    sizes = np.full(len(owner), length, np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    sizes[last] -= np.fromiter((-len(t) % length for t in texts), np.int64, len(texts))[counts > 0]
    return np.frombuffer(body, np.uint8).reshape(-1, length), owner, sizes


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_windows(texts: list[bytes], seeds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the text of each, and a hash of its text's seed and its place, by which windows are drawn."""
    got, owner, _ = windows(texts)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return got, owner, mixed(mixed(np.array(seeds, np.uint64)[owner]) + place.astype(np.uint64))


def train(x: np.ndarray, labels: list[str], seed: int = 7, epochs: int = 6, batch: int = 64, rate: float = 0.004) -> ByteNet:
    """Adam on labelled windows; a part of the windows is cut short, as short texts are."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    place = {name: k for k, name in enumerate(languages)}
    x, y = x.copy(), np.array([place[name] for name in labels], np.int64)
    for i in np.flatnonzero(rng.random(len(x)) < 0.3):
        x[i, rng.integers(12, LENGTH) :] = 0
    n_out = FILTERS * len(WIDTHS)
    weights = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(n_out), "dense": rng.normal(0, 0.2, (n_out, len(languages))), "dense_bias": np.zeros(len(languages))}
    weights |= {w: rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            b, target = x[shuffled[a : a + batch]], y[shuffled[a : a + batch]]
            rows = np.arange(len(b))
            e = weights["embed"][b]
            pooled, where = [], []
            for w in WIDTHS:
                out = sum(e[:, j : LENGTH - w + 1 + j] @ weights[w][j] for j in range(w))
                where.append(out.argmax(axis=1))
                pooled.append(np.take_along_axis(out, where[-1][:, None], 1)[:, 0])
            before = np.concatenate(pooled, axis=1) + weights["bias"]
            hidden = np.maximum(before, 0)
            p = softmax(hidden @ weights["dense"] + weights["dense_bias"])
            d = p.copy()
            d[rows, target] -= 1
            d /= len(b)
            grads = {"dense": hidden.T @ d + 1e-4 * weights["dense"], "dense_bias": d.sum(axis=0), "embed": np.zeros_like(weights["embed"])}
            back = (d @ weights["dense"].T) * (before > 0)
            grads["bias"] = back.sum(axis=0)
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[w] = np.empty_like(weights[w])
                for j in range(w):
                    bytes_at = b[rows[:, None], where[k] + j]  # the bytes under each filter's best place
                    grads[w][j] = np.einsum("bfe,bf->ef", weights["embed"][bytes_at], part)
                    np.add.at(grads["embed"], bytes_at.ravel(), (part[:, :, None] * weights[w][j].T[None]).reshape(-1, EMBED))
            step += 1
            for key, g in grads.items():
                m, v = moments[key]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weights[key] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    f32 = {k: v.astype(np.float32) for k, v in weights.items()}
    return ByteNet(languages, f32["embed"], {w: f32[w] for w in WIDTHS}, f32["bias"], f32["dense"], f32["dense_bias"])


class Scorer:
    """The network folded into tables: one row for each byte pair (or byte) and position in a filter."""

    def __init__(self, net: ByteNet):
        self.net, self.tables = net, {}
        for w, kernel in net.filters.items():
            by_byte = [net.embed @ kernel[j] for j in range(w)]
            self.tables[w] = [(j, (by_byte[j][:, None] + by_byte[j + 1][None]).reshape(65536, -1) if j + 1 < w else by_byte[j]) for j in range(0, w, 2)]

    def window_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.net.languages)), np.float32)
        for a in range(0, len(x), 64):  # what a few windows need stays in the cache
            b = x[a : a + 64]
            pairs = b[:, :-1].astype(np.int64) * 256 + b[:, 1:]
            pooled = []
            for w, parts in self.tables.items():
                n = x.shape[1] - w + 1
                total = None
                for j, rows in parts:
                    got = rows.take((pairs if len(rows) > 256 else b)[:, j : j + n], axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
            out[a : a + 64] = softmax(hidden @ self.net.dense + self.net.dense_bias)
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        x, owner, sizes = windows(texts)
        total = np.zeros((len(texts), len(self.net.languages)))
        if len(owner):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            total[owner[heads]] = np.add.reduceat(self.window_probabilities(x) * sizes[:, None].astype(np.float64), heads, axis=0)
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def _predict(net: ByteNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = net and Scorer(net)
        for batch in steps(batches, "text", 4 << 20):
            texts = utf8(batch, "text")
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if scorer and has_letter(t)]
            if known:
                p = scorer.probabilities([texts[i] for i in known])
                for i, k, s in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    lang[i], score[i] = net.languages[k], min(max(s, 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each row (lang, seed, text)."""
    for batch in steps(batches, "text", 4 << 20):
        x, owner, drawn = training_windows(utf8(batch, "text"), np.asarray(batch.column(1)).view(np.uint64).tolist())
        for a in range(0, len(x), 10_000):
            here = slice(a, a + 10_000)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[here])), pa.array(drawn[here].view(np.int64)), pa.array([w.tobytes() for w in x[here]], pa.binary())], names=["lang", "drawn", "window"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, most_languages: int | None = None) -> ByteNet | None:
    """The network of a bounded sample of labelled (doc_id, text, lang).

    Rows pass a threshold on their id's hash, at which about twice as many ids of each language remain, before any is
    moved; a language with few ids, whatever number of rows they have, passes whole. most_languages: those with the most
    rows only.
    """
    known = labelled.where("lang is not null and text is not null")
    ids = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids"))
    counts = (ids.orderBy(F.desc("n"), "lang").limit(most_languages) if most_languages else ids).collect()
    if not counts:
        return None
    least = labelled.sparkSession.createDataFrame([(r["lang"], 2.0 * per_language / max(r["ids"], 1)) for r in counts], T.StructType([T.StructField("of", known.schema["lang"].dataType), T.StructField("least", T.DoubleType())]))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    some = known.join(F.broadcast(least), (F.col("lang") == F.col("of")) & (share <= F.col("least"))).select("lang", F.xxhash64("doc_id", "text").alias("seed"), "text")
    first = some.withColumn("copy", F.row_number().over(Window.partitionBy("lang", "seed").orderBy("text"))).where("copy = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("seed", "text"))).where(F.col("rank") <= per_language)
    cut = ranked.select("lang", "seed", "text").mapInArrow(tidy(_cut), T.StructType([known.schema["lang"], T.StructField("drawn", T.LongType()), T.StructField("window", T.BinaryType())]))
    each = max(1, sample // len(counts))
    taken = cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "window"))).where(F.col("rank") <= each)
    rows = sorted(taken.select("lang", "drawn", "window").collect(), key=lambda r: (r["lang"], r["drawn"], bytes(r["window"])))
    if not rows:
        return None
    x = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, LENGTH)
    return train(x, [r["lang"] for r in rows], epochs=max(1, round(VISITS / len(rows))) if len(rows) > VISITS // 6 else 6)


def language_id(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), F.col("text")).mapInArrow(tidy(_predict(net)), "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))).select("doc_id", "text", "lang"))
    return language_id(docs, net)
