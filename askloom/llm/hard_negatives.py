"""Hard-negative mining with a pivot table.

Vectors become integers, floor(scale * x) for each component, and a score is an integer inner product. With M the largest
norm, a row x gets one more component, sqrt(M^2 - |x|^2), and an anchor a gets 0: then |a - x|^2 = |a|^2 + M^2 - 2 a.x, so
the largest inner product is the smallest Euclidean distance. Each row is stored with its distances to some pivots. The
triangle inequality over them, |d(a,p) - d(x,p)| <= d(a,x) <= d(a,p) + d(x,p), brackets the score of a pair without its
vectors, first for a whole block of rows by the block's least and largest distances, then for each row; the pairs whose
bracket meets what is still wanted are scored exactly.

The anchors are a stated query set. They are met with all rows in passes: a pass broadcasts about `block_bytes` of anchors
and scans the table once for the positives and once for the negatives; a task keeps the best of its own rows for each
anchor and sends no more, so a label or a vector that many rows share is no hot key. A random sixteenth of the rows goes
first: its best scores are the floors below which the others send nothing and need not be scored. Pivots are picked
farthest first from `pivot_sample` rows; they change the time only, never the result. The driver holds one pass of
anchors, with at most positives * negatives scores each.

Defined results: vec_ids and labels are whole numbers or null; rows with a null vec_id, label, vector or component, or with a component that is not finite, take no part;
a shorter vector counts as padded with zeros, an empty one as zeros; rows that share a vec_id are rows of their own, but
never each other's positives or negatives; equal scores go by the smaller vec_id; a positive of negative score has no
negatives; squared norms from 2^55 on raise; an empty table, or one without anchors, gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, opened, share, table, tidy

SCALE, PIVOTS, PIVOT_SAMPLE, BLOCK_BYTES = 256, 16, 512, 32 << 20
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows and anchors that are met at a time.
ROWS, ANCHORS = 4096, 1024
#: Wider than the rounding of a stored distance (32-bit) and of a bracket.
SLACK = 1e-6
NONE = 1 << 62
_LARGEST = 1 << 55


def _matrix(vectors: pa.Array, dim: int, kind=np.int32) -> np.ndarray:
    """Lists as rows, padded with zeros."""
    out = np.zeros((len(vectors), dim), kind)
    sizes = np.asarray(pa.compute.list_value_length(vectors)).astype(np.int64)
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(pa.compute.list_flatten(vectors))
    return out


def _whole(scale: int):
    """vec_id, label, vector as whole numbers and squared norm of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.invert(pa.compute.is_null(batch.column(2))))
            lists = batch.column(2)
            sizes = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
            values = np.asarray(pa.compute.fill_null(pa.compute.list_flatten(lists).cast(pa.float64()), float("nan")))
            ends = np.append(0, np.cumsum(sizes))
            bad = np.append(0, np.cumsum(~np.isfinite(values)))
            good = bad[ends[1:]] == bad[ends[:-1]]
            values = np.floor(scale * values[np.repeat(good, sizes)])
            sizes = sizes[good]
            ends = np.append(0, np.cumsum(sizes))
            squares = np.append(0.0, np.cumsum(values * values))  # tells what is far too large; exact norms follow
            if len(values) and (np.abs(values).max() >= 1 << 28 or squares[-1] >= 1 << 62):
                if max((values[a:b] @ values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)), default=0) >= _LARGEST:
                    raise ValueError("vectors are too long for 64-bit scores")
            whole = values.astype(np.int64)
            total = np.append(0, np.cumsum(whole * whole))  # differences are exact, also where the sum wraps around
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole.astype(np.int32))), pa.array(total[ends[1:]] - total[ends[:-1]])], names=["vec_id", "label", "vector", "norm"]
            )

    return run


def farthest(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points (all, if fewer), each the farthest from those before; the first of them first."""
    chosen, away = [], np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        chosen.append(0 if not chosen else int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def lifted(vectors: np.ndarray, norms: np.ndarray, most: int) -> np.ndarray:
    """Rows with the component that makes all of them as long as the longest."""
    return np.column_stack([vectors.astype(np.float64), np.sqrt(np.maximum(most - norms, 0).astype(np.float64))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(points), len(pivots)), np.float32)
    for k, pivot in enumerate(pivots):
        out[:, k] = np.sqrt(((points - pivot) ** 2).sum(axis=1))
    return out


def _measured(shared):
    """The rows with their distances to the pivots, the nearest pivot and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, dim, most = opened(shared)
        for batch in batches:
            if not batch.num_rows:
                continue
            away = distances(lifted(_matrix(batch.column(2), dim), np.asarray(batch.column(3)), most), pivots)
            near = away.argmin(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(away) + 1) * len(pivots), pa.int32()), pa.array(away.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(away)), near])], names=["vec_id", "label", "vector", "norm", "away", "near", "reach"])

    return run


@dataclass
class Wanted:
    """Anchors of a pass: of each, scores from low to high are wanted, `best` of them, for each of its slots."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # of a kind in which scores are exact
    norms: np.ndarray
    away: np.ndarray
    most: int  # the largest squared norm of a row
    low: np.ndarray  # anchors x slots
    high: np.ndarray
    best: int
    alike: bool  # rows of the anchor's label, or of another


def exact_kind(most: int):
    """The fastest kind of number that holds all scores, and all sums on the way to them, exactly."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def bracketed(low: np.ndarray, high: np.ndarray, norms: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score at distances from low to high."""
    total = norms[:, None].astype(np.float64) + most
    slack = total * SLACK
    return (total - high.astype(np.float64) ** 2) / 2 - slack, (total - low.astype(np.float64) ** 2) / 2 + slack


def survivors(q: Wanted, at: np.ndarray, away: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """anchors x rows: whether a pair's bracket meets its anchor's range, of the anchors at these places."""
    least, most = np.zeros((len(at), len(away)), np.float32), np.full((len(at), len(away)), np.inf, np.float32)
    for p in range(away.shape[1]):
        a, x = q.away[at, p][:, None], away[:, p][None, :]
        np.maximum(least, np.abs(a - x) - SLACK * (a + x), out=least)
        np.minimum(most, (a + x) * np.float32(1 + SLACK), out=most)
    lower, upper = bracketed(least, most, q.norms[at], q.most)
    return (upper >= low[:, None]) & (lower <= high[:, None])


class Best:
    """The best rows so far for each anchor and slot."""

    def __init__(self, q: Wanted):
        self.q, self.low = q, q.low.copy()
        self.slot, self.score, self.row = (np.empty(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        slot, score, row = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.row, row])
        order = np.lexsort([row, -score, slot])
        slot, score, row = slot[order], score[order], row[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.empty(0, np.int64)
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        last = place == self.q.best - 1
        self.low.ravel()[slot[last]] = np.maximum(self.low.ravel()[slot[last]], score[last])
        kept = place < self.q.best
        self.slot, self.score, self.row = slot[kept], score[kept], row[kept]

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, away: np.ndarray) -> None:
        """All anchors and a block of rows."""
        q, found = self.q, []
        nearest, widest = away.min(axis=0), away.max(axis=0)
        for first in range(0, len(q.ids), ANCHORS):
            at = np.arange(first, min(first + ANCHORS, len(q.ids)))
            low, high = self.low[at].min(axis=1), q.high[at].max(axis=1)
            a = q.away[at]
            gap = (np.maximum(np.maximum(a - widest, nearest - a), 0) - SLACK * (a + widest)).max(axis=1)
            lower, upper = bracketed(np.maximum(gap, 0)[:, None], ((a + widest) * (1 + SLACK)).min(axis=1)[:, None], q.norms[at], q.most)
            lower, upper = lower[:, 0], upper[:, 0]
            met = (upper >= low) & (lower <= high) & (low <= high)
            at, low, high = at[met], low[met], high[met]
            if not len(at):
                continue
            alive = survivors(q, at, away, low, high) & ((q.labels[at][:, None] == labels[None, :]) == q.alike) & (q.ids[at][:, None] != ids[None, :])
            some = np.flatnonzero(alive.any(axis=0))
            if not len(some):
                continue
            scores, alive = q.vectors[at] @ vectors[some].T, alive[:, some]
            for j in range(self.low.shape[1]):
                inside = alive & (scores >= self.low[at, j].astype(scores.dtype)[:, None]) & (scores <= q.high[at, j].astype(scores.dtype)[:, None])
                if len(some) > q.best:  # no more than the best of the block, and ties of the last
                    held = np.where(inside, scores, -NONE)
                    inside &= scores >= np.partition(held, len(some) - q.best, axis=1)[:, len(some) - q.best][:, None]
                i, x = np.nonzero(inside)
                found.append((at[i] * self.low.shape[1] + j, scores[i, x].astype(np.int64), ids[some[x]]))
        if found:
            self.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _searched(shared):
    """(anchor's place in its pass, slot, vec_id, score) of the best rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = opened(shared)
        best, slots = Best(q), q.low.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = _matrix(part.column(2), q.vectors.shape[1], q.vectors.dtype)
                best.meet(np.asarray(part.column(0)), np.asarray(part.column(1)), vectors, _matrix(part.column(3), q.away.shape[1], np.float32))
        anchor = best.slot // slots
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(q.ids[anchor]), pa.array(best.slot % slots), pa.array(best.row), pa.array(best.score)], names=["anchor", "anchor_id", "slot", "vec_id", "score"])

    return run


def _search(rows: DataFrame, q: Wanted) -> DataFrame:
    sent = share(rows.sparkSession, q)
    return rows.select("vec_id", "label", "vector", "away").mapInArrow(tidy(_searched(sent)), "anchor long, anchor_id long, slot long, vec_id long, score long")


def _top(found: DataFrame, best: int) -> DataFrame:
    """The best of each anchor and slot, with their place from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best)


def _gathered(rows: DataFrame, q: Wanted, name: str) -> DataFrame:
    """The best of all rows: first of the early ones, whose last places are floors for the others."""
    early = materialise(_top(_search(rows.where("early"), q), q.best), f"{name}-early")
    low = q.low.copy()
    last = early.where(F.col("place") == q.best).select("anchor", "slot", "score").toArrow()  # one number for each anchor and slot
    low[np.asarray(last["anchor"]), np.asarray(last["slot"])] = np.asarray(last["score"])
    rest = _search(rows.where("not early"), replace(q, low=np.maximum(q.low, low)))
    found = materialise(_top(early.drop("place").unionByName(rest), q.best), name)
    discard(early)
    return found


def pivot_table(embeddings: DataFrame, anchors: Column, scale: int = SCALE, pivots: int = PIVOTS, pivot_sample: int = PIVOT_SAMPLE) -> tuple[DataFrame, np.ndarray, int, int] | None:
    """The rows that take part with their distances to the pivots, on shared storage; the pivots, the number of anchors, the largest squared norm.

    Rows of a task lie by their nearest pivot and the distance to it, so a block of them is a thin shell.
    """
    known = embeddings.where("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding"))
    whole = known.mapInArrow(tidy(_whole(scale)), "vec_id long, label long, vector array<int>, norm long")
    seen = whole.agg(F.max("norm").alias("most"), F.max(F.size("vector")).alias("dim"), F.count_if(anchors).alias("anchors")).first()
    if not seen["anchors"]:
        return None
    most, dim = seen["most"], seen["dim"]
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector", "norm").limit(pivot_sample).toArrow()
    points = lifted(_matrix(sample["vector"].combine_chunks(), dim), np.asarray(sample["norm"]), most)
    chosen = farthest(points, pivots)
    shared = share(embeddings.sparkSession, (chosen, dim, most))
    measured = whole.mapInArrow(tidy(_measured(shared)), "vec_id long, label long, vector array<int>, norm long, away array<float>, near int, reach float")
    early = (F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(16)) == 0).alias("early")
    laid = measured.select("*", early, F.coalesce(anchors, F.lit(False)).alias("is_anchor"), F.rand(17).alias("draw")).sortWithinPartitions("early", "near", "reach")
    return materialise(laid, "pivots"), chosen, seen["anchors"], most


def hard_negatives(embeddings: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, pivots: int = PIVOTS, pivot_sample: int = PIVOT_SAMPLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of embeddings (vec_id, label, embedding).

    anchors: a condition on vec_id and label. An anchor's positives are the best rows of its label; the negatives of a
    positive the best rows of other labels whose scores are from low to high per cent of the positive's.
    """
    found = pivot_table(embeddings, anchors, scale, pivots, pivot_sample)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, points, n, most = found
    dim, out = points.shape[1] - 1, []
    passes = -(-n * (8 * dim + 4 * len(points) + 16 * positives + 32) // block_bytes)
    for k in range(passes):
        mine = rows.where(F.col("is_anchor") & (F.floor(F.col("draw") * passes) == k)).select("vec_id", "label", "vector", "norm").toArrow()
        if not len(mine):
            continue
        ids, labels, vectors, norms = (mine[c].combine_chunks() for c in mine.column_names)
        vectors, none = _matrix(vectors, dim, exact_kind(most)), np.full((len(mine), 1), NONE, np.int64)
        away = distances(np.column_stack([vectors.astype(np.float64), np.zeros(len(mine))]), points)
        q = Wanted(np.asarray(ids), np.asarray(labels), vectors, np.asarray(norms), away, most, -none, none, positives, True)
        out.append(_mined(rows, q, negatives, low, high))
    discard(rows)
    return functools.reduce(DataFrame.unionByName, out)


def _mined(rows: DataFrame, q: Wanted, negatives: int, low: int, high: int) -> DataFrame:
    """The negatives of a pass, on shared storage."""
    met = _gathered(rows, q, "positives")
    score = np.full((len(q.ids), q.best), -1, np.int64)  # as of a positive that is not there
    seen = met.select("anchor", "place", "score").toArrow()
    score[np.asarray(seen["anchor"]), np.asarray(seen["place"]) - 1] = np.asarray(seen["score"])
    least, most = -(-low * score // 100), high * score // 100
    wanted = replace(q, low=np.where(score < 0, NONE, least), high=np.where(score < 0, -NONE, most), best=negatives, alike=False)
    found = _gathered(rows, wanted, "negatives")
    named = met.select("anchor", (F.col("place") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    whole = found.join(named, ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = materialise(whole, "mined")
    discard(met, found)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the contract has it: labels of every seventh vec_id go one up, anchors are every hundredth."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_inner_product(a.q, x.q)::BIGINT AS score FROM v a, v x WHERE a.vec_id % 100 = 0 AND x.vec_id <> a.vec_id
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INT AS rank, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT * FROM n WHERE rank <= 10
"""
