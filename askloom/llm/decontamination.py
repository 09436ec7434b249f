"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item is a set of shingles (three words, fewer where the window has fewer). A document that contains
the window contains all of them, so one shingle, the window's rarest over the corpus, is the necessary prefix. A first
pass counts the items' shingles over all documents; the second joins each document's shingles with the prefixes, moves
each hit back by the shingle's place in its window (positional bound), drops windows that would reach out of the text
(length bound), and compares the words that are left one by one.

Items are made distinct first, and items of one text are one body with a list of ids (in parts, where the list is long),
so that repeated rows of the benchmark cost nothing. Bodies are dealt by a running count of words and ids to blocks of
about `block_words`, none of them empty, and go to the executors CHAIN blocks at a time in one broadcast (some 50 MB a
block at most): one scan of the documents' texts counts for all of them, one matches, so there are 2 * blocks / CHAIN scans
(`Blocks.scans`). Items too long for a block are cut into pieces that overlap by a window less a word, so no window is
lost. Beyond CHAIN blocks each row takes its hits along from one matching scan to the next, by way of shared storage, so
rows are never joined or told apart. One block is the usual case.

Words: A-Z lower-cased, runs of ASCII letters and digits and non-ASCII characters. Defined results: doc_ids and item_ids are whole numbers or null; null texts and
texts without such words have no words; an item without words has no windows; items that share an id count once; rows
that share a doc_id are judged one by one; without items nothing is hit; an empty table gives an empty table; other
columns are ignored. Benchmark rows without an item_id are ignored by default; with `unnamed`, as in op6 and the
pipeline, their words count as hit, and they are one item, counted in n_items but without a place in the listed ids.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, as_bytes, discard, materialise, opened, partitions, share, steps, table, tidy, utf8

WINDOW, SHINGLE, BLOCK_WORDS, CHAIN = 13, 3, 500_000, 4
#: Shingles of up to three words are held as one number below 2^63.
MOST_WORDS = 2_000_000

log = logging.getLogger(__name__)


def _named(item: int | None) -> tuple[bool, int]:
    """A sorting key: null after all ids."""
    return item is None, item or 0


@dataclass
class Items:
    """Windows of a block of items over a vocabulary of their own words."""

    names: list[list[int | None]]  # the items of each body
    vocabulary: dict[bytes, int]
    words: np.ndarray  # window by window, ids padded with -1
    sizes: np.ndarray
    owner: np.ndarray  # the body of each (window, body) pair
    window_of: np.ndarray  # the window of each such pair, ascending
    shingles: dict[int, np.ndarray]  # shingle length: sorted distinct keys

    @staticmethod
    def of(bodies: list[tuple[bytes, list[int | None]]], window: int) -> Items:
        names = [ids for _, ids in bodies]
        words = Words([t.lower() for t, _ in bodies], ALNUM)
        if not len(words):
            return Items(names, {}, np.empty((0, window), np.int32), *(np.empty(0, np.int64) for _ in range(3)), {})
        lengths = np.diff(words.docs)
        size = np.minimum(lengths, window)
        counts = np.where(lengths > 0, lengths - size + 1, 0)
        row = np.repeat(np.arange(len(bodies)), counts)
        at = words.docs[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        windows = np.full((len(row), window), -1, np.int32)
        for j in range(window):
            fits = j < size[row]
            windows[fits, j] = words.ids[at[fits] + j]
        _, first, same = np.unique(windows.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
        linked = np.unique(same.astype(np.int64) * len(bodies) + row)
        vocabulary = {w: k for k, w in enumerate(as_bytes(words.distinct))}
        if len(vocabulary) > MOST_WORDS:
            raise ValueError(f"a block holds {len(vocabulary)} different words; lower block_words")
        out = Items(names, vocabulary, windows[first], size[row[first]], linked % len(bodies), linked // len(bodies), {})
        out.shingles = {s: np.unique(np.concatenate([out.keys(out.words[:, a:], s)[out.sizes >= a + s] for a in range(window - s + 1)])) for s in range(1, SHINGLE + 1)}
        return out

    def keys(self, ids: np.ndarray, s: int) -> np.ndarray:
        """The exact key of the shingle of s words at the start of each row of ids (unknown words: not below 0)."""
        out = np.zeros(len(ids), np.int64)
        for j in range(s):
            out = out * (len(self.vocabulary) + 1) + ids[:, j] + 1
        return out

    def runs(self, ids: np.ndarray, s: int) -> np.ndarray:
        """As keys, of every run of s words in ids."""
        n = max(len(ids) - s + 1, 0)
        out = np.zeros(n, np.int64)
        for j in range(s):
            out = out * (len(self.vocabulary) + 1) + ids[j : j + n] + 1
        return out

    def known(self, words: Words) -> np.ndarray:
        """The words' ids in the items' vocabulary, -1 for others."""
        mapped = np.fromiter((self.vocabulary.get(w, -1) for w in as_bytes(words.distinct)), np.int64, len(words.distinct))
        return mapped[words.ids]


def _found(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in values of what is among the sorted distinct keys, and which keys."""
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    hit = np.flatnonzero(among[at] == values)
    return hit, at[hit]


def _inside(words: Words, hit: np.ndarray, s: int) -> np.ndarray:
    return hit + s <= words.docs[np.searchsorted(words.docs, hit, side="right")]


def _count(blocks_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = opened(blocks_of)
        totals = [{s: np.zeros(len(k), np.int64) for s, k in items.shingles.items()} for items in blocks]
        for batch in steps(batches, "text"):
            words = Words([t.lower() for t in utf8(batch, "text")], ALNUM)
            if not len(words):
                continue
            for items, total in zip(blocks, totals, strict=True):
                ids = items.known(words)
                for s, among in items.shingles.items():
                    hit, key = _found(_alive(items, ids, s), among)
                    total[s] += np.bincount(key[_inside(words, hit, s)], minlength=len(among))
        for k, total in enumerate(totals):
            for s, n in total.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(np.full(len(some), s)), pa.array(some), pa.array(n[some])], names=["block", "s", "place", "n"])

    return run


def _alive(items: Items, ids: np.ndarray, s: int) -> np.ndarray:
    """Keys of every run of s words, -1 where one of them is in no item."""
    keys = items.runs(ids, s)
    unknown = np.cumsum(np.append(0, ids < 0))
    keys[unknown[s : s + len(keys)] != unknown[: len(keys)]] = -1
    return keys


def _prefixes(items: Items, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shingle length: the sorted prefix keys, where each one's windows begin, the windows, the shingle's place in them."""
    out = {}
    for s in counts:
        mine = np.flatnonzero(np.minimum(items.sizes, SHINGLE) == s)
        if not len(mine):
            continue
        width = int(items.sizes[mine].max()) - s + 1
        rarity = np.full((len(mine), width), np.iinfo(np.int64).max)
        keys = np.zeros((len(mine), width), np.int64)
        for a in range(width):
            fits = items.sizes[mine] >= a + s
            keys[fits, a] = items.keys(items.words[mine[fits], a:], s)
            rarity[fits, a] = counts[s][np.searchsorted(items.shingles[s], keys[fits, a])]
        rarest = rarity.argmin(axis=1)  # of equally rare ones the first
        key = keys[np.arange(len(mine)), rarest]
        order = np.argsort(key, kind="stable")
        distinct, first = np.unique(key[order], return_index=True)
        out[s] = distinct, np.append(first, len(order)), mine[order], rarest[order]
    return out


def occurrences(items: Items, prefixes, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where windows occur: the first word and the window of each occurrence."""
    ids = items.known(words)
    starts, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s, (distinct, first, window, offset) in prefixes.items():
        hit, key = _found(_alive(items, ids, s), distinct)
        many = first[key + 1] - first[key]
        place = np.repeat(first[key], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        at, w = np.repeat(hit, many) - offset[place], window[place]
        text = np.searchsorted(words.docs, np.repeat(hit, many), side="right") - 1
        fits = np.flatnonzero((at >= words.docs[text]) & (at + items.sizes[w] <= words.docs[text + 1]))
        for j in range(items.words.shape[1]):  # words are compared one place after another, in what is left
            place_j = np.minimum(at[fits] + j, len(ids) - 1)
            fits = fits[(items.words[w[fits], j] == ids[place_j]) | (j >= items.sizes[w[fits]])]
        starts.append(at[fits])
        which.append(w[fits])
    return np.concatenate(starts), np.concatenate(which)


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_HITS = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.LongType()))]
_KINDS = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64()))


def _match(texts: list[bytes], blocks: list) -> list[tuple[int, list[tuple[int, int]], list[int | None]]]:
    """Of each text: its number of words, runs of hit words, and items with occurring windows."""
    words = Words([t.lower() for t in texts], ALNUM)
    n, level, found = np.diff(words.docs).tolist(), np.zeros(len(words) + 1, np.int64), [set() for _ in texts]
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    for items, prefixes in blocks if len(words) else ():
        if not prefixes:
            continue
        at, which = occurrences(items, prefixes, words)
        np.add.at(level, at, 1)
        np.add.at(level, at + items.sizes[which], -1)
        seen = np.unique(np.stack([np.searchsorted(words.docs, at, side="right") - 1, which]), axis=1)
        first = np.searchsorted(items.window_of, seen[1], "left")
        many = np.searchsorted(items.window_of, seen[1], "right") - first
        pair = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        for text, body in np.unique(np.stack([np.repeat(seen[0], many), items.owner[pair]]), axis=1).T.tolist():
            found[text].update(items.names[body])
    hit = np.cumsum(level[:-1]) > 0
    if hit.any():
        edge = np.append(True, (hit[1:] != hit[:-1]))
        edge[words.docs[:-1][words.docs[:-1] < len(hit)]] = True
        begins = np.flatnonzero(edge)
        ends = np.append(begins[1:], len(hit))
        begins, ends = begins[hit[begins]], ends[hit[begins]]
        for text, a, b in zip((np.searchsorted(words.docs, begins, side="right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
            runs[text].append((a - int(words.docs[text]), b - int(words.docs[text])))
    return [(k, spans, sorted(ids, key=_named)) for k, spans, ids in zip(n, runs, found, strict=True)]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans' union, as runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passed(shared, first: bool):
    """The rows (key, text) with the hits of their texts in some blocks, added to those of the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = opened(shared)
        for batch in steps(batches, "text"):
            n, spans, ids = zip(*_match(utf8(batch, "text"), blocks), strict=True)
            if not first:
                spans = [_joined(x + [(s["start"], s["end"]) for s in y]) for x, y in zip(spans, batch.column(3).to_pylist(), strict=True)]
                ids = [sorted({*x, *y}, key=_named) for x, y in zip(ids, batch.column(4).to_pylist(), strict=True)]
            spans = [[{"start": a, "end": b} for a, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, kind) for x, kind in zip((n, spans, ids), _KINDS, strict=True))], names=["key", "text", *(f.name for f in _HITS)])

    return run


def _clean(shared):
    """The rows that the blocks do not contaminate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = opened(shared)
        for batch in steps(batches, "text"):
            found = _match(utf8(batch, "text"), blocks)
            yield batch.filter(pa.array([not is_contaminated(n, sum(b - a for a, b in spans)) for n, spans, _ in found], pa.bool_()))

    return run


def _prepared(docs: DataFrame, blocks: Blocks, which: range, window: int):
    """Some blocks' windows and their prefixes, broadcast; both are bounded by the blocks."""
    held = [Items.of(blocks.bodies(k), window) for k in which]
    sent = share(docs.sparkSession, held)
    blocks.scans += 2
    counted = docs.select("text").where("text is not null").mapInArrow(tidy(_count(sent)), "block long, s long, place long, n long").groupBy("block", "s", "place").agg(F.sum("n").alias("n")).toArrow()
    block, s, place, n = (np.asarray(counted[c].combine_chunks()) for c in ("block", "s", "place", "n"))  # no more than the blocks' shingles
    sent.unpersist()
    out = []
    for k, items in enumerate(held):
        counts = {length: np.zeros(len(keys), np.int64) for length, keys in items.shingles.items()}
        for length, total in counts.items():
            mine = (block == k) & (s == length)
            total[place[mine]] = n[mine]
        out.append((items, _prefixes(items, counts)))
    return share(docs.sparkSession, out)


def _cut(window: int, most: int):
    """Items (item_id, text) in pieces of at most `most` words, one space after each word, that share window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            words = Words([t.lower() for t in utf8(batch, "text")], ALNUM, index=False)
            rows = []
            for r, (a, b) in enumerate(zip(words.docs[:-1].tolist(), words.docs[1:].tolist(), strict=True)):
                for c in range(a, max(b - window + 1, a + 1) if b > a else a, most - window + 1):
                    d = min(c + most, b)
                    rows.append((r, d - c, words.data[words.offsets[c] : words.offsets[d]].tobytes()))
            of, n, body = zip(*rows, strict=True) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(n, pa.int64()), pa.array(body, pa.binary())], names=["item_id", "n", "body"])

    return run


class Blocks:
    """The items in blocks of about block_words words and ids; unnamed: also those without an id.

    n: how many blocks; scans: how many scans of documents they have cost.
    """

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, unnamed: bool = False):
        known = benchmark.where("text is not null" if unnamed else "item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
        piece = max(2 * window, block_words // 16)
        pairs = materialise(known.mapInArrow(tidy(_cut(window, piece)), "item_id long, n long, body binary").distinct(), "pairs")
        parts = -(-pairs.count() // piece)  # a body's ids are about piece in each of so many parts, at most
        part, groups = F.pmod(F.xxhash64("item_id"), F.lit(max(1, parts))), partitions(benchmark)
        bodies = pairs.groupBy("body", "n", part.alias("part")).agg(F.collect_set("item_id").alias("ids"), F.bool_or(F.col("item_id").isNull()).alias("none"))
        sized = bodies.select("*", (F.col("n") + F.size("ids")).alias("weight"), F.pmod(F.xxhash64("body", "part"), F.lit(groups)).alias("group"))
        grouped = materialise(sized, "bodies")
        before, totals = 0, []
        for r in grouped.groupBy("group").agg(F.sum("weight").alias("n")).orderBy("group").collect():  # a number a shuffle partition
            totals.append((r["group"], before))
            before += r["n"]
        so_far = F.sum("weight").over(Window.partitionBy("group").orderBy("body", "part"))
        ahead = F.broadcast(benchmark.sparkSession.createDataFrame(totals, "group long, ahead long"))
        dealt = grouped.withColumn("so_far", so_far).join(ahead, "group").select("body", "ids", "none", F.floor((F.col("ahead") + F.col("so_far") - F.col("weight")) / block_words).alias("block"))
        self.pieces, self.scans = materialise(dealt.repartition("block").sortWithinPartitions("block"), "items"), 0
        discard(pairs, grouped)
        self.n = (self.pieces.agg(F.max("block").alias("last")).first()["last"] or 0) + 1

    def bodies(self, k: int) -> list[tuple[bytes, list[int | None]]]:
        """The bodies of a block, each with its items."""
        own = self.pieces.where(F.col("block") == k).collect()
        return sorted((bytes(r["body"]), sorted(r["ids"]) + [None] * r["none"]) for r in own)

    def __getitem__(self, k: int) -> list[tuple[int | None, bytes]]:
        return [(i, body) for body, ids in self.bodies(k) for i in ids]

    def chains(self) -> list[range]:
        return [range(k, min(k + CHAIN, self.n)) for k in range(0, self.n, CHAIN)]


def hits(docs: DataFrame, blocks: Blocks, key: Column, window: int = WINDOW) -> DataFrame:
    """key, n_words, spans (runs of hit words) and items (ids with occurring windows) of every row of docs."""
    rows = docs.select(key.alias("key"), F.col("text"))
    schema, before, chains = T.StructType([*rows.schema.fields, *_HITS]), None, blocks.chains()
    for k, which in enumerate(chains):
        rows = rows.mapInArrow(tidy(_passed(_prepared(docs, blocks, which, window), k == 0)), schema)
        if k + 1 < len(chains):
            rows = materialise(rows, "hits")
            if before is not None:
                discard(before)
            before = rows
    log.info("%d blocks of items, %d scans of the documents", blocks.n, blocks.scans)
    return rows.drop("text")


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, spans, items = (batch.column(k).to_pylist() for k in (1, 2, 3))
        n_hit = [sum(s["end"] - s["start"] for s in x) for x in spans]  # runs apart
        digest = [hashlib.sha256(",".join(sorted(str(i) for i in x if i is not None)).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array([is_contaminated(n, h) for n, h in zip(n_words, n_hit, strict=True)], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, unnamed: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    found = hits(docs, Blocks(benchmark, window, block_words, unnamed), F.col("doc_id").cast("long"), window)
    return found.mapInArrow(tidy(_reported), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, unnamed: bool = False) -> DataFrame:
    """The rows of docs that are not contaminated, with all columns."""
    blocks = Blocks(benchmark, window, block_words, unnamed)
    if len(blocks.chains()) == 1:
        return docs.mapInArrow(tidy(_clean(_prepared(docs, blocks, range(blocks.n), window))), docs.schema)
    found = hits(docs, blocks, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), window)
    n_hit = F.aggregate("spans", F.lit(0), lambda total, x: total + x["end"] - x["start"])  # spans are runs apart
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select("key.*")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark
), item AS (
  SELECT item_id, words, least(13, len(words)) AS size FROM b WHERE len(words) > 0
), grams AS (
  SELECT DISTINCT item_id, size, array_to_string(words[p:p + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS p FROM item)
), sizes AS (
  SELECT DISTINCT size FROM grams
), found AS (
  SELECT doc_id, item_id, d.p, d.size FROM (
    SELECT doc_id, p, size, array_to_string(words[p:p + size - 1], ' ') AS gram FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM w, sizes WHERE len(words) >= size)
  ) d JOIN grams g ON d.gram = g.gram AND d.size = g.size
), n AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS i FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
