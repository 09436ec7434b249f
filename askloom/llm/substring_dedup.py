"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one document. Consecutive windows whose smallest hashed m-gram of words
(the minimiser) is the same travel as one packed string to that minimiser's bucket. All occurrences of a window have
the same minimiser, so a bucket sees all of them; sorting the bucket's windows finds those that also start in a
document with a smaller id, and comparing their words makes the result exact.

Equal packed strings of one batch are sent once, with the smallest document id: whoever else holds that string loses
it whatever the rest of the corpus holds, so large groups of copies shrink before the shuffle. Buckets are handled one
at a time. One above `bucket_bytes` holds equal strings once; if that is still too much, its strings are cut again and
dealt anew to all partitions: by minimisers of another hash first, which parts windows that share a hot minimiser, then
by longer ones, which reach out of a hot phrase, and at last by the windows themselves, which only equal windows share.
There are then as many buckets as their size asks for, and they are dealt in order of doc_id: the first document seen with
a window is the least that has it, so only a bucket's different windows are held, however often a document repeats them.

Defined results: doc_ids are whole numbers or null; null or empty texts have no words; a document with fewer words than a window loses nothing; rows with
the same doc_id never remove from one another (neither id is smaller); rows with a null doc_id keep all words and
remove none from others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, Words, as_bytes, chained, dictionary, materialise, mixed, partitions, steps, table, tidy, utf8

WINDOW, MINIMISER, BUCKET_BYTES = 50, 8, 48 << 20
_FIELDS = (("doc", np.int64), ("mark", np.int64), ("start", np.int32), ("count", np.int32))


def _packed(parts: list[np.ndarray | bytes]) -> bytes:
    body = b"".join(np.int64(len(x if isinstance(x, bytes) else x.tobytes())).tobytes() + (x if isinstance(x, bytes) else x.tobytes()) for x in parts)
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpacked(blob: bytes) -> list[bytes]:
    body, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(body):
        n = int(np.frombuffer(body, np.int64, 1, at)[0])
        out.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _super_kmers(texts: list[bytes], window: int, m: int, seed: int = 0):
    """For every super-k-mer: the text's number, first word in it, number of windows, minimiser and packed words."""
    import xxhash

    words = Words(texts, SPACED)
    if len(words) < window:
        return None
    vocabulary = np.fromiter((xxhash.xxh64_intdigest(w) for w in as_bytes(words.distinct)), np.uint64, len(words.distinct))
    grams = mixed(chained(vocabulary[words.ids], m) + np.uint64(seed))
    span, least, have = window - m + 1, grams, 1  # the smallest of span consecutive grams, by doubling
    while have * 2 <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    least = np.minimum(least[: len(grams) - span + 1], least[span - have : span - have + len(grams) - span + 1])
    ends = np.repeat(words.docs[1:], np.diff(words.docs))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= ends)
    if not len(at):
        return None
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    start, count = at[first], np.diff(np.append(first, len(at)))
    text = np.searchsorted(words.docs, start, side="right") - 1
    held = memoryview(words.data)
    strings = [bytes(held[a:b]) for a, b in zip(words.offsets[start].tolist(), words.offsets[start + count + window - 1].tolist(), strict=True)]
    return text, start - words.docs[text], count, value[first], strings


def _scatter(buckets: int, window: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 8 << 20):
            doc, mark = (np.asarray(batch.column(k)) for k in (0, 1))
            once = np.unique(np.stack([doc, mark]), axis=1, return_index=True)[1]  # equal rows share their spans
            texts = utf8(batch, "text")
            doc, mark, texts = doc[once], mark[once], [texts[i] for i in once.tolist()]
            found = _super_kmers(texts, window, m)
            if found is None:
                continue
            text, start, count, value, strings = found
            order = np.argsort(doc[text], kind="stable")
            leaders: dict[bytes, int] = {}
            lead = np.fromiter((leaders.setdefault(strings[i], i) for i in order.tolist()), np.int64, len(order))
            kept = order[lead == order]
            same = order[(lead != order) & (doc[text[order]] > doc[text[lead]])]
            own = order[(lead != order) & (doc[text[order]] == doc[text[lead]])]
            # Repeats within a document share its fate; they need their own places.
            kept = np.concatenate([kept, own])
            bucket = (value % np.uint64(buckets)).astype(np.int64)
            kept, same = kept[np.argsort(bucket[kept], kind="stable")], same[np.argsort(bucket[same], kind="stable")]
            used = np.union1d(bucket[kept], bucket[same])
            ka, kb = (np.searchsorted(bucket[kept], used, side) for side in ("left", "right"))
            sa, sb = (np.searchsorted(bucket[same], used, side) for side in ("left", "right"))

            def fields(i: np.ndarray) -> list[np.ndarray]:
                return [x.astype(kind) for x, (_, kind) in zip((doc[text[i]], mark[text[i]], start[i], count[i]), _FIELDS, strict=True)]

            blobs = []
            for a, b, c, d in zip(ka, kb, sa, sb, strict=True):
                mine = kept[a:b]
                blobs.append(_packed([*fields(same[c:d]), *fields(mine), b"".join(strings[i] for i in mine.tolist())]))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _removed_windows(doc: np.ndarray, count: np.ndarray, data: bytes, window: int) -> np.ndarray:
    """Whether each window of the super-k-mers also starts in a document with a smaller id."""
    buffer = np.frombuffer(data, np.uint8)
    ids, _ = dictionary(np.append(0, np.flatnonzero(buffer == 32) + 1), buffer)
    firsts = np.cumsum(count + window - 1) - (count + window - 1)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(firsts, count) + inside
    owner = np.repeat(doc, count)
    key = chained(mixed(ids.astype(np.uint64) + np.uint64(1)), window)[place]
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    out = np.zeros(len(key), bool)
    if not len(twice):
        return out
    near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    some = np.flatnonzero(twice[near] == key)
    some = some[np.lexsort((owner[some], key[some]))]
    head = np.ones(len(some), bool)
    head[1:] = key[some[1:]] != key[some[:-1]]
    lead = some[np.flatnonzero(head)[np.cumsum(head) - 1]]
    equal = np.empty(len(some), bool)
    spread = np.arange(window)
    for a in range(0, len(some), 1 << 16):  # words are compared, so equal hashes alone remove nothing
        here = slice(a, a + (1 << 16))
        equal[here] = (ids[place[some[here], None] + spread] == ids[place[lead[here], None] + spread]).all(axis=1)
    out[some] = equal & (owner[some] > owner[lead])
    for value in np.unique(key[some[~equal]]):  # different windows with one hash: told apart one by one
        least: dict[bytes, int] = {}
        for i in some[key[some] == value].tolist():  # in order of doc
            out[i] = least.setdefault(ids[place[i] : place[i] + window].tobytes(), int(owner[i])) < owner[i]
    return out


def _runs(removed: np.ndarray, doc, mark, start, count, window: int):
    """Intervals of removed words: runs of removed windows within each super-k-mer."""
    owner = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = removed.copy()
    first[1:] &= ~(removed[:-1] & (owner[1:] == owner[:-1]))
    last = removed.copy()
    last[:-1] &= ~(removed[1:] & (owner[1:] == owner[:-1]))
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return doc[owner[a]], mark[owner[a]], start[owner[a]] + inside[a], start[owner[b]] + inside[b] + window


_OUT = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()), ("size", pa.int64())])


class Strings:
    """Super-k-mers with equal strings held once, for the smallest document."""

    def __init__(self):
        self.leaders: dict[bytes, tuple[int, int, int, int]] = {}
        self.more: list[tuple[int, int, int, int]] = []  # repeats within a document need their own places
        self.words: list[bytes] = []
        self.size = 0

    def add(self, own: list[np.ndarray], body: bytes, window: int) -> list[tuple[int, int, int, int]]:
        """Take a blob's super-k-mers; returns those that another document with a smaller id is known to hold."""
        gone = []
        ends = np.append(0, np.flatnonzero(np.frombuffer(body, np.uint8) == 32) + 1)[np.append(0, np.cumsum(own[3].astype(np.int64) + window - 1))].tolist()
        for a, b, *mine in zip(ends[:-1], ends[1:], *(x.tolist() for x in own), strict=True):
            string, mine = body[a:b], tuple(mine)
            lead = self.leaders.setdefault(string, mine)
            if lead is mine:
                self.size += b - a + 200
            elif lead[0] < mine[0]:
                gone.append(mine)
            elif lead[0] > mine[0]:
                gone.append(lead)
                self.leaders[string] = mine
            else:
                self.more.append(mine)
                self.words.append(string)
                self.size += b - a + 200
        return gone

    def arrays(self) -> tuple[list[np.ndarray], list[bytes]]:
        return [np.array(x, np.int64) for x in zip(*self.leaders.values(), *self.more, strict=True)], [*self.leaders, *self.words]


def _spans(doc, mark, start, end) -> pa.RecordBatch:
    columns = [np.asarray(x, kind) for x, kind in zip((doc, mark, start, end), (np.int64, np.int64, np.int32, np.int32), strict=True)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.nulls(len(columns[0]), kind) for kind in _OUT.types[4:])], schema=_OUT)


def _opened(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray], bytes]:
    """Strings that other documents of the batch held too, and the rest with their packed words."""
    *fields, body = _unpacked(blob)
    arrays = [np.frombuffer(x, kind) for x, kind in zip(fields, [k for _, k in _FIELDS] * 2, strict=True)]
    return arrays[:4], arrays[4:], body


class Firsts:
    """The least document of each window of a bucket whose strings come in order of doc."""

    def __init__(self, window: int):
        self.window, self.least = window, {}

    def removed(self, doc: int, count: int, string: bytes) -> list[tuple[int, int]]:
        """Runs of windows of a string that a smaller document holds."""
        out: list[list[int]] = []
        words = np.append(0, np.flatnonzero(np.frombuffer(string, np.uint8) == 32) + 1).tolist()
        for k in range(count):
            if self.least.setdefault(string[words[k] : words[k + self.window]], doc) < doc:
                if out and out[-1][1] == k:
                    out[-1][1] = k + 1
                else:
                    out.append([k, k + 1])
        return [(a, b) for a, b in out]


def _in_order(window: int):
    """Spans of removed words, of buckets that lie in order of doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((bucket, blob) for batch in batches for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for _, own in itertools.groupby(rows, key=lambda row: row[0]):
            firsts = Firsts(window)
            for _, blob in own:
                _, strings, body = _opened(blob.as_py())
                ends = np.append(0, np.flatnonzero(np.frombuffer(body, np.uint8) == 32) + 1)[np.append(0, np.cumsum(strings[3].astype(np.int64) + window - 1))].tolist()
                gone = [(doc, mark, start + x, start + y - 1 + window) for a, b, doc, mark, start, count in zip(ends[:-1], ends[1:], *(x.tolist() for x in strings), strict=True) for x, y in firsts.removed(doc, count, body[a:b])]
                if gone:
                    yield _spans(*zip(*gone, strict=True))

    return run


def _gather(window: int, m: int, limit: int, buckets: int, seed: int = 1, by_doc: bool = False):
    """Spans of removed words. With buckets, what does not fit is cut again by m-grams and handed on, by_doc each document's part on its own; without, it is held."""

    def lost(which: list[tuple[int, int, int, int]] | list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(which):
            doc, mark, start, count = np.array(which, np.int64).T
            yield _spans(doc, mark, start, start + count + window - 1)

    def judged(own: list[np.ndarray], data: bytes) -> Iterator[pa.RecordBatch]:
        if own and len(own[0]):
            doc, mark, start, count = (x.astype(np.int64) for x in own)
            yield _spans(*_runs(_removed_windows(doc, count, data, window), doc, mark, start, count, window))

    def cut_again(held: Strings) -> Iterator[pa.RecordBatch]:
        own, strings = held.arrays()
        # A cut copies each word into so many strings at most; as much is cut at once as gives a quarter of the limit.
        at_once = max(1, limit // (4 * (window // max(1, (window - m + 1) // 2) + 1)))
        ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
        parts = np.searchsorted(ends, np.arange(at_once, ends[-1], at_once)).tolist() if strings else []
        for a, b in itertools.pairwise(sorted({0, *parts, len(strings)})):
            yield from dealt_anew([x[a:b] for x in own], strings[a:b])

    def dealt_anew(own: list[np.ndarray], strings: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = _super_kmers(strings, window, m, seed)
        if found is None:
            return
        text, first, count, value, words = found
        bucket = (value % np.uint64(buckets)).astype(np.int64)
        fields = own[0][text], own[1][text], own[2][text] + first, count
        doc = fields[0] if by_doc else np.zeros(len(bucket), np.int64)
        order = np.lexsort((doc, bucket))
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order]) | np.diff(doc[order])) + 1):
            mine = [x[part].astype(kind) for x, (_, kind) in zip(fields, _FIELDS, strict=True)]
            body = b"".join(words[i] for i in part.tolist())
            blob = _packed([*(np.empty(0, kind) for _, kind in _FIELDS), *mine, body])
            yield pa.RecordBatch.from_arrays([pa.array([doc[part[0]]], pa.int64()), *(pa.nulls(1, kind) for kind in _OUT.types[1:4]), pa.array([bucket[part[0]]], pa.int32()), pa.array([blob], pa.binary()), pa.array([len(body)], pa.int64())], schema=_OUT)

    def one_bucket(blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        plain: list[tuple[list[np.ndarray], bytes]] | None = []
        size, held, handed_on = 0, Strings(), False
        for blob in blobs:
            same, own, body = _opened(blob)
            yield from lost(np.stack([x.astype(np.int64) for x in same], axis=1))
            if plain is not None:
                plain.append((own, body))
                size += len(body)
                if size <= limit:
                    continue
                waiting, plain = plain, None
            else:
                waiting = [(own, body)]
            for part in waiting:
                yield from lost(held.add(*part, window))
                if buckets and held.size > limit:
                    yield from cut_again(held)
                    held, handed_on = Strings(), True
            waiting.clear()
        if plain:
            yield from judged([np.concatenate(x) for x in zip(*(own for own, _ in plain), strict=True)], b"".join(body for _, body in plain))
        elif handed_on:
            yield from cut_again(held)
        else:
            own, strings = held.arrays()
            yield from judged(own, b"".join(strings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((bucket, blob) for batch in batches for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for _, own in itertools.groupby(rows, key=lambda row: row[0]):
            yield from one_bucket(blob.as_py() for _, blob in own)

    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in steps(batches, "text"):
        texts = pa.array([pack.compress(x) for x in utf8(batch, "text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "mark", "body"])


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = unpack.decompress(body.as_py()).split()
                n = len(words)
                if spans:
                    level = np.zeros(n + 1, np.int64)
                    np.add.at(level, [x["start"] for x in spans], 1)
                    np.add.at(level, [x["end"] for x in spans], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(level[:n]) == 0).tolist()]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept if with_text else b""))
            n, gone, digest, kept = zip(*rows, strict=True) if rows else ((),) * 4
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    return run


def removed_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, mark, start, end): words start to end of a document that a window of a smaller doc_id covers.

    mark is the text's XXH64, which tells apart rows that share a doc_id.
    """
    n, schema = partitions(docs), "doc long, mark long, start int, end int, bucket int, blob binary, size long"
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text")).where("doc_id is not null and text is not null")
    sent, found = keyed.mapInArrow(tidy(_scatter(8 * n, window, minimiser)), "bucket int, blob binary"), []
    buckets = 8 * n
    for seed, m in enumerate((minimiser, (minimiser + window + 1) // 2, window, window), 1):
        dealt = sent.repartitionById(n, F.col("bucket") % n)
        if seed == 4:
            ordered = dealt.sortWithinPartitions("bucket", "doc").select("bucket", "blob")
            found.append(materialise(ordered.mapInArrow(tidy(_in_order(window)), schema), "spans").select("doc", "mark", "start", "end"))
            break
        once = materialise(dealt.sortWithinPartitions("bucket").select("bucket", "blob").mapInArrow(tidy(_gather(window, m, bucket_bytes, buckets, seed, seed == 3)), schema), "spans")
        found.append(once.where("blob is null").select("doc", "mark", "start", "end"))
        sent, size = once.where("blob is not null").select("bucket", "blob", "doc"), once.agg(F.sum("size").alias("n")).first()["n"]
        if not size:
            break
        # Cut into windows, each word comes in window copies; a bucket gets a quarter of what it may hold.
        buckets = min(max(8 * n, 4 * window * size // bucket_bytes), (1 << 31) - 1)
    return functools.reduce(DataFrame.union, found)


def substring_dedup(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text of every row of docs (doc_id, text)."""
    if not 1 <= minimiser <= window:
        raise ValueError("minimiser must be between 1 and window")
    spans = removed_spans(docs, window, minimiser, bucket_bytes).groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text")).mapInArrow(tidy(_squeezed), "doc_id long, mark long, body binary")
    both = whole.join(spans, (whole["doc_id"] == spans["doc"]) & (whole["mark"] == spans["mark"]), "left").select(whole["doc_id"], "body", "spans")
    return both.mapInArrow(tidy(_kept(with_text)), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


#: Window starts of each document against the smallest document of each window, then the words that such windows cover.
OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), grams AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS p FROM w
), keyed AS (
  SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS gram FROM grams
), firsts AS (
  SELECT gram, min(doc_id) AS least FROM keyed GROUP BY gram
), dup AS (
  SELECT k.doc_id, unnest(range(k.p, k.p + 50)) AS i FROM keyed k JOIN firsts f ON k.gram = f.gram AND f.least < k.doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT i) AS places FROM dup GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(words) AS n, CASE WHEN places IS NULL THEN words
    ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END AS left_over
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, (n - len(left_over))::BIGINT AS n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept
"""
