"""Token-id output: canonical length-limited Huffman blocks with bit-offset checkpoints.

Documents are dealt by ranges of doc_id that are about equal in bytes, encoded with a public tokenizer and kept as plain
ids; the global counts of the ids give canonical code lengths, limited by package-merge. A file row is one independent
block of whole documents: their ids and lengths, the number of ids before the block, the coded bits, and the bit offset
of every `stride`-th id. Decoding looks codes up in one table; all stretches between checkpoints of a block advance
together, one id a step.

A tokenizer of the production form (`FORM`: lower case, words and marks apart, byte pairs with an end of word) works on
pieces of words: ids are computed once for each distinct piece of a batch and put together. Files of any other form are
read as well; their texts are encoded whole.

Files (Parquet, under one folder): `blocks` as above and `codebook` (id, length). Blocks are in ascending doc_id order by
their `start`.

Defined results: null text is empty and gives the end id alone; null doc_ids come first; rows that share a doc_id
follow one another; an empty table gives empty files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import sys
import types
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, as_bytes, dictionary, looked_up, materialise, partitions, shared_dir, steps, table, tidy, utf8

TOKENIZER, END_ID, MAX_LENGTH, STRIDE, BLOCK_IDS = "word_bpe_49k.json", 1, 18, 128, 1 << 18


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Code lengths and codes


def limited_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most limit bits for positive counts, by package-merge; 0 for the others."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) <= 1:
        lengths[symbols] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(symbols)))))
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    base = counts[order].astype(np.int64)
    packages, levels = np.empty(0, np.int64), []
    for _ in range(limit):
        merged = np.concatenate([base, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(base))  # which of the level's items, in order, are symbols
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    taken = 2 * (len(base) - 1)  # of the last level, then of each level before as many as its packages hold
    sums = np.zeros(len(base), np.int64)
    for leaf in reversed(levels):
        own = int(leaf[:taken].sum())
        sums[:own] += 1
        taken = 2 * (taken - own)
    lengths[order] = sums
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and then of id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    sizes, firsts = np.unique(lengths[order], return_index=True)
    for i, size in enumerate(sizes.tolist()):
        own = order[firsts[i] : firsts[i + 1] if i + 1 < len(firsts) else len(order)]
        code <<= size - before
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, before = code + len(own), size
    return codes


class Huffman:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths)
        self.width = int(lengths.max()) if len(lengths) else 1
        used = np.flatnonzero(lengths)
        used = used[np.argsort(self.codes[used] << (self.width - self.lengths[used]).astype(np.uint64), kind="stable")]
        self.by_prefix = np.repeat(used, 1 << (self.width - self.lengths[used]))
        if len(self.by_prefix) < 1 << self.width:  # a lone symbol leaves half of the codes unused
            self.by_prefix = np.append(self.by_prefix, np.full((1 << self.width) - len(self.by_prefix), used[-1] if len(used) else 0))

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
        """The bits, most significant first, and the bit offset of every stride-th id."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1]) if len(ids) else 0
        word, shift = starts >> 5, 64 - (starts & 31) - sizes
        placed = self.codes[ids] << shift.astype(np.uint64)
        n = (total + 31) // 32 + 1
        # Codes do not overlap, so sums are unions; below 2^53 they are exact as doubles.
        high = np.bincount(word, weights=(placed >> np.uint64(32)).astype(np.float64), minlength=n)
        low = np.bincount(word + 1, weights=(placed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
        packed = (high[:n] + low[:n]).astype(np.uint64).astype(">u4").tobytes()
        return packed[: (total + 7) // 8], starts[::stride].astype(np.uint32)

    def decode(self, payload: bytes, offsets: np.ndarray, n: int, stride: int = STRIDE) -> np.ndarray:
        """The n ids; every stretch of stride ids advances together."""
        out = np.zeros((len(offsets), stride), np.int64)
        body = np.frombuffer(payload + b"\0" * (12 - len(payload) % 4), ">u4").astype(np.uint64)
        pairs = (body[:-1] << np.uint64(32)) | body[1:]
        at = offsets.astype(np.int64)
        last = n - (len(offsets) - 1) * stride
        left = np.uint64(64 - self.width)
        for step in range(stride if len(offsets) > 1 else last):
            if step == last:
                at = at[:-1]
            prefix = (pairs[at >> 5] << (at & 31).astype(np.uint64)) >> left
            got = self.by_prefix[prefix]
            out[: len(at), step] = got
            at = at + self.lengths[got]
        return out.ravel()[:n]


# Words to ids


_ASCII = np.arange(256)
_LOWER = (_ASCII >= 97) & (_ASCII <= 122)
#: ASCII marks at which the tokenizer always parts a text from an ASCII letter; an apostrophe may belong to either side.
_MARK = (_ASCII > 32) & (_ASCII < 127) & ~_LOWER & ~((_ASCII >= 48) & (_ASCII <= 57)) & ~((_ASCII >= 65) & (_ASCII <= 90)) & (_ASCII != 39)
_KIND = SPACED.astype(np.uint8) + _LOWER + 3 * _MARK  # 0 white space, 2 letters, 4 marks, 1 others
_MARKS = frozenset(chr(i) for i in np.flatnonzero(_MARK))


#: The parts of a tokenizer file, besides its vocabulary, for which a text's ids are those of its pieces.
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


def has_form(path: str) -> bool:
    """Whether the tokenizer file has the form that pieces need; words with its added tokens, <|...|>, stay whole."""
    with open(path, encoding="utf-8") as file:
        got = json.load(file)
    model = {k: v for k, v in got["model"].items() if k not in ("vocab", "merges")}
    return model == FORM["model"] and all(got.get(k) == FORM[k] for k in ("normalizer", "pre_tokenizer")) and all(t["content"].startswith("<|") for t in got.get("added_tokens") or [])


class Encoder:
    """Ids of texts, each followed by the end id, from the ids of their distinct pieces; some pieces stay known.

    A piece is a word, cut again between ASCII letters and ASCII marks; no token reaches over a cut. With a tokenizer of
    another form texts are encoded whole.
    """

    def __init__(self, path: str, end_id: int | None = END_ID, remember: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.by_pieces = Tokenizer.from_file(path), end_id, has_form(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.remember = remember
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])

    @classmethod
    def of(cls, path: str, end_id: int | None) -> Encoder:
        """The worker's own encoder, which later tasks of the same worker find again with the pieces it knows."""
        kept = sys.modules.setdefault("_askloom_encoders", types.ModuleType("_askloom_encoders")).__dict__
        if (path, end_id) not in kept:
            kept[path, end_id] = cls(path, end_id)
        return kept[path, end_id]

    def _alone(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.int32).tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _many(self, pieces: list[str], at_once: int = 256) -> list[bytes]:
        """Ids of many pieces, four bytes each. Words of letters and runs of marks go together, told apart by the tokens that end words."""
        out: list[bytes | None] = [None] * len(pieces)
        plain = [i for i, x in enumerate(pieces) if x.isalpha() or _MARKS.issuperset(x)]
        chunks = [plain[a : a + at_once] for a in range(0, len(plain), at_once)]
        for chunk, got in zip(chunks, self.tokenizer.encode_batch_fast([" ".join([pieces[i] for i in c]) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(chunk) and ends[-1] == len(ids):
                held, cuts = ids.tobytes(), (4 * ends).tolist()
                for i, a, b in zip(chunk, [0, *cuts[:-1]], cuts, strict=True):
                    out[i] = held[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._alone([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        each = list(map(self.known.get, pieces))
        new = [i for i, x in enumerate(each) if x is None]
        room = self.remember - len(self.known)
        for i, x in zip(new, self._many([pieces[i].decode("utf-8", "replace") for i in new]), strict=True):
            each[i] = x
            if room > 0:
                self.known[pieces[i]] = x
                room -= 1
        return each

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        end = [] if self.end_id is None else [self.end_id]
        each = [x.ids + end for x in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.int32), np.fromiter(map(len, each), np.int64, len(each))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each text's."""
        if not self.by_pieces:
            return self._whole(texts)
        joined = b"\n".join(texts) + b"\n"
        special = b"<|" in joined  # added tokens are found in the text as it is, so such words stay whole
        if not special:
            joined = joined.lower()
        kind = looked_up(joined, SPACED if special else _KIND)
        inside = kind != 0
        first = inside.copy()
        first[1:] &= (kind[:-1] == 0) | ((kind[1:] ^ kind[:-1]) == 6)  # 6: a letter and a mark
        data = np.frombuffer(joined, np.uint8)[inside]
        ids, distinct = dictionary(np.append(np.flatnonzero(first[inside]), len(data)), data)
        docs = np.searchsorted(np.flatnonzero(first), np.cumsum([0, *(len(t) + 1 for t in texts)]))
        each = self._pieces(as_bytes(distinct))
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.int32)
        firsts = np.cumsum(sizes) - sizes
        count = sizes[ids]
        ends = np.append(0, np.cumsum(count))
        total = ends[docs[1:]] - ends[docs[:-1]]
        extra = int(self.end_id is not None)
        out = np.full(int(ends[-1]) + extra * len(texts), self.end_id or 0, np.int32)
        run = np.arange(int(ends[-1]), dtype=np.int32)
        found = flat[np.repeat((firsts[ids] - ends[:-1]).astype(np.int32), count) + run]
        run += np.repeat(np.arange(len(texts), dtype=np.int32) * extra, total)  # each text before took a place for its end id
        out[run] = found
        return out, total + extra


_FIRST = -(1 << 63)  # where null ids stand
#: What a row weighs besides its text.
ROW_BYTES = 64


def _sizes(fine: np.ndarray):
    """Bytes of the rows (doc_id, n) in each fine range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(fine) + 1, np.int64)
        for batch in batches:
            # Exact up to 2^53 bytes a batch.
            total += np.bincount(np.searchsorted(fine, np.asarray(batch.column(0))), weights=np.asarray(batch.column(1)), minlength=len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    return run


def _bounds(docs: DataFrame, parts: int, finer: int = 16, quantiles: int = 1000) -> np.ndarray:
    """The last doc_id of each range but the last, ranges being about equal in bytes of text.

    Quantiles of the ids, and steps between them where there are too few, bound `finer` times as many fine ranges; their
    bytes are added up, and ranges put together from them. The driver gets one number for each fine range.
    """
    if parts < 2:
        return np.empty(0, np.int64)
    sized = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("n"))
    points = min(finer * parts, quantiles)
    edges = sized.agg(F.percentile_approx("doc_id", [i / points for i in range(points + 1)], 20 * quantiles).alias("x")).first()["x"]
    if not edges:
        return np.empty(0, np.int64)
    each = -(-finer * parts // points)
    fine = np.array([a + (b - a) * k // each for a, b in zip(edges[:-1], edges[1:], strict=True) for k in range(each)][1:], np.int64)
    sizes, found = np.zeros(len(fine) + 1), sized.mapInArrow(tidy(_sizes(fine)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    sizes[np.asarray(found["place"].combine_chunks())] = np.asarray(found["n"].combine_chunks())
    _, first, times = np.unique(fine, return_index=True, return_counts=True)
    for a, n in zip(first[times > 1].tolist(), times[times > 1].tolist(), strict=True):  # an id that fills several fine ranges
        sizes[a : a + n] = sizes[a] / n
    ends = np.cumsum(sizes)
    return fine[np.minimum(np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts), len(fine) - 1)]


def _squeezed(bounds: np.ndarray):
    """doc_id, the compressed text, and the number of the doc_id's range.

    An id with so many rows that it is the bound of several ranges goes to all of them in turn. The turn depends on the
    text and on how often the task has had it, not on the order of rows, so a task that runs again deals alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=1), Counter()
        for batch in steps(batches, "text"):
            ids, texts = batch.column(0), utf8(batch, "text")
            value = np.asarray(ids.fill_null(_FIRST))
            part, last = np.searchsorted(bounds, value), np.searchsorted(bounds, value, side="right")
            for i in np.flatnonzero(last > part + 1).tolist():
                key = int(value[i]), zlib.crc32(texts[i])
                part[i] += (key[1] + seen[key]) % int(last[i] - part[i])
                seen[key] += 1
            yield pa.RecordBatch.from_arrays([ids, pa.array([pack.compress(x) for x in texts], pa.binary()), pa.array(part.astype(np.int32))], names=["doc_id", "body", "part"])

    return run


def _blocks_of_ids(path: str, end_id: int | None, block_ids: int):
    """Consecutive documents to blocks of plain ids (two bytes each where they fit, else four)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        encode, unpack = Encoder.of(path, end_id), zstandard.ZstdDecompressor()

        def block(docs: list[int | None], sizes: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
            flat = np.concatenate(ids)
            wide = bool(len(flat)) and int(flat.max()) > 0xFFFF
            row = [[part], [seq], [before], [docs], [np.concatenate(sizes).tolist()], [wide], [flat.astype("<u4" if wide else "<u2").tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], names=["part", "seq", "before", "doc_ids", "sizes", "wide", "ids"])

        docs, sizes, ids, held = [], [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                some = batch.slice(a, 2048)
                texts = [unpack.decompress(x) for x in some.column(1).to_pylist()]
                cuts, size = [0], 0
                for i, t in enumerate(texts):  # few long texts at a time
                    size += len(t)
                    if size > 5 << 20 or i + 1 == len(texts):
                        cuts.append(i + 1)
                        size = 0
                for b, c in zip(cuts[:-1], cuts[1:], strict=True):
                    got, n = encode(texts[b:c])
                    docs += some.column(0).slice(b, c - b).to_pylist()
                    sizes.append(n)
                    ids.append(got)
                    held += len(got)
                    if held >= block_ids:
                        yield block(docs, sizes, ids)
                        seq, before = seq + 1, before + held
                        docs, sizes, ids, held = [], [], [], 0
        if docs:
            yield block(docs, sizes, ids)

    return run


def _plain(ids: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for wide, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.bincount(_plain(ids, wide))
            if len(got) > len(total):
                got, total = total, got
            total[: len(got)] += got
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])


def _coded(lengths: bytes, firsts: dict[int, int], stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Huffman(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, before, wide, ids = (row.column(k)[0].as_py() for k in (0, 2, 5, 6))
                plain = _plain(ids, wide)
                payload, offsets = code.encode(plain, stride)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([firsts[part] + before]), row.column(3), row.column(4), pa.array([len(plain)], pa.int64()), pa.array([offsets.astype("<u4").tobytes()], pa.binary()), pa.array([payload], pa.binary())],
                    names=["start", "doc_ids", "sizes", "n", "offsets", "payload"],
                )

    return run


BLOCK_SCHEMA = "start long, doc_ids array<long>, sizes array<long>, n long, offsets binary, payload binary"


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID, max_length: int = MAX_LENGTH, stride: int = STRIDE, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs (doc_id, text) and write the files under folder."""
    if stride < 1:
        raise ValueError("stride must be positive")
    spark, path = docs.sparkSession, path or tokenizer_path()
    parts, chosen = partitions(docs), docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    squeezed = chosen.mapInArrow(tidy(_squeezed(_bounds(chosen, parts))), "doc_id long, body binary, part int")
    ranged = squeezed.repartitionById(parts, "part").sortWithinPartitions("doc_id", "body").select("doc_id", "body")
    plain = materialise(ranged.mapInArrow(tidy(_blocks_of_ids(path, end_id, block_ids)), "part int, seq long, before long, doc_ids array<long>, sizes array<long>, wide boolean, ids binary"), "ids")
    # Of the corpus, the driver gets one count for each id of the vocabulary and one for each partition.
    counted = plain.select("wide", "ids").mapInArrow(tidy(_counts), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = limited_lengths(counts, max_length)
    per_part = plain.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    firsts, at = {}, 0
    for r in per_part:
        firsts[r["part"]], at = at, at + r["n"]
    some = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i]), stride) for i in some], "id int, length int, stride int").coalesce(1).write.parquet(f"{folder}/codebook")
    plain.mapInArrow(tidy(_coded(lengths.tobytes(), firsts, stride)), BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_lengths(spark: SparkSession, folder: str) -> tuple[np.ndarray, int]:
    rows = spark.read.schema("id int, length int, stride int").parquet(f"{folder}/codebook").collect()  # bounded by the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]
    return lengths, rows[0]["stride"] if rows else STRIDE


def _documents(lengths: bytes, stride: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Huffman(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, sizes, n, offsets, payload = (batch.column(k)[i].as_py() for k in range(6))
                ids = code.decode(payload, np.frombuffer(offsets, "<u4"), n, stride) if n else np.empty(0, np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                raw = memoryview(ids.astype("<u4").tobytes())
                columns = [pa.array(docs, pa.int64()), pa.array(start + starts), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and ids) of every document in the files under folder."""
    lengths, stride = read_lengths(spark, folder)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    return blocks.mapInArrow(tidy(_documents(lengths.tobytes(), stride, with_ids)), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_output(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    folder = folder or f"{shared_dir(docs.sparkSession)}/askloom-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, path)
    return read_tokens(docs.sparkSession, folder)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
