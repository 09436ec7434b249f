"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words are runs of anything but ASCII white space, three-word shingles with repeats (fewer
words: the whole sequence; none: fingerprint zero), XXH64 with seed 42 of each; a bit is 1 if set in over half of them.

Linking works on distinct fingerprints. Bits that go together over the corpus are grouped into partitions, so that the
partitions are as independent as possible; partition i gets its own threshold t_i >= -1 with sum(t_i) = tau - m + 1
(two fingerprints within tau bits are within t_i in some partition i), chosen by dynamic programming on candidate counts
estimated from the counts of partition values over all fingerprints. Each fingerprint probes the partitions with all
values within t_i, and a hit is verified on all 64 bits. Values that more than `hot` fingerprints share would give
squares; their fingerprints probe all neighbours within tau bits instead, exactly and in proportion to their number.
Components come from least-label propagation with pointer jumping.

Defined results: doc_ids are whole numbers or null; null text is empty; texts without words share fingerprint zero and so one component; a null doc_id
gets its component's smallest id, null if there is none; repeated rows each give a row; an empty table an empty one;
other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, steps, table, tidy, utf8

BITS, TAU, SHINGLE, HOT, SEED = 64, 2, 3, 2048, 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()  # bytes: A-Z, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def _majorities(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes; counts: their lengths, of 1 at least."""
    lanes = np.uint64(0x0101010101010101)
    # Byte lanes hold at most 255, so runs are added up in pieces of 255.
    pieces = -(-counts // 255)
    owner = np.repeat(np.arange(len(counts)), pieces)
    cut = np.repeat(first, pieces) + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    heads = np.searchsorted(owner, np.arange(len(counts)))
    out = np.zeros(len(counts), np.uint64)
    for shift in range(8):
        added = np.add.reduceat((hashes >> np.uint64(shift)) & lanes, cut)
        set_bits = np.add.reduceat(added.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        over = (2 * set_bits > counts[:, None]).astype(np.uint64)
        for lane in range(8):
            out |= over[:, lane] << np.uint64(8 * lane + shift)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", 4 << 20):
        each = [_hashes(x, SHINGLE) for x in utf8(batch, "text")]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        out, some = np.zeros(len(each), np.uint64), np.flatnonzero(counts)
        if len(some):
            out[some] = _majorities(np.concatenate(each), np.cumsum(counts)[some] - counts[some], counts[some])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, more columns, fp) of every row; fp is the 64 bits as a signed long."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text"))
    return chosen.mapInArrow(tidy(_fingerprint), T.StructType([*chosen.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bits are set, alone and with each other, over one task's fingerprints."""
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        fp = np.asarray(batch.column(0)).view(np.uint64)
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        for a in range(0, len(bits), 1 << 16):
            total += bits[a : a + (1 << 16)].T @ bits[a : a + (1 << 16)]
        n += len(fp)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "total"])


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, of 64 by 64, how many have both bits set. A row a task comes to the driver."""
    n, total = 0, np.zeros((BITS, BITS))
    summed = nodes.select("fp").mapInArrow(tidy(_together), "n long, total array<double>")
    for row in summed.select("n", F.posexplode("total")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("v")).collect():
        n, total.flat[row["pos"]] = row["n"], row["v"]
    return n, total


def grouped_bits(n: int, total: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the bits; bits that are set together share one."""
    p = np.diag(total) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    alike = np.abs(total / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    left, out = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        rest = sorted(left)
        own = [max(rest, key=lambda b: (alike[b, rest].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            own.append(b := max(sorted(left), key=lambda b: (alike[b, own].sum(), -b)))
            left.remove(b)
        out.append(sorted(own))
    return out


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 that sum to tau - m + 1 at the least cost; costs[i][t + 1] is partition i's at t."""
    m = len(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, tau + 1):
                at = (cost + row[t + 1], [*chosen, t])
                if used + t + 1 not in following or at < following[used + t + 1]:
                    following[used + t + 1] = at
        best = following
    return best[tau + 1]  # the sum of t_i + 1


def plan(nodes: DataFrame, tau: int = TAU) -> tuple[list[list[int]], list[int]]:
    """Partitions of the bits and their thresholds at the least estimated number of candidates and probes."""
    n, total = bit_statistics(nodes)
    layouts = {m: grouped_bits(n, total, m) for m in range(1, tau + 3)}
    masks = [(m, i, _mask(bits)) for m, groups in layouts.items() if m > 1 for i, bits in enumerate(groups)]
    rows = nodes.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for m, i, x in masks])).alias("x")).select("x.*")
    counted = rows.groupBy("m", "i", "v").agg(F.count("*").alias("c")).groupBy("m", "i").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    pairs = {(r["m"], r["i"]): r["pairs"] for r in counted} | {(1, 0): 0.0}
    differ = 2 * np.diag(total) / max(n, 1) * (1 - np.diag(total) / max(n, 1))
    best = None
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            at = np.zeros(tau + 1)  # chances that a pair differs in 0, 1, ... bits, were bits independent
            at[0] = 1
            for b in bits:
                at[1:] = at[1:] * (1 - differ[b]) + at[:-1] * differ[b]
                at[0] *= 1 - differ[b]
            found = max(pairs.get((m, i), 0.0), n * (n - 1) / 2 * at[0])
            probes = np.cumsum([1.0, *np.cumprod([(len(bits) - j) / (j + 1) for j in range(tau)])])
            costs.append([0.0, *(found * at.cumsum() / max(at[0], 1e-12) + n * probes * 4)])
        got = allocate(costs, tau)
        if best is None or got[0] < best[0]:
            best = (*got, groups)
    return best[2], best[1]


def _flips(bits: list[int], radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in chosen)) for r in range(radius + 1) for chosen in itertools.combinations(bits, r)]


def _masks(bits: list[int], radius: int) -> Column:
    """The flips as one constant array, which no generated code spells out."""
    return F.split(F.lit(",".join(map(str, _flips(bits, radius)))), ",").cast("array<long>")


def _within(a: Column, b: Column, mask: int, t: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask))) <= t


def links(nodes: DataFrame, tau: int = TAU, hot: int = HOT, groups: list[list[int]] | None = None, thresholds: list[int] | None = None) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints of nodes (fp) at tau or fewer differing bits, each pair once or twice."""
    if groups is None or thresholds is None:
        groups, thresholds = plan(nodes, tau)
    used = [(i, _mask(bits), bits, t) for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]

    def keyed(name: str, radius: bool) -> DataFrame:
        def of(i: int, mask: int, bits: list[int], t: int) -> Column:
            return F.transform(_masks(bits, t if radius else 0), lambda flip: F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(flip).alias("v")))

        return nodes.select(F.col("fp").alias(name), F.explode(F.concat(*[of(*u) for u in used])).alias("x")).select(name, "x.i", "x.v")

    index = keyed("b", False)
    crowded = materialise(index.groupBy("i", "v").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("i", "v"), "crowded")
    probe, some = keyed("a", True), not crowded.isEmpty()
    if some:
        index = index.join(crowded, ["i", "v"], "left_anti")
    x, y = probe.alias("x"), index.alias("y")
    a, b = F.col("x.a"), F.col("y.b")
    earlier = F.lit(False)
    for i, mask, _, t in used:  # a pair is taken where it is found first
        earlier = earlier | ((F.col("x.i") > i) & _within(a, b, mask, t))
    met = (F.col("x.i") == F.col("y.i")) & (F.col("x.v") == F.col("y.v")) & (a != b) & (F.bit_count(a.bitwiseXOR(b)) <= tau)
    if not some:
        return x.join(y, met & (a < b) & ~earlier).select(a.alias("a"), b.alias("b"))
    cold = x.join(y, met).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    dense = keyed("b", False).join(crowded, ["i", "v"], "left_semi").select("b").distinct()
    near = dense.select("b", F.explode(F.transform(_masks(list(range(BITS)), tau), lambda flip: F.col("b").bitwiseXOR(flip))).alias("a")).where("a <> b")
    found = near.join(nodes.select(F.col("fp").alias("a")), "a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return cold.union(found).distinct()


def least_labels(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex of v's component, for every vertex of edges (a, b)."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    now = materialise(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("v"), F.least("a", "l").alias("root"), F.lit(True).alias("moved")), "labels")
    while True:
        old = now.select("v", "root")
        reached = both.join(old, both["b"] == old["v"]).groupBy("a").agg(F.min("root").alias("l"))
        met = old.join(reached, old["v"] == reached["a"]).select("v", "root", F.least("root", "l").alias("next"))
        up = met.select(F.col("v").alias("w"), F.col("next").alias("up"))
        after = materialise(met.join(up, met["next"] == up["w"]).select("v", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "labels")
        discard(now)
        now = after
        if now.where("moved").isEmpty():
            discard(both)
            return now.select("v", "root")


def components(docs: DataFrame, *more: Column, tau: int = TAU, hot: int = HOT) -> DataFrame:
    """doc_id, more columns, fp, root (a fingerprint of the component, one for each) and component_id (smallest doc_id reachable) of every row of docs."""
    each = materialise(fingerprints(docs, *more), "fingerprints")
    nodes = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = least_labels(links(nodes, tau, hot))
    placed = nodes.join(roots, nodes["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(placed.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, tau: int = TAU, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row of docs."""
    return components(docs, tau=tau, hot=hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
