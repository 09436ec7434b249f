"""Hard negatives against brute force: near and far vectors, ties, repeated rows, passes and brackets."""

import math
import random

import numpy as np
import pytest
from askloom.llm import hard_negatives as hn
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<double>, score int, slot string"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    good = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in good:
        if not anchor(i):
            continue
        met = [(-sum(a * b for a, b in zip(v, w)), j, other == lab) for j, other, w in good if j != i]
        for s, j, _ in sorted(x for x in met if x[2])[:positives]:
            near = sorted(x for x in met if not x[2] and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(near[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=10, **more):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(table, F.col("vec_id") % every == 0, **more).collect())


def clustered(seed, n, dim=8, spread=0.1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, rng.randint(0, 3), [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("seed,spread", [(1, 0.05), (2, 1.0)])
def test_mining_equals_brute_force(spark, seed, spread):
    rows = clustered(seed, 400, spread=spread)
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_ties_repeated_and_odd_rows(spark):
    rows = [(i, i % 2, [float(i % 3), 1.0]) for i in range(60)] + [(i, i % 2, [1.0, 1.0]) for i in (10, 20, 20, 21)]
    rows += [(100, None, [1.0, 1.0]), (101, 1, None), (102, 1, [1.0, None]), (103, 0, [math.nan, 1.0]), (104, 0, [math.inf, 1.0]), (None, 1, [1.0, 1.0]), (110, 1, []), (111, 0, [2.0]), (120, 1, [1.0, 1.0, 0.5])]
    want = brute([(i, lab, v and [x for x in v] + [0.0] * (3 - len(v)) if v is not None else v) for i, lab, v in rows], lambda i: i % 10 == 0)
    assert mined(spark, rows) == want


def test_several_passes_equal_one(spark):
    rows = clustered(5, 300)
    want = brute(rows, lambda i: i % 3 == 0)
    assert mined(spark, rows, 3, block_bytes=3000) == want == mined(spark, rows, 3, pivots=2, pivot_sample=5)


def test_wide_numbers(spark):
    rows = [(i, i % 2, [x * 3000 for x in v]) for i, _, v in clustered(6, 80)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    huge = [(i, i % 2, [x * 300_000 for x in v]) for i, _, v in clustered(6, 80)]
    assert hn.exact_kind(1 << 54) is np.int64 and mined(spark, [(i, lab, [x / 8 for x in v]) for i, lab, v in huge]) == brute([(i, lab, [x / 8 for x in v]) for i, lab, v in huge], lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="64-bit"):
        mined(spark, [(0, 1, [1e300]), (1, 1, [1.0])])


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(10, 1, [1.0])]) == []


def test_brackets_hold_every_score_and_spare_far_pairs():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 200
    x = np.floor(centres[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 16)) * 5).astype(np.int64)
    norms = (x * x).sum(axis=1)
    most = int(norms.max())
    lifted = hn.lifted(x, norms, most)
    pivots = hn.farthest(lifted[:200], 16)
    a = x[:50]
    q = hn.Wanted(np.arange(50), np.zeros(50), a, norms[:50], hn.distances(np.column_stack([a, np.zeros(50)]), pivots), most, None, None, 1, True)
    away, scores = hn.distances(lifted, pivots), a @ x.T
    for low in (-hn.NONE, 0, most // 2):
        for high in (hn.NONE, most // 2, most // 3):
            alive = hn.survivors(q, np.arange(50), away, np.full(50, low), np.full(50, high))
            assert alive[(scores >= low) & (scores <= high)].all()
    best = np.sort(scores, axis=1)[:, -20]
    spared = ~hn.survivors(q, np.arange(50), away, best, np.full(50, hn.NONE))
    assert spared.mean() > 0.1  # of vectors in groups; of independent ones pivots spare next to nothing
