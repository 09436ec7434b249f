"""Each stage of the pipeline, on its own input, against an independent loop over the rows of a small table."""

import hashlib
import math
import random

import corpus_pipeline
import pytest
from askloom.llm import mixing, quality
from test_operators import brute_components, brute_contamination, brute_fingerprint, brute_quality, brute_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seen timestamp"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    """The shorter of the documents, some of them again, near copies, and rows that share an id or have none."""
    rng = random.Random(2)
    found = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r["text"]) < 1500][:70]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in found]
    rows += [(1000 + i, rows[i][1].replace("e", "e", 1) + (" " if i % 2 else ""), "en", rng.choice(["src0", "src7", None]), None) for i in range(12)]
    rows += [(None, rows[3][1], "en", "src1", 3), (None, "a text of its own without an id", "en", "src1", 3), (rows[5][0], "another text under a known id", None, "src2", 9), (2000, None, None, None, None), (2001, "", None, "src0", 0)]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows += [(3000 + i, f"before it {items[i]} after it", "en", "src9", 5) for i in range(4)] + [(3100, "long " * 2000 + items[0], "en", "src9", 5)]
    return [(*r, None) for r in rows]


def staged(spark, sf_dir, name, rows, schema=SCHEMA):
    return [tuple(r) for r in STAGES[name](spark, spark.createDataFrame(rows, schema), sf_dir).collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_quality_stage(spark, sf_dir, sample):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality.fit(spark.createDataFrame(sample, SCHEMA), labels, metadata=quality.METADATA)

    def value(n):
        return None if n is None else str(math.floor(2 * math.log2(1 + abs(n)) + 0.5))

    scores = [brute_quality(machine, r[1], {"n_chars": value(r[4])}) for r in sample]
    assert all(abs(s - quality.THRESHOLD) > 1e-6 for s in scores) and any(s < quality.THRESHOLD for s in scores)
    same(staged(spark, sf_dir, "quality classifier", sample), [r for r, s in zip(sample, scores) if s >= quality.THRESHOLD])


def test_near_dedup_stage(spark, sf_dir, sample):
    fps = [brute_fingerprint(r[1]) for r in sample]
    numbers = list(range(len(sample)))
    roots = brute_components(fps, numbers, 2)
    want = []
    for root in set(roots):
        group = [sample[i] for i in numbers if roots[i] == root]
        least = min(group, key=lambda r: (r[0] is None, r[0] or 0))[0]
        want.append([r for r in group if r[0] == least])
    got = staged(spark, sf_dir, "SimHash near-dedup", sample)
    assert len(got) == len(want) < len(sample)
    assert all(sum(repr(g) in map(repr, options) for g in got) == 1 for options in want)


def test_near_dedup_stage_chooses_by_all_columns(spark, sf_dir):
    rows = [(4, "the same text for all of them", "en", s, n, None) for s in ("src9", "src2", None) for n in (7, 5, None)] * 3
    got = {tuple(STAGES["SimHash near-dedup"](spark, spark.createDataFrame(rows, SCHEMA).repartition(n), sf_dir).first()) for n in (1, 3, 7)}
    assert got == {(4, rows[0][1], "en", None, None, None)}


def test_decontamination_stage(spark, sf_dir, sample):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = brute_contamination([(i, r[1]) for i, r in enumerate(sample)], items)
    clean = {r[0] for r in judged if not r[5]}
    assert {len(sample) - 1} <= clean and not clean & set(range(len(sample) - 5, len(sample) - 1))
    same(staged(spark, sf_dir, "benchmark decontamination", sample), [r for i, r in enumerate(sample) if i in clean])


def test_mixing_stage(spark, sf_dir, sample):
    rows = [r for r in sample if r[0] is not None]
    ids = [r[0] for r in rows]
    rows = [r for r in rows if ids.count(r[0]) == 1]
    names = {r[3] for r in rows}
    weight = {s: mixing.DEFAULT_WEIGHT if s is None else mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in names}
    want = []
    for r in rows:
        rate = weight[r[3]] / sum(weight.values()) * len(rows) / sum(x[3] == r[3] for x in rows)
        u = (int(hashlib.md5(f"{mixing.SEED}|count|{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, term = 0, math.exp(-rate)
        total = term
        while total < u:
            n += 1
            term *= rate / n
            total += term
        want += [r] * n
    same(staged(spark, sf_dir, "mixing sources to target weights", rows), want)


def test_token_stage(spark, sf_dir, sample):
    ids = [r[0] for r in sample]
    rows = sorted((r for r in sample if r[0] is not None and ids.count(r[0]) == 1), key=lambda r: r[0])
    got = STAGES["token-ID / binary output"](spark, spark.createDataFrame(rows, SCHEMA), sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == brute_tokens([(r[0], r[1]) for r in rows])


def test_run_on_a_small_table_equals_the_stages_one_by_one(spark, sf_dir, sample, tmp_path):
    spark.createDataFrame(sample, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    same([tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()], [tuple(r) for r in docs.collect()])
