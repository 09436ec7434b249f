"""Keep first in document order on a stream, for several orders of arrival."""

import json
import os
import random

import pytest
from askloom.operators.pairs import deduplicate
from askloom.streaming import first

SCHEMA = "doc long, chunk int, question string, answer string, at timestamp"
KEY = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, first.PROVIDER)
    yield
    spark.conf.set(KEY, before)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_arrival_gives_the_batch_result(spark, tmp_path, rocks, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(9)]), i, rng.choice(["What?", " what?", "WHY?", None, ""]), f"answer {rng.randint(0, 6)}", f"2024-01-01T00:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}Z") for i in range(120)]
    want = deduplicate(spark.createDataFrame([r[:4] for r in rows], "doc long, chunk int, question string, answer string"), ["doc", "chunk"])
    (tmp_path / "in").mkdir()
    for k in range(6):
        part = rows[k * 20 : k * 20 + 20] if k < 5 else [*rows[100:], (None, -1, "end", "of it", "2025-01-01T00:00:00Z")]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("doc", "chunk", "question", "answer", "at"), r))) for r in part))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    arrivals = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    kept = first.stream_keep_first(arrivals, ["doc", "chunk"], "at", "2 hours")
    kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("at")
    a, b = set(map(repr, got.collect())), set(map(repr, want.collect()))
    assert a == b and got.count() == len(b) > 10


def test_another_state_store_is_refused(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        first.stream_keep_first(spark.createDataFrame([], SCHEMA), ["doc"], "at")


def arrived(spark, tmp_path, schema, batches, order, delay, **how):
    """What is kept of batches that come one after the other, and the query."""
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    kept = first.stream_keep_first(arrivals, order, "at", delay, **how)
    query = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(kept.schema).parquet(str(tmp_path / "out")).collect(), query


def one_by_one(batches, delay, wait):
    """Pair by pair: the first batch that has a pair says how long it waits; sent once, with what has come by then."""
    waits, sent, out, top = {}, set(), [], 0
    for rows in [*batches, []]:
        latest = {}
        for r in rows:
            key = (r["question"], r["answer"])
            latest[key] = max(latest.get(key, 0), r["s"])
        for r in rows:
            key = (r["question"], r["answer"])
            if key not in sent:
                until, best = waits.get(key, (latest[key] + wait, r))
                waits[key] = (until, min(best, r, key=lambda x: x["doc"]))
        for key in [k for k, (until, _) in waits.items() if until <= max(top - delay, 0)]:
            out.append(waits.pop(key)[1])
            sent.add(key)
        top = max([top, *(r["s"] for r in rows)])
    return out


@pytest.mark.parametrize("wait", [0, 900])
def test_pairs_of_a_bucket_wait_and_are_sent_one_by_one(spark, tmp_path, rocks, wait):
    rng, docs = random.Random(wait), iter(random.Random(5).sample(range(1000), 240))
    batches = [[{"doc": next(docs), "question": f"q{rng.randint(0, 8)}", "answer": f"a{rng.randint(0, 4)}", "s": k * 600 + rng.randint(0, 1200)} for _ in range(40)] for k in range(6)]
    said = [[{**r, "at": f"2024-01-01T{r['s'] // 3600:02}:{r['s'] // 60 % 60:02}:{r['s'] % 60:02}Z"} for r in rows] for rows in batches]
    start = 1_704_067_200  # of that day
    want = one_by_one([[{**r, "s": r["s"] + start} for r in rows] for rows in batches], 660, wait)
    got, query = arrived(spark, tmp_path, "doc long, question string, answer string, s long, at timestamp", said, ["doc"], "11 minutes", wait_seconds=wait, buckets=3)
    assert sorted((r["doc"], r["question"], r["answer"]) for r in got) == sorted((r["doc"], r["question"], r["answer"]) for r in want)
    assert 10 < len(got) <= 45


def test_state_is_kept_by_buckets(spark, tmp_path, rocks):
    """Timers, and so calls of state, are as many as buckets, however many pairs there are; values stay what they are."""
    rows = [{"_doc": None if i % 3 == 0 else 2**60 + i, "question": f"q{i}", "answer": "a", "n": i if i % 5 else None, "at": "2024-01-01T00:00:00Z"} for i in range(60)]
    got, query = arrived(spark, tmp_path, "_doc long, question string, answer string, n long, at timestamp", [rows, [{**rows[0], "question": "end", "at": "2025-01-01T00:00:00Z"}]], ["_doc"], "1 hour", buckets=4)
    assert {(r["_doc"], r["question"], r["n"]) for r in got} == {(r["_doc"], r["question"], r["n"]) for r in rows} and len(got) == 60
    assert {str(r["at"]) for r in got} == {"2024-01-01 00:00:00"}
    timers = [s["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(timers) <= 4
