"""Datasets on shared storage: parts in order, two phases, nothing left of what failed."""

import json
import os

import pyarrow as pa
import pytest
from askloom import cli
from askloom.operators.clients import OfflineClient
from askloom.plans.run import run_pipeline
from askloom.sources import dataset, writers
from pyspark.sql import functions as F

SCHEMA = "k long, name string, tags array<string>"


def some(spark, n):
    return spark.range(n).selectExpr("id as k", "if(id % 5 = 0, null, concat('é \"', id, '\"\\n')) as name", "array('a', null, cast(id as string)) as tags").repartition(7)


@pytest.mark.parametrize("kind", ["jsonl", "json"])
def test_parts_follow_one_another_and_read_back(spark, tmp_path, kind):
    rows = some(spark, 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert dataset.write_dataset(rows, f"{tmp_path}/out", kind, ["k"]) == f"file:{tmp_path}/out"
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(os.listdir(tmp_path / "out"))
    parts = [n for n in names if n[0] == "p"]
    assert set(names) == {*parts, "_SUCCESS"} and len(parts) > 1
    texts = [(tmp_path / "out" / n).read_text() for n in parts]
    found = [r["k"] for t in texts for r in ([json.loads(x) for x in t.splitlines()] if kind == "jsonl" else json.loads(t))]
    assert found == list(range(500))
    listed = json.loads((tmp_path / "out" / "_SUCCESS").read_text())
    assert [x["part"] for x in listed] == parts and sum(x["rows"] for x in listed) == 500
    back = dataset.read_dataset(spark, f"{tmp_path}/out", kind, SCHEMA)
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0


def test_modes(spark, tmp_path):
    path = f"{tmp_path}/out/"
    for mode, want in (("overwrite", 20), ("append", 40), ("overwrite", 20)):
        dataset.write_dataset(some(spark, 20), path, "jsonl", ["k"], mode)
        assert dataset.read_dataset(spark, path, "jsonl", SCHEMA).count() == want
    dataset.write_dataset(some(spark, 0), path, "jsonl")
    assert os.listdir(path) == ["_SUCCESS"] and dataset.read_dataset(spark, path, "jsonl", SCHEMA).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        dataset.write_dataset(some(spark, 2), path, "xml")


def test_a_failed_job_leaves_no_file_and_keeps_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/out"
    dataset.write_dataset(some(spark, 20), path, "jsonl", ["k"])
    before = {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(path)}
    bad = some(spark, 300).withColumn("name", F.when(F.col("k") == 271, F.raise_error(F.lit("broken row"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="broken row"):
        dataset.write_dataset(bad, path, "jsonl")
    assert {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(path)} == before
    with pytest.raises(Exception, match="broken row"):
        dataset.write_dataset(bad, f"{tmp_path}/fresh", "json")
    assert [f for _, _, files in os.walk(tmp_path / "fresh") for f in files] == []


def test_a_task_that_fails_deletes_its_own_file(tmp_path, monkeypatch):
    class Task:
        partitionId, taskAttemptId = staticmethod(lambda: 3), staticmethod(lambda: 8)

    def broken():
        yield pa.RecordBatch.from_pylist([{"a": 1}])
        raise RuntimeError("lost")

    monkeypatch.setattr(dataset.TaskContext, "get", lambda: Task)
    writer = dataset.DatasetSource({"uri": f"file:{tmp_path}/out", "kind": "csv"}).writer(pa.schema([("a", pa.int64())]), True)
    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []
    writer.abort([None])
    assert not os.path.exists(writer.staged.removeprefix("file:"))


def test_a_run_with_a_uri_writes_no_local_path(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    docs = spark.createDataFrame([(i, f"Text {i}.") for i in range(30)], "doc_id long, text string")
    run = run_pipeline(spark, docs, OfflineClient(), f"file://{tmp_path}/shared/set.jsonl", question_key="Q", answer_key="A", save_metrics=True)
    assert run.output_path == f"file:{tmp_path}/shared/set.jsonl" and os.listdir(tmp_path) == ["shared"]
    got = spark.read.json(str(tmp_path / "shared" / "set.jsonl"))
    assert got.columns == ["A", "Q", "chunk_index"] and got.count() == 60
    assert spark.read.csv(str(tmp_path / "shared" / "set.metrics.csv"), header=True).columns == list(writers.METRICS)
    (tmp_path / "a.txt").write_text("A text about something. " * 9)
    assert cli.main(["generate", str(tmp_path / "a.txt"), "-o", f"file://{tmp_path}/shared/cli.json", "--mode", "test", "-n", "3"], spark) == 0
    assert spark.read.json(str(tmp_path / "shared" / "cli.json"), multiLine=True).count() == 3


def test_paths():
    assert writers.is_shared("s3://bucket/x.jsonl") and writers.is_shared("out/") and not writers.is_shared("out/x.jsonl")
    assert writers.metrics_path("s3://bucket/a.b/x.jsonl") == "s3://bucket/a.b/x.metrics.csv" and writers.metrics_path("s3://bucket/a.b/x/") == "s3://bucket/a.b/x.metrics.csv"
