"""The index of kept pairs over several runs and sessions."""

import re

from askloom.operators.seen import SeenPairs, pair_key
from pyspark.sql import functions as F

SCHEMA = "id long, question string, answer string"


def kept(index, rows, spark):
    return sorted(r["id"] for r in index.keep(spark.createDataFrame(rows, SCHEMA), ["id"]).collect())


def test_runs_keep_what_no_run_before_has_kept(spark, tmp_path):
    index = SeenPairs(spark, str(tmp_path / "index"), 4)
    assert kept(index, [(1, "What is it?", "A thing."), (2, " what IS  it?", "a thing."), (3, None, ""), (4, "", None)], spark) == [1, 3]
    assert kept(index, [(5, "What is it? ", "A THING."), (6, "What is it?", "Another."), (7, "What is it?", "another. ")], spark) == [6]
    index.forget()
    again = SeenPairs(spark, str(tmp_path / "index"), 4)  # as another session would
    assert kept(again, [(8, "what is it?", "another."), (9, "new", "pair"), (10, "a\n1\nb", "c"), (11, "a", "b\n1\nc")], spark) == [9, 10, 11]
    assert again.keys().count() == 6 and kept(again, [], spark) == []
    again.forget()


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = SeenPairs(spark, str(tmp_path / "index"), 4)
    pairs = spark.range(3000).selectExpr("id", "concat('q', id) question", "'a' answer")
    index.keep(pairs, ["id"])
    plan = index.unseen(pairs.where("id > 5"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    side = plan[plan.index("FileScan parquet") :] if "FileScan parquet" in plan else plan
    assert re.search(r"Bucketed: true", plan) and "Exchange" not in side.split("\n", 1)[0]
    index.forget()


def test_keys_tell_texts_apart(spark):
    rows = [("ab", "c"), ("a", "bc"), ("", "abc"), ("abc", ""), ("1\na", ""), ("", "1\na")]
    got = spark.createDataFrame(rows, "question string, answer string").select(pair_key().alias("k"))
    assert got.distinct().count() == 6 and got.where(F.length("k") == 32).count() == 6
