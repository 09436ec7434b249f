"""The operators that use DataFrame functions only have no Python, no cartesian product and no limit in their plans."""

import re

import pytest
from askloom.llm import chat_format, filter_audit, mixing


@pytest.mark.parametrize("query", [mixing.op4_mix_sources, chat_format.op7_chat_format, filter_audit.op12_filter_audit])
def test_native(spark, sf_dir, query):
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin|GlobalLimit", plan)


def test_native_rows_without_an_own_id(spark):
    docs = spark.createDataFrame([(None, "t", "s"), (None, "t", "s"), (3, "u", "s"), (3, "v", None)], "doc_id long, text string, source string")
    assert not re.search("Python|Pandas|Arrow", mixing.mix(docs, {})._jdf.queryExecution().executedPlan().toString())
