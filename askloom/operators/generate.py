"""Chunks to model replies to pairs.

The model is called once for each chunk. Prompts are written to shared storage first; a stream reads their files up to the
end, and its checkpoint is the ledger of the run: a micro-batch that is done is never read again. Within a batch a task asks
at most `calls_a_task` prompts and its replies are committed when it ends, whatever becomes of the other tasks. So a run
that died goes on with the batch that it was in, and asks what that batch's committed files lack: it pays again for the
calls of the tasks that were under way, at most. A call that fails becomes a row with an error; a call that the client did
not make (`NotAsked`: no quota, no server) leaves its chunk open: the run goes on with all the others and ends with
`Unfinished`. What is open then becomes the prompts of a round of its own, which the next run asks.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.replies import PAIRS, parse_pairs
from ..functions.scores import tokens_per_second
from ..functions.text import render_prompt
from ..sources.storage import exists, folder, remove, scratch_path
from .clients import Client, NotAsked

PROMPT = """Write {num_pairs} question-answer pairs about the excerpt below.
Use only facts that the excerpt states. Number them and keep to this form, with nothing before or after:
Q1: a question
A1: its answer
Q2: the next question
A2: its answer
---
{chunk}"""
_REPLY = "content string, error string, latency_seconds double, prompt_tokens int, completion_tokens int"


#: Calls in a batch at most, where the cluster's own size keeps the calls at once within max_workers.
CALLS_A_BATCH = 1_000_000


class Unfinished(RuntimeError):
    """Some chunks are still open; the same call with the same path asks them."""


def _answered(client: Client, prompt: str | None) -> tuple | None:
    try:
        got = client.complete(prompt or "")
        return got.content, None, float(got.latency_seconds), int(got.prompt_tokens), int(got.completion_tokens)
    except NotAsked:
        return None
    except Exception as error:  # whatever fails, the chunk is counted
        return None, str(error) or type(error).__name__, 0.0, 0, 0


def _asking(client: Client, threads: int, kind: pa.Schema):
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            ask = pool.map if threads > 1 else map
            for batch in batches:
                got = list(ask(lambda p: _answered(client, p), batch.column("prompt").to_pylist()))
                made = batch.filter(pa.array([r is not None for r in got], pa.bool_()))
                said = list(zip(*(r for r in got if r is not None), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(made.column(c) for c in ("call", "doc_id", "chunk_index")), *(pa.array(x, kind.field(i + 3).type) for i, x in enumerate(said))], schema=kind)

    return call


def shared_out(spark: SparkSession, max_workers: int, threads: int, calls_a_task: int) -> tuple[int, int | None]:
    """How many calls a batch has, and how many tasks; None for as many as calls_a_task asks for.

    Where a session has no more slots for tasks than max_workers allows, the slots are the limit and a batch may be long.
    Else a batch is no wider than max_workers, and short, unless tasks can take more cores each (`narrowed`).
    """
    lanes, slots = max(1, max_workers // threads), spark.sparkContext.defaultParallelism
    growing = spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true"
    return (CALLS_A_BATCH, None) if slots <= lanes and not growing else (lanes * calls_a_task, lanes)


def cores_a_call(slots: int, executors: int, lanes: int) -> int | None:
    """The fewest cores that a task must take so that no more than lanes tasks run at once; None if no number does."""
    each, room = slots // max(executors, 1), lanes // max(executors, 1)
    return each // (room + 1) + 1 if executors and slots % executors == 0 and room else None


def narrowed(spark: SparkSession, max_workers: int, threads: int) -> ResourceProfile | None:
    """A profile for tasks of so many cores that a long batch keeps within max_workers; None where the cluster has none for tasks alone, or grows."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    cores = cores_a_call(sc.defaultParallelism, sc._jsc.sc().getExecutorMemoryStatus().size() - 1, max(1, max_workers // threads))
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build if cores else None


def _written_prompts(rows: DataFrame, path: str, calls_a_file: int) -> DataFrame:
    """rows (call, doc_id, chunk_index, prompt), written if they are not yet."""
    spark = rows.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        rows.write.mode("overwrite").option("maxRecordsPerFile", calls_a_file).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def replies(chunks: DataFrame, client: Client, num_pairs: int = 5, prompt: str = PROMPT, max_workers: int = 4, threads: int = 1, path: str | None = None, calls_a_task: int = 500) -> DataFrame:
    """doc_id, chunk_index and reply of each of chunks (doc_id, chunk_index, chunk), read back from shared storage.

    path: a folder that keeps the run. A run that ended early goes on there with the prompts that it began with, so a
    folder belongs to one input and one prompt; another prompt or number of pairs is a run of its own. At most max_workers
    calls run at once: tasks times threads.
    """
    if max_workers < 1 or threads < 1 or calls_a_task < 1:
        raise ValueError("max_workers, threads and calls_a_task must be positive")
    spark = chunks.sparkSession
    run = f"{path}/{hashlib.md5(json.dumps([prompt, num_pairs]).encode()).hexdigest()}" if path else scratch_path(spark, "calls")
    size, tasks = shared_out(spark, max_workers, threads, calls_a_task)
    profile = narrowed(spark, max_workers, threads) if tasks else None
    if profile:  # as many short tasks as there are calls, of which few enough run at once
        size, tasks = CALLS_A_BATCH, None
    text = render_prompt(prompt, chunk=F.col("chunk"), num_pairs=F.lit(num_pairs))
    rows = chunks.select(F.monotonically_increasing_id().alias("call"), "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), text.alias("prompt"))
    schema = f"call long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, chunk_index int, {_REPLY}"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def place(part: str, k: int) -> str:
        return f"{run}/{part}{k or ''}"

    def said(*rounds: int) -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[folder(spark, place("replies", k)) for k in rounds])

    def ask(asked: DataFrame, n: int, k: int) -> bool:
        """Whether anything was left to do."""
        files, begun = max(1, len(asked.inputFiles())), False
        each = max(1, min(files, size * files // max(n, 1)))

        def answer(batch: DataFrame, j: int) -> None:
            nonlocal begun
            begun = True
            own = f"{place('replies', k)}/batch={j}"
            if exists(spark, own):  # of a run that ended within this batch
                batch = batch.join(batch.sparkSession.read.schema(schema).parquet(own).select("call"), "call", "left_anti")
            wide = tasks or max(1, -(-batch.count() // calls_a_task))  # the last batch may be short
            answered = batch.repartition(wide, "call").mapInArrow(_asking(client, threads, kind), schema, profile=profile)
            # Version 2 commits each task's file when the task ends.
            answered.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(own)

        if path or each < files:
            stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", each).parquet(place("prompts", k))
            stream.writeStream.trigger(availableNow=True).option("checkpointLocation", place("progress", k)).foreachBatch(answer).start().awaitTermination()
        else:  # one batch, and nothing that could go on with it
            answer(asked, 0)
        return begun

    last = next(k for k in itertools.count() if not exists(spark, f"{place('prompts', k + 1)}/_SUCCESS"))
    while True:
        asked = rows = _written_prompts(rows, place("prompts", last), min(size, 50 * calls_a_task))
        n = asked.count()  # from the files' footers, as are the replies
        begun = ask(asked, n, last)
        left = n - said(last).count()
        if left and path:  # the next round
            rows = asked.join(said(last).select("call"), "call", "left_anti").select(asked.columns)
            _written_prompts(rows, place("prompts", last + 1), min(size, 50 * calls_a_task))
        if left and begun:
            raise Unfinished(f"{left} chunks were not asked" + (f"; a run with the path {path} asks them" if path else ""))
        if not left:
            break
        last += 1
    if not path:
        remove(spark, f"{run}/prompts")
    return said(*range(last + 1)).drop("call")


def results(answered: DataFrame) -> DataFrame:
    """Replies with their pairs, parsed by column expressions; a failed call has none."""
    pairs = F.when(F.col("error").isNull(), parse_pairs("content")).otherwise(F.array().cast(PAIRS))
    return answered.select("doc_id", "chunk_index", pairs.alias("pairs"), "error", "latency_seconds", tokens_per_second("completion_tokens", "latency_seconds").alias("tokens_per_second"), "prompt_tokens", "completion_tokens")


def flat_pairs(found: DataFrame) -> DataFrame:
    """doc_id, chunk_index, pair_index, question and answer of each pair."""
    each = F.coalesce("pairs", F.array().cast(PAIRS))  # of a plain column Spark would infer filters that parse again
    return found.select("doc_id", "chunk_index", F.posexplode(each).alias("pair_index", "pair")).select("doc_id", "chunk_index", "pair_index", "pair.question", "pair.answer")
