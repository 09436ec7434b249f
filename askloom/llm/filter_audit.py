"""Filter interaction audit by long-form window evaluation, with DataFrame operations only.

Every document gets a mask with a bit for each filter that it fails. Documents are counted by part (source) and mask, so
at most 32 cells a part are left, whatever the table's size. The cells are unpivoted against the steps of all 120 orders
of the five filters; a running bit-or window over the steps of a cell and an order says what the cell has failed before;
conditional sums over the cells give the metrics of a step, and a window over all orders of a filter its total.

Four filters look at one text. The fifth, identical to the text of a smaller doc_id, goes by the texts' SHA-256: copies
are counted by digest, part and id, with partial counts before each shuffle, so a text that a third of all rows share is
no hot key, and no text is shuffled.

Defined results: doc_ids are whole numbers or null; a null text is empty and a null source the part ''; an empty text fails A (no words) and none of B, C
and D; rows without a doc_id have no smaller id and are none, and have no labels; rows that share a doc_id are documents
of their own, not copies of each other; a document counts as good (toxic) if any of its labels says so, null labels don't;
an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

FILTERS = "ABCDE"
_BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
_SUMS = ("n", "good", "toxic")
_BREAK = r"[\x20\x09-\x0D]+"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text, with its words, fails each of the filters that look at nothing else."""
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and mask (without the filter for copies) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = whole.select("*", F.array_remove(F.split("text", _BREAK), "").alias("words"))
    failed = text_failures(F.col("text"), F.col("words"))
    mask = sum((F.when(c, F.lit(_BIT[letter])).otherwise(F.lit(0)) for letter, c in failed.items()), F.lit(0))
    return split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def _marks(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max((F.col(c) == 1).cast("long")).alias(as_) for c, as_ in (("quality", "good"), ("toxic", "toxic"))])


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and how many documents (n), good ones and toxic ones there are with it."""
    rows, one = _masked(docs), F.count("*").alias("n")
    named = rows.where("doc_id is not null").join(_marks(labels), "doc_id", "left")
    each = named.groupBy("doc_id", "digest", "part", "mask").agg(one, F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    each = each.select("doc_id", "digest", "part", "mask", "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])
    copies = each.groupBy("digest", "part", "mask").agg(F.min("doc_id").alias("least"), F.min_by(F.struct(*_SUMS), "doc_id").alias("first"), *[F.sum(c).alias(c) for c in _SUMS])
    own = F.col("least") == F.min("least").over(Window.partitionBy("digest"))  # a row for each part that has the text
    placed = copies.select("part", "mask", *_SUMS, F.when(own, F.col("first")).otherwise(F.struct(*[F.lit(0).cast("long").alias(c) for c in _SUMS])).alias("first"))
    kinds = [F.struct(F.col("mask"), *[F.col("first")[c].alias(c) for c in _SUMS]), F.struct((F.col("mask") + _BIT["E"]).alias("mask"), *[(F.col(c) - F.col("first")[c]).alias(c) for c in _SUMS])]
    cells = placed.select("part", F.explode(F.array(*kinds)).alias("cell")).select("part", "cell.*")
    unnamed = rows.where("doc_id is null").groupBy("part", "mask").agg(one).select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return cells.unionByName(unnamed).where("n > 0").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in _SUMS])


def audit(cells: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, of cells (part, mask, n, good, toxic)."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("place", "filter"))
    long = steps.select("part", "mask", *_SUMS, "filter_order", (F.col("place") + 1).alias("step"), "filter", F.expr("shiftleft(1, ascii(filter) - 65)").alias("bit"))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = long.withColumn("gone", F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(before), F.lit(0)) != 0).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")) != 0)
    gone, fails = F.col("gone"), F.col("fails")

    def total(c: str, when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col(c)).otherwise(F.lit(0))).cast("long").alias(name)

    metrics = seen.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", ~gone & ~fails, "kept"), total("n", ~gone & fails, "removed"), total("n", gone & fails, "redundant"), total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", ~gone & fails, "good_lost"), total("toxic", ~gone & fails, "toxic_lost"),
    )
    return metrics.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    return audit(mask_cells(docs, labels))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE orders(o) AS (
  SELECT '' UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o, k, substr(o, k, 1) AS f, substr(o, 1, k - 1) AS earlier FROM (SELECT o, unnest(range(1, 6)) AS k FROM orders WHERE length(o) = 5)
), split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), said AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failed AS (
  SELECT part, CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN s.doc_id > min(s.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM split s LEFT JOIN said USING (doc_id)
), each AS (
  SELECT part, o, k, f, contains(fails, f) AS now, len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone, fails, good, toxic FROM failed, steps
), metrics AS (
  SELECT part, o AS filter_order, k::INT AS step, f, count(*) FILTER (NOT gone AND NOT now) AS kept, count(*) FILTER (NOT gone AND now) AS removed, count(*) FILTER (gone AND now) AS redundant,
    count(*) FILTER (fails = f) AS unique_fails, count(*) FILTER (NOT gone AND now AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND now AND toxic = 1) AS toxic_lost
  FROM each GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM metrics
"""
