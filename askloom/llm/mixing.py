"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

Source s with weight w_s (as a share of all weights of the sources present) and n_s rows gets the rate
w_s * target / n_s. Each row's count is the rate's Poisson distribution inverted at a uniform number from a hash of
seed and row: the smallest k whose cumulative probability reaches it. Rows are exploded by their counts and sorted
globally by a hash of seed, row and copy, which is uniform, so neither a hot source nor a large count meets in one task.

A row goes by its doc_id where no other row has it. Rows without an id, and rows that share theirs, are grouped by all
their columns, maps and intervals in a form that can be compared, and each goes by a hash of them and its number among
the rows equal to it: only rows that are equal in every column are counted together, and the hash feeds the draw but
never chooses a row. Equal rows are counted before the shuffle and dealt out again in pieces, so any number of them is no
hot key. Ids that are shared are found by a count of the ids alone, and are joined to the rows only if there are any.

Cumulative probabilities are held for each source only; weights and sources are joined by broadcast if they are few
enough (`broadcast_sources`, a checked bound) and by a plain join beyond that.

Defined results: a null source is a source of its own; sources without a weight get `default_weight`; a weight of zero
drops the source; every row has a draw of its own, equal rows too (maps are equal whatever their order, 0.0 equals
-0.0 and NaN equals NaN, as in SQL); an empty table gives an empty table; all columns
are kept, and the columns added (copy, n_copies, position) go by these names unless the table has them, and then by
the name with underscores after it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import comparable, materialise, partitions, table

SEED, BROADCAST_SOURCES, PIECE = 17, 10_000, 10_000
#: Production weights: the largest source counts twice, two count less, the others are alike.
WEIGHTS, DEFAULT_WEIGHT = {"src0": 2.0, "src7": 0.25, "src9": 0.5}, 1.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the parts' MD5; null counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def poisson_steps(rates: DataFrame) -> DataFrame:
    """name and steps, the cumulative Poisson probabilities of 0, 1, ... as far as 52-bit uniforms can tell, of (name, rate) with rates above 0."""
    most = (F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    each = rates.select("name", "rate", F.explode(F.sequence(F.lit(0), most)).alias("k"))
    so_far = Window.partitionBy("name").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = each.withColumn("term", F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.ln(F.col("rate") / F.col("k")))).over(so_far))
    totals = terms.withColumn("total", F.sum(F.exp("term")).over(so_far))
    return totals.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "total"))), lambda x: x["total"]).alias("steps"))


def told_apart(docs: DataFrame, key: str) -> DataFrame:
    """row (all columns of docs) and key: the id of each row that has one of its own, else a hash of its columns and its number among equal rows."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("string").alias("key"))
    shared = docs.select(F.col(key).cast("string").alias("shared")).groupBy("shared").agg(F.count("*").alias("n")).where("n > 1 or shared is null").select("shared")
    if shared.isEmpty():
        return rows
    marked = rows.join(shared.where("shared is not null"), F.col("key") == F.col("shared"), "left")
    loose = F.col("key").isNull() | F.col("shared").isNotNull()
    content = [comparable(F.col("row")[f.name], f.dataType).alias(f"c{i}") for i, f in enumerate(docs.schema.fields)]
    equal = marked.where(loose).select("row", *content).groupBy(*[f"c{i}" for i in range(len(content))]).agg(F.any_value("row").alias("row"), F.count("*").alias("n"))
    hashed = equal.select("row", F.concat_ws(" ", F.lit("row"), F.xxhash64(F.lit(0), *[f"c{i}" for i in range(len(content))]).cast("string")).alias("digest"), "n")
    pieces = hashed.select("row", "digest", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PIECE))).alias("first")).repartition(partitions(docs), "digest", "first")
    numbers = pieces.select("row", "digest", F.explode(F.sequence("first", F.least(F.col("first") + PIECE, F.col("n")) - 1)).alias("number"))
    return marked.where(~loose).select("row", "key").union(numbers.select("row", F.concat_ws("#", "digest", "number")))


def free_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def mix(docs: DataFrame, weights: dict[str | None, float], default_weight: float = DEFAULT_WEIGHT, target: int | None = None, seed: int = SEED, key: str = "doc_id", source: str = "source", broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The rows of docs, each as often as it is drawn, in global random order; target: rows to expect (default: as many as docs has)."""
    if default_weight < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    name, kept = F.col("s.name"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    counts = docs.groupBy(F.col(source).alias("name")).agg(F.count("*").alias("n"))
    named = {str(k): float(w) for k, w in weights.items() if k is not None}
    own = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(named)), "map<string,double>")).alias("of", "own"))
    own = F.broadcast(own) if len(named) <= broadcast_sources else own
    weight = F.when(F.col("name").isNull(), float(weights.get(None, default_weight))).otherwise(F.coalesce("own", F.lit(float(default_weight))))
    shares = materialise(counts.join(own, F.col("name").cast("string") == F.col("of"), "left").select("name", "n", weight.alias("weight")), "shares")
    total = shares.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"), F.count("*").alias("sources")).first()
    if not total["all_weight"]:
        return _named(docs.select(kept.alias("row")).where(F.lit(False)).select("row", F.lit(0).alias("copy"), F.lit(0).alias("n_copies"), F.lit(0.0).alias("position")), docs)
    rate = F.col("weight") / F.lit(total["all_weight"]) * F.lit(float(total["all_n"] if target is None else target)) / F.col("n")
    steps = poisson_steps(shares.where("weight > 0").select("name", rate.alias("rate"))).alias("s")
    if total["sources"] <= broadcast_sources:
        steps = F.broadcast(steps)
    rows = told_apart(docs, key).withColumn("of", F.col("row")[source]).join(steps, F.col("of").eqNullSafe(name))
    u = F.array(uniform(F.lit(seed), F.lit("count"), F.col("key")))  # bound once a row, not hashed again for each step
    drawn = rows.select("row", "key", F.transform(u, lambda x: F.size(F.filter("steps", lambda c: c < x)))[0].alias("n_copies")).where("n_copies > 0")
    copies = drawn.select("row", "key", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    placed = copies.select("row", "copy", "n_copies", uniform(F.lit(seed), F.lit("place"), F.col("key"), F.col("copy")).alias("position"))
    # Positions are uniform in (0, 1), so equal ranges of them are equal partitions; no sample is needed.
    parts = partitions(docs)
    dealt = placed.repartitionById(parts, F.least(F.floor(F.col("position") * parts), F.lit(parts - 1)).cast("int"))
    return _named(dealt.sortWithinPartitions("position"), docs)


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select("row.*", *[F.col(c).alias(free_name(docs, c)) for c in ("copy", "n_copies", "position")])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(docs, WEIGHTS).drop("position")


OP4_SQL = f"""
WITH RECURSIVE shares AS (
  SELECT source, count(*) AS n, CASE source {" ".join(f"WHEN '{name}' THEN {w}" for name, w in WEIGHTS.items())} ELSE {DEFAULT_WEIGHT} END::DOUBLE AS weight
  FROM documents GROUP BY source
), rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM shares) * (SELECT sum(n) FROM shares)::DOUBLE / n AS rate FROM shares WHERE weight > 0
), terms(source, rate, k, term, total) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term + ln(rate / (k + 1)), total + exp(term + ln(rate / (k + 1))) FROM terms WHERE k < rate + 12 * sqrt(rate) + 39
), drawn AS (
  SELECT *, (('0x' || substr(md5('{SEED}|count|' || doc_id), 1, 13))::BIGINT + 0.5)::DOUBLE / 4503599627370496 AS u FROM documents
), counted AS (
  SELECT d.doc_id, count(*) FILTER (t.total < d.u) AS n_copies FROM drawn d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INT AS copy, c.n_copies::INT AS n_copies
FROM documents d JOIN (SELECT doc_id, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM counted WHERE n_copies > 0) c USING (doc_id)
"""
