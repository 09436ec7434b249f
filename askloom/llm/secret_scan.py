r"""Secret scan with an incremental ledger of blobs.

Every version of a path is addressed by its content, the SHA-256 of its text. The ledger, a Parquet folder on shared
storage, says of each blob which rules it was scanned with, each in which version, and what was found. A run works out the
pairs of blob and rule version that the ledger lacks, scans those blobs with those rules only, appends one row a blob, and
joins the findings of the present rule versions back to all paths that hold the blob. So a second run scans nothing, a new
version of a file costs one scan, and a changed rule is run over old blobs without the others.

A blob is scanned in one of the rows that hold it. Texts without any of the rules' fixed parts can't match; they are told
by one regular expression while the texts are addressed, and enter the ledger without being moved. Only the others are
shuffled, once. Ledger rows are whole in themselves, so a run that dies while they are committed leaves work that the next
one need not repeat, and two runs at once agree. Findings go back to the paths through SALTS copies a blob, so a blob that
very many paths share is no hot key; there are no findings for the rest, and so no copies.

Rules: the three of the contract, then credentials in URLs, headers of private keys and the tokens of three services. A rule
is matched from left to right, without overlap; matches shorter than `least` are dropped afterwards, and are not tried
again from within. Offsets count code points.

Defined results: a null text is an empty blob; rows that share a path, with or without a text, are versions of their own
and keep a row each; a null path is a path; an empty table gives an empty table; other columns are ignored, whatever their
names. A ledger has no end: it keeps findings of old rule versions, which are not reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import folder, scratch_path
from .common import discard, materialise, steps, table, tidy


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if its group has so many characters.
    least: int
    group: int
    #: What any match holds, for Java.
    screen: str
    version: int = 1
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either(words: str) -> str:
    """words in either case of the ASCII letters, for engines with other ideas of case."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


_KEYWORDS = "password|passwd|secret|token|api_?key"
#: What secrets look like.
RULES = (
    Rule("assign", rf"""({_either(_KEYWORDS)})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, f"(?i:{_KEYWORDS})", base=True),
    Rule("access", "AKIA[A-Z0-9]+", 16, 0, "AKIA", base=True),
    Rule("hex", "[0-9a-f]+", 32, 0, "[0-9a-f]{32}", base=True),
    Rule("url", r"://[^\x00-\x20@/:]+:[^\x00-\x20@/:]+@", 0, 0, r"://[^\x00-\x20@/:]+:[^\x00-\x20@/:]+@"),
    Rule("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40, 0, "gh[pousr]_"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15, 0, "xox[abprs]-"),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39, 0, "AIza"),
)
SALTS = 16
_FINDINGS = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob binary, rules array<string>, findings {_FINDINGS}"


def matches(text: str, rule: Rule) -> list[tuple[int, int]]:
    """The spans of one rule."""
    pattern = rule.pattern
    if rule.kind == "hex":  # runs are maximal, so the short ones need not be matched to be dropped
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    return [m.span() for m in re.finditer(pattern, text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanned(rules: tuple[Rule, ...]):
    """Ledger rows of (blob, pending, text): a blob's pending rules and what they find."""
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            rows = {}
            for blob, pending, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if blob not in rows:
                    rows[blob] = pending, [{"rule": n, "start": a, "end": b} for n in pending for a, b in matches(text, by_name[n])]
            pending, found = zip(*rows.values(), strict=True)
            kinds = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(pending, pa.list_(pa.string())), pa.array(found, kinds)], names=["blob", "rules", "findings"])

    return run


def addressed(versions: DataFrame, paths: list[str], text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """path (a struct of the columns of paths), blob, suspect (whether any rule can match) and text of every row."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    suspect = body.rlike("|".join(r.screen for r in rules)) if rules else F.lit(False)
    return versions.select(F.struct(*[F.col(f"`{c}`") for c in paths]).alias("path"), F.unhex(F.sha2(body, 256)).alias("blob"), suspect.alias("suspect"), body.alias("text"))


def scan_unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, paths: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Append the blobs of versions to the ledger, each scanned with the rules that it lacks; path and blob of every row."""
    spark = versions.sparkSession
    rows = addressed(versions, list(paths), text, rules)
    held = materialise(rows.drop("text"), "addresses")
    done = spark.read.schema(LEDGER).parquet(folder(spark, ledger)).groupBy(F.col("blob").alias("of")).agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    blobs = held.groupBy("blob", "suspect").agg(F.min("path").alias("at")).join(done, F.col("blob") == F.col("of"), "left")
    lacking = F.array_except(F.array(*[F.lit(r.name) for r in rules]).cast("array<string>"), F.coalesce("done", F.array().cast("array<string>")))
    unseen = materialise(blobs.select("blob", "suspect", "at", lacking.alias("pending")).where(F.size("pending") > 0), "unseen")
    clear = unseen.where("not suspect").select("blob", F.col("pending").alias("rules"), F.array().cast(_FINDINGS).alias("findings"))
    # One of the rows with the blob; of rows equal in path and text each task scans one a batch.
    chosen = unseen.where("suspect").select(F.col("blob").alias("of"), "at", "pending").hint("shuffle_hash")
    moved = rows.where("suspect").join(chosen, (F.col("blob") == F.col("of")) & F.col("path").eqNullSafe(F.col("at"))).select("blob", "pending", "text")
    moved.mapInArrow(tidy(_scanned(rules)), LEDGER).unionByName(clear).write.mode("append").option("compression", "zstd").parquet(ledger)
    discard(unseen)
    return held.drop("suspect")


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans, an array of (start, place of its rule, end, kind) in that order, of the blobs in which the rules have found anything."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.kind))])
    present = F.filter("findings", lambda x: x["rule"].isin(*[r.name for r in rules]))
    own = spark.read.schema(LEDGER).parquet(ledger).select("blob", present.alias("found")).where(F.size("found") > 0)
    spans = F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct(x["start"].alias("start"), order[x["rule"]].alias("place"), x["end"].alias("end"), kind[x["rule"]].alias("kind")))
    return own.groupBy("blob").agg(F.array_sort(F.array_distinct(spans)).alias("spans"))


def joined_back(held: DataFrame, found: DataFrame) -> DataFrame:
    """path, blob and spans of every row of held; a blob's findings lie once for each of SALTS parts of its paths."""
    salted = found.select(F.col("blob").alias("of"), "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    own = held.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return own.join(salted, (F.col("blob") == F.col("of")) & (F.col("salt") == F.col("part")), "left").select("path", "blob", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def secret_scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, paths: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of paths, blob and spans (start, end and kind, in order) of every row of versions, scanned as far as the ledger lacks it."""
    held = scan_unseen(versions, ledger, rules, paths, text)
    return joined_back(held, findings(versions.sparkSession, ledger, rules)).select("path.*", "blob", "spans")


def _of(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a ledger of its own, so every text is unseen."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = secret_scan(docs, scratch_path(spark, "ledger"))
    base = [r.kind for r in RULES if r.base]
    counts = [F.size(_of("spans", kind)).cast("long").alias(f"n_{kind}") for kind in base]
    digest = F.sha2(_listed(_of("spans", *base)), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    parts = []
    for place, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, {rule.base} AS base, first, first + length(m[i]) AS last FROM (
  SELECT *, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS first
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS p FROM docs))
) WHERE length(g[i]) >= {rule.least}""")
    both = "\nUNION ALL ".join(parts)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({both}),
each AS (SELECT *, kind || ':' || first || ':' || last AS said FROM found),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(said, ',' ORDER BY first, place) FILTER (base) AS own, string_agg(said, ',' ORDER BY first, place) AS spans FROM each GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (doc_id)
"""


OP11_SQL = _sql()
