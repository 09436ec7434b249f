"""Documents from text, CSV and PDF files or from tables: (doc_id, path, text)."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound, folded
from .storage import materialise

#: What a CSV cell may say for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SUFFIXES = (".pdf", ".txt", ".csv")
#: A cell that is a number; unlike a cast it takes no letter behind it, as in `3F`.
WHOLE = r"^\s*[+-]?\d+\s*$"
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^[+-]?inf(inity)?$"


def _numbered(df: DataFrame) -> DataFrame:
    """doc_id from the path, so that a document has the same one in every run."""
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def _empty_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text) of the files without a byte, which Spark's readers leave out."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for one in [path] if isinstance(path, str) else path:
        pattern = jvm.org.apache.hadoop.fs.Path(one)
        system = pattern.getFileSystem(conf)
        for status in system.globStatus(pattern) or []:
            inside = system.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += [(f.getPath().toString(), "") for f in inside if f.isFile() and f.getLen() == 0 and f.getPath().getName()[0] not in "_."]
    return spark.createDataFrame(found, "path string, text string")


def read_txt(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One document for each file: UTF-8, broken bytes as U+FFFD, every line break as a line feed."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    files = spark.read.format("binaryFile").load(path).select("path", F.regexp_replace(text, "\r\n?", "\n").alias("text"))
    return _numbered(files.unionByName(_empty_files(spark, path)))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, row (ascending within a file) and cells of each record of the files, the header's too, whatever their widths.

    The reader is told of one column. It keeps the source of a record that has any other number, and that is cut here.
    """
    reader = spark.read.schema("only string, source string").option("columnNameOfCorruptRecord", "source").option("columnPruning", "false")
    records = reader.csv(path, header=False, multiLine=True, quote='"', escape='"', nullValue=None, emptyValue="", mode="PERMISSIVE")
    return records.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row"), _cells(SparkContext._gateway).alias("cells"))


@functools.lru_cache(maxsize=1)
def _cells(gateway: object) -> Column:
    """Built once for each gateway to a JVM. Where lines end in CR LF, but a quoted cell had an LF before, the CR is left."""
    only, source = (F.regexp_replace(c, r"\r\z", "") for c in ("only", "source"))
    return F.when(F.col("source").isNull(), F.array(F.coalesce(only, F.lit("")))).otherwise(record_cells(source))


def record_cells(record: Column) -> Column:
    """The cells of one CSV record: quotes count where a cell begins with one, and two of them are one within."""
    between = F.split(record, ",", -1)

    def step(now: Column, part: Column) -> tuple[Column, Column]:
        """now: where the open cell begins (below 0: none) and its quotes; a quoted cell ends where they are even."""
        begun = now["first"] >= 0
        quotes = F.when(begun, now["quotes"] + part["quotes"]).otherwise(F.when(part["quoted"], part["quotes"]).otherwise(F.lit(0)))
        first, ends = F.when(begun, now["first"]).otherwise(part["place"]), quotes % 2 == 0
        after = F.struct(F.when(ends, F.lit(-1)).otherwise(first).alias("first"), quotes.alias("quotes"))
        return after, F.when(ends, F.struct(first.alias("first"), part["place"].alias("last")))

    def joined(parts: Column) -> Column:
        marked = F.transform(parts, lambda p, i: F.struct(i.alias("place"), (F.length(p) - F.length(F.replace(p, F.lit('"'), F.lit("")))).alias("quotes"), F.startswith(p, F.lit('"')).alias("quoted")))
        found = folded(marked, F.struct(F.lit(-1).alias("first"), F.lit(0).alias("quotes")), step, "struct<first:int,last:int>")
        left = F.struct(found["state"]["first"].alias("first"), (F.size(parts) - 1).alias("last"))  # a quote that nothing closes
        spans = bound(found, lambda x: F.when(x["state"]["first"] < 0, x["out"]).otherwise(F.concat(x["out"], F.array(F.struct(x["state"]["first"].alias("first"), left["last"].alias("last"))))))
        return F.transform(spans, lambda span: plain(F.array_join(F.slice(parts, span["first"] + 1, span["last"] - span["first"] + 1), ",")))

    def plain(cell: Column) -> Column:
        return F.when(F.startswith(cell, F.lit('"')), F.replace(F.regexp_replace(cell, r'^"|"\z', ""), F.lit('""'), F.lit('"'))).otherwise(cell)

    return F.when(~F.contains(record, F.lit('"')), between).otherwise(bound(between, joined))


#: Kinds of cells, in the order of the counts of a column.
KINDS = ("missing", "boolean", "whole", "decimal", "text")


def cell_kind(c: Column) -> Column:
    """The place of a cell's kind among KINDS."""
    return F.when(c.isNull() | c.isin(*MISSING), 0).when(F.lower(c).isin("true", "false"), 1).when(c.rlike(WHOLE), 2).when(c.rlike(NUMBER), 3).otherwise(4)


def csv_columns(records: DataFrame) -> DataFrame:
    """path, first (the header's row), place, name, kind (one of KINDS) and gaps (whether cells are missing) of each column of each file, by counts of its cells' kinds.

    Counts of the kinds can be added up in any order, and the header's own cell taken away, so no record need know where
    its file begins. Two kinds of cells make a column of text, but whole and decimal numbers, and missing cells among numbers.
    """
    cells = records.select("path", "row", F.posexplode("cells").alias("place", "cell")).withColumn("kind", cell_kind(F.col("cell")))
    counts = [F.count_if(F.col("kind") == i).alias(k) for i, k in enumerate(KINDS)]
    columns = cells.groupBy("path", "place").agg(F.min("row").alias("first"), F.min_by("cell", "row").alias("name"), *counts)
    own = [(F.col(k) - (cell_kind(F.col("name")) == i).cast("int")).alias(k) for i, k in enumerate(KINDS)]
    numbers = (F.col("whole") > 0) | (F.col("decimal") > 0)
    kind = (
        F.when((F.col("text") > 0) | ((F.col("boolean") > 0) & (numbers | (F.col("missing") > 0))), "text").when(F.col("boolean") > 0, "boolean")
        .when(F.col("decimal") > 0, "decimal").when(numbers, "whole").otherwise("missing")
    )
    truths = (F.col("text") == 0) & (F.col("whole") == 0) & (F.col("decimal") == 0) & (F.col("boolean") > 0)
    return columns.select("path", "first", "place", "name", *own).select("path", "first", "place", "name", kind.alias("kind"), (F.col("missing") > 0).alias("gaps"), truths.alias("truths"))


def float_text(c: Column) -> Column:
    """A double as Python writes it: Java's digits (of which an older Java has one too many for some beyond 2^53), another form of large and small numbers."""
    said = c.cast("string")
    digits, power = F.regexp_replace(F.regexp_extract(said, r"^-?(\d\.\d+)E", 1), r"\.0$|\.", ""), F.regexp_extract(said, r"E(-?\d+)$", 1).try_cast("int")
    sign, n = F.when(F.startswith(said, F.lit("-")), "-").otherwise(""), F.length(digits)
    whole, rest = F.rpad(digits, power + 1, "0"), F.substring(digits, power + 2, n)
    large = F.concat(F.substring(whole, F.lit(1), power + 1), F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    form = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    other = F.when(power.between(0, 15), F.concat(sign, large)).when(power.between(-4, -1), F.concat(sign, small)).otherwise(F.concat(sign, form))
    return F.when(F.contains(said, F.lit("Infinity")), F.concat(sign, F.lit("inf"))).when(F.contains(said, F.lit("E")), other).otherwise(said)


def typed_cell(cell: Column, form: Column) -> Column:
    """A cell as the value of its column would be written: True and False, whole numbers plainly, numbers with gaps or fractions as floats."""
    number = F.trim(cell)
    return (
        F.when(cell.isNull() | cell.isin(*MISSING), "").when(form == "truth", F.initcap(cell)).when(form == "whole", F.coalesce(number.try_cast("decimal(38,0)").cast("string"), cell))
        .when(form == "float", F.coalesce(float_text(number.try_cast("double")), cell)).otherwise(cell)
    )


def column_names(header: Column) -> Column:
    """A header's names: of those that are alike the later ones with .1, .2 and so on, empty ones by their place."""

    def name(c: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(header, F.lit(1), i), lambda x: x == c))
        return F.when(c == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).when(before > 0, F.concat_ws(".", c, before.cast("string"))).otherwise(c)

    return F.transform(header, name)


#: Tables of one row a file are broadcast for so many files, and names in their headers, at most.
BROADCAST_FILES, BROADCAST_NAMES = 10_000, 200_000


def _size() -> list[Column]:
    return [F.count("*").alias("files"), F.sum(F.size("places")).alias("names")]


def _headers(records: DataFrame, wanted: list[str] | None, typed: bool, seen: Observation) -> DataFrame:
    """of (a file), first (its header's row), places of the columns that make its lines and forms of their cells, on shared storage."""
    if wanted and not typed:
        heads = records.groupBy(F.col("path").alias("of")).agg(F.min("row").alias("first"), F.min_by("cells", "row").alias("header"))
        heads = heads.select("of", "first", column_names(F.col("header")).alias("names"), F.lit(None).cast("array<string>").alias("forms"), F.lit(None).cast("array<int>").alias("texts"))
    else:
        form = F.when(F.col("truths"), "truth").when((F.col("kind") == "whole") & ~F.col("gaps"), "whole").when(F.col("kind").isin("whole", "decimal"), "float").otherwise("text")
        columns = csv_columns(records).groupBy(F.col("path").alias("of"))  # a row a column
        each = columns.agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("place", "name", "kind", form.alias("form")))).alias("all"))
        texts = F.transform(F.filter("all", lambda x: x["kind"] == "text"), lambda x: x["place"])
        heads = each.select("of", "first", column_names(F.col("all")["name"]).alias("names"), F.col("all")["form"].alias("forms"), texts.alias("texts"))
    if wanted:
        places = F.filter(F.transform(F.array(*[F.lit(c) for c in wanted]), lambda w: F.array_position("names", w).cast("int") - 1), lambda p: p >= 0)
    else:
        places = F.when(F.size("texts") > 0, F.col("texts")).otherwise(F.sequence(F.lit(0), F.size("names") - 1))
    found = materialise(heads.select("of", "first", "names", places.alias("places"), "forms").observe(seen, *_size()), "headers")
    if wanted and (none := found.where(F.size("places") == 0).select("of", "names").first()) is not None:
        raise ValueError(f"None of the specified columns {wanted} are in {none['of']}; it has {none['names']}")
    return found.drop("names")


def read_csv(spark: SparkSession, path: str | list[str], text_columns: list[str] | None = None, per_row: bool = False, typed: bool = False) -> DataFrame:
    """One document for each file, its rows joined by line feeds; with per_row one for each row.

    All files are read once, by position, and their records kept on shared storage; a table of one row a file says where
    its columns are, by its own header, so files may order, add or lack columns, or repeat a name (`a`, `a.1`). Names are
    case-sensitive; a file that has none of the wanted ones raises. A row is its text columns joined by single spaces,
    missing cells empty: the wanted ones in that order, or those that hold text in the row's file, else all. Cells beyond
    the header are left out. Cells keep the file's own text; typed: they are written as values of their column's kind, so
    `true` is True, and 1 is 1.0 in a column with gaps or fractions. A file without rows is an empty text. The ids of rows come from the file and the row's number in it.
    """
    records = materialise(csv_records(spark, path), "records")
    seen = Observation()
    heads = _headers(records, text_columns, typed, seen)
    small = seen.get["files"] <= BROADCAST_FILES and (seen.get["names"] or 0) <= BROADCAST_NAMES
    met = records.join(F.broadcast(heads) if small else heads, F.col("path") == F.col("of")).where("row > first")
    cell = F.transform("places", lambda p: F.coalesce(F.get("cells", p), F.lit("")))
    said = F.zip_with(cell, "places", lambda c, p: typed_cell(c, F.get("forms", p))) if typed else F.transform(cell, lambda c: F.when(c.isin(*MISSING), "").otherwise(c))
    lines = met.select("path", "row", "first", F.array_join(said, " ").alias("line"))
    if per_row:  # a file is read by one task, so its rows' numbers follow one another
        numbered = lines.select(F.concat_ws("#", "path", F.col("row") - F.col("first") - 1).alias("path"), "line")
        return numbered.select(F.xxhash64("path").alias("doc_id"), "path", F.col("line").alias("text"))
    whole = lines.groupBy(F.col("path").alias("of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))
    files = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("at"))
    found = files.join(whole, F.col("at") == F.col("of"), "left").select("path", F.coalesce("text", F.lit("")).alias("text"))
    return _numbered(found.unionByName(_empty_files(spark, path)))


def _pdf_pages(content: bytes) -> str:
    import io

    try:
        import fitz
    except ImportError:
        try:
            import pypdf
        except ImportError:
            raise ImportError("reading PDF needs PyMuPDF (fitz) or pypdf on the executors") from None
        pages = [page.extract_text() for page in pypdf.PdfReader(io.BytesIO(content)).pages]
        return "\n".join(p for p in pages if p)
    with fitz.open(stream=content, filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc)


def read_pdf(spark: SparkSession, path: str | list[str], extract=_pdf_pages) -> DataFrame:
    """One document for each file: its pages' texts joined by line feeds. extract: bytes to text, on the executors."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [extract(bytes(x)) for x in pdf["content"]]})

    return _numbered(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "path string, text string"))


def ingest(spark: SparkSession, path: str, text_columns: list[str] | None = None, typed: bool = False) -> DataFrame:
    """Documents of a file (or a glob) by its suffix."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"Unsupported file format '{suffix}'; supported are {', '.join(SUFFIXES)}")
    if suffix == ".csv":
        return read_csv(spark, path, text_columns, typed=typed)
    return read_txt(spark, path) if suffix == ".txt" else read_pdf(spark, path)


def from_dataframe(df: DataFrame, text_column: str = "text", id_column: str | None = None) -> DataFrame:
    """Documents of any table with a text column; without an id column rows go by a hash of all columns, equal ones alike."""
    if not isinstance(df.schema[text_column].dataType, T.StringType):
        raise ValueError(f"{text_column} is not a text column")
    number = F.col(id_column).cast("long") if id_column else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(number.alias("doc_id"), F.lit(None).cast("string").alias("path"), F.col(text_column).alias("text"))
