"""Text expressions that agree with Python's string methods on Unicode white space, case and line breaks."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(column(c), rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white space only."""
    return strip(F.coalesce(column(c), F.lit(""))) == ""


def normalize(c: Column | str) -> Column:
    """Stripped, in lower case, with each run of white space as one space."""
    return F.regexp_replace(F.lower(strip(c)), rf"(?U){SPACE}+", " ")


def lines(c: Column | str) -> Column:
    return F.split(column(c), LINE_BREAK)


def split_literal(c: Column | str, separator: str) -> Column:
    """Parts between a literal separator, empty ones included; an empty separator gives characters."""
    return F.split(column(c), rf"\Q{separator}\E" if separator else "", -1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def folded(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """struct(state, out) after step over all items: step(state, item) gives the next state and what it puts out, of type out.

    Items are folded in blocks of about the square root of their number, so that what has been put out is copied rarely:
    the time is in proportion to the items for as many as fit into a row.
    """

    def one(acc: Column, item: Column) -> Column:
        state, put = step(acc["state"], item)
        return F.struct(state.alias("state"), F.when(put.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(put))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{out}>").alias("out")), one)
        return bound(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
        last = F.greatest(F.floor((F.size(xs) - 1) / n), F.lit(0)).cast("int")
        blocks = bound(n, lambda k: F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * k + 1, k)))
        return F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out")), block, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))

    return bound(items, whole)


def render_prompt(template: str, **fields: Column) -> Column:
    """The template with its {fields} filled in; braces in the fields' values are plain text.

    The template is read once, here: unknown fields and stray braces raise before any job starts.
    """
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in fields or spec or conversion:
                raise ValueError(f"unknown field in the prompt template: {{{name}}}")
            parts.append(fields[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def title(label: str) -> str:
    """A metric's name as a heading: total_chunks is Total Chunks."""
    return label.replace("_", " ").title()
