"""Model replies to ordered question-answer pairs, as column expressions.

Numbered markers (Q1: A1:, anywhere in the text) come first: the text is cut at them once and the parts are read in order,
so a reply that repeats itself takes no longer than its length asks for. Where they give no pair, lines that begin with Q: or A:
(with or without a number) are read: an answer line counts if the marker line before it is a question.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, column, folded, is_blank, lines, strip

_NUMBERED = r"(?iU)[QA]\d+[.:]"
_MARKER = r"(?iU)^[QA]\d*[.:]"
PAIRS = "array<struct<question:string,answer:string>>"
_SPAN = "struct<first:int,end:int>"


def _said(parts: Column, asks: bool) -> Column:
    """The texts of questions, or of answers: from one's marker to the next marker of the other kind.

    Markers of its own kind on the way belong to the text. So does the marker right behind a blank, as a text has one
    character at least. A question needs an answer after it; an answer may go on to the end.
    """
    n = F.size(parts)

    def step(now: Column, part: Column) -> tuple[Column, Column]:
        own, closed = part["asks"] if asks else ~part["asks"], now["first"] < 0
        ends = ~closed & ~now["fresh"] & ~own
        first = F.when(closed & own, part["place"]).when(ends, F.lit(-1)).otherwise(now["first"])
        after = F.struct(first.alias("first"), (closed & own & part["blank"]).alias("fresh"))
        return after, F.when(ends, F.struct(now["first"].alias("first"), part["place"].alias("end")))

    def spans(found: Column) -> Column:
        first = found["state"]["first"]
        last = F.get(parts, first)
        if asks:  # nothing but white space before the one answer there is
            left = (first >= 0) & last["blank"] & (last["body"] != "") & ~F.get(parts, first + 1)["asks"]
            end = first + 1
        else:
            left, end = (first >= 0) & ((first + 1 < n) | (last["body"] != "")), n
        more = F.array(F.struct(first.alias("first"), end.alias("end")))
        return F.concat(found["out"], F.when(F.coalesce(left, F.lit(False)), more).otherwise(F.array().cast(f"array<{_SPAN}>")))

    def text(span: Column) -> Column:
        rest = F.transform(F.slice(parts, span["first"] + 2, span["end"] - span["first"] - 1), lambda p: F.concat(p["marker"], p["body"]))
        return strip(F.concat(F.get(parts, span["first"])["body"], F.array_join(rest, "")))

    found = folded(parts, F.struct(F.lit(-1).alias("first"), F.lit(False).alias("fresh")), step, _SPAN)
    return F.transform(bound(found, spans), text)


def numbered_pairs(c: Column | str) -> Column:
    text = column(c)
    bodies = F.split(text, _NUMBERED, -1)

    def part(marker: Column, body: Column) -> Column:
        return F.struct(marker.alias("marker"), body.alias("body"), (F.upper(marker.substr(1, 1)) == "Q").alias("asks"), is_blank(body).alias("blank"))

    def paired(parts: Column) -> Column:
        placed = F.transform(parts, lambda p, i: F.struct(i.alias("place"), p["marker"].alias("marker"), p["body"].alias("body"), p["asks"].alias("asks"), p["blank"].alias("blank")))
        return bound(placed, lambda x: bound(F.struct(_said(x, True).alias("q"), _said(x, False).alias("a")), together))

    def together(both: Column) -> Column:
        n = F.least(F.size(both["q"]), F.size(both["a"]))
        pairs = F.zip_with(F.slice(both["q"], F.lit(1), n), F.slice(both["a"], F.lit(1), n), lambda x, y: F.struct(x.alias("question"), y.alias("answer")))
        return F.filter(pairs, lambda p: (p["question"] != "") & (p["answer"] != ""))

    after = bound(bodies, lambda b: F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))))
    return bound(F.zip_with(F.regexp_extract_all(text, F.lit(_NUMBERED), F.lit(0)), after, part), paired)


def line_pairs(c: Column | str) -> Column:
    marked = F.filter(F.transform(lines(c), strip), lambda line: line.rlike(_MARKER))
    read = F.transform(marked, lambda line: F.struct((F.upper(line.substr(1, 1)) == "Q").alias("asks"), strip(F.regexp_replace(line, _MARKER, "")).alias("text")))
    following = F.slice(read, F.lit(2), F.greatest(F.size(read) - 1, F.lit(0)))
    both = F.zip_with(F.slice(read, F.lit(1), F.size(following)), following, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    met = F.filter(both, lambda p: p["x"]["asks"] & ~p["y"]["asks"] & (p["x"]["text"] != "") & (p["y"]["text"] != ""))
    return F.transform(met, lambda p: F.struct(p["x"]["text"].alias("question"), p["y"]["text"].alias("answer")))


def _parsed(text: Column) -> Column:
    return bound(numbered_pairs(text), lambda found: F.when(F.size(found) > 0, found).otherwise(line_pairs(text))).cast(PAIRS)


@functools.lru_cache(maxsize=16)
def _parsed_column(name: str, gateway: object) -> Column:
    """The expression has some thousand parts, so for a column of that name it is built once for each gateway to a JVM."""
    return _parsed(F.coalesce(F.col(name), F.lit("")))


def parse_pairs(c: Column | str) -> Column:
    """array<struct<question, answer>>; null gives an empty array."""
    return _parsed_column(c, SparkContext._gateway) if isinstance(c, str) else _parsed(F.coalesce(c, F.lit("")))
