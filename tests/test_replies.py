import random
import time

import pytest

from askloom.functions.replies import parse_pairs

LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def marker_at(text, i, digits=1):
    """The end of the marker that begins at i: a letter, digits, a full stop or a colon; 0 if there is none."""
    k = i + 1
    while k < len(text) and text[k].isdecimal():
        k += 1
    return k + 1 if i < len(text) and text[i] in "QqAa" and k - i > digits and k < len(text) and text[k] in ".:" else 0


def scanned(text, kind, other, to_end):
    """Texts behind the markers of one kind, each to the next marker of the other; a text has one character at least."""
    out, i = [], 0
    while i < len(text):
        begin = marker_at(text, i) if text[i].upper() == kind else 0
        if not begin:
            i += 1
            continue
        first = begin
        while first < len(text) and text[first].isspace():
            first += 1
        stop = next((k for k in range(first + 1, len(text)) if text[k].upper() == other and marker_at(text, k)), None)
        if stop is None and to_end and begin < len(text):
            stop = len(text)
        elif stop is None and first > begin and first < len(text) and text[first].upper() == other and marker_at(text, first):
            stop = first  # white space is all there is
        if stop is None:
            i += 1
            continue
        out.append(text[begin:stop].strip())
        i = stop
    return out


def lines_of(text):
    line, out = "", []
    for k, c in enumerate(text):
        if c in LINE_BREAKS:
            if not (c == "\n" and k and text[k - 1] == "\r"):
                out.append(line)
            line = ""
        else:
            line += c
    return [*out, line]


def by_lines(text):
    """An answer line counts if the marker line before it is a question, and neither is blank."""
    marked = [(x[0].upper(), x[end:].strip()) for x in (line.strip() for line in lines_of(text)) if (end := marker_at(x, 0, 0))]
    return [(q, a) for (one, q), (two, a) in zip(marked, marked[1:]) if (one, two) == ("Q", "A") and q and a]


def plain(text):
    """Numbered markers first; lines where they give nothing."""
    pairs = zip(scanned(text, "Q", "A", False), scanned(text, "A", "Q", True))
    return [p for p in pairs if all(p)] or by_lines(text)


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parse_pairs("t").alias("p"))
    return {r["i"]: [(p["question"], p["answer"]) for p in r["p"]] for r in df.collect()}


@pytest.mark.parametrize(
    "text,want",
    [
        ("Q1: What is A?\nA1: First.\nQ2: What is B?\nA2: Second.", [("What is A?", "First."), ("What is B?", "Second.")]),
        ("Q: What?\nA: This.\nQ: Why?\nA: So.", [("What?", "This."), ("Why?", "So.")]),
        ("", []),
        (None, []),
        ("Only prose here.", []),
        ("Q1: One?\nA1: Yes.\nQ2: Dangling?", [("One?", "Yes.")]),
        ("Q: a\nQ: b\nA: c\nA: d", [("b", "c")]),
        ("Q: a\nA: c\nmore of it", [("a", "c")]),
        ("q1. low\na1. case", [("low", "case")]),
    ],
)
def test_examples(spark, text, want):
    assert parsed(spark, [text])[0] == want


def test_random_replies_agree_with_python(spark):
    rng = random.Random(9)
    bits = ["Q1:", "A1:", "Q2.", "a2:", "Q:", "A:", "q.", "\n", "\n", " ", "x", "yes", "\r\n", " ", "\x1c", " ", "\x85", "FAQ3:"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    got = parsed(spark, texts)
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != plain(t)] == []


@pytest.mark.parametrize("text,n", [("Q1: what is it?\n" * 60_000, 0), ("Q1: what?\nA1: that.\n" * 40_000, 40_000), ("A1:" * 200_000, 0), ("Q: x\nA: y\n" * 50_000, 50_000)])
def test_long_replies_take_time_in_proportion(spark, text, n):
    parsed(spark, ["Q1: a A1: b"])
    began = time.perf_counter()
    assert len(parsed(spark, [text])[0]) == n
    assert time.perf_counter() - began < 60
