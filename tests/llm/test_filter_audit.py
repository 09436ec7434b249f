"""The audit against a loop over documents and orders, on small tables."""

import itertools
import random
import re

import pytest
from askloom.llm import filter_audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        good, toxic = (any(j == i and i is not None and x[k] == 1 for j, *x in labels) for k in (0, 1))
        rows.append((source or "", fails, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + now
                only = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, "".join(order), step] = [len(left), len(now), redundant, only, sum(r[2] for r in now), sum(r[3] for r in now)]
    total = {}
    for (part, order, step), x in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + x[1]
    return {k: (*x, total[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, 7, "x") for r in docs], "doc_id long, text string, source string, mask int, part string")
    lab = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = filter_audit.filter_audit(d, lab).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*COUNTS, "shapley")) for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(90)]
    docs = []
    for i in range(120):
        w = [rng.choice(words[: rng.choice([20, 90])]) for _ in range(rng.choice([0, 3, 49, 50, 51, 80]))]
        text = rng.choice([" ", "\n\t", " \x0b"]).join(w) + rng.choice(["", " a # b", " ABCDEFGHIJ" * 3, " É漢\U0001f600"])
        docs.append((rng.choice([i, i, i % 9, None]), rng.choice([text, text, None, docs[0][1] if docs else text, docs[-1][1] if docs else text]), rng.choice(["s1", "s2", None, ""])))
    labels = [(rng.choice([None, *range(120)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_edges(spark):
    fifty = " ".join(f"w{i}" for i in range(50))
    caps = "A" * 5 + "b" * 95
    docs = [(1, fifty, "x"), (2, caps, "x"), (3, "A" * 6 + "b" * 94, "x"), (4, " ".join(["a"] * 18 + [f"w{i}" for i in range(32)]), "x"), (5, fifty, "y"), (5, fifty, "y"), (6, "word " * 30_000, None), (7, None, "y"), (8, "", "y")]
    assert audited(spark, docs, []) == brute(docs, [])
    assert audited(spark, [], [(1, 1, 1)]) == {}


def test_a_text_that_most_rows_share(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 > 0, 'the same text', concat('text ', id)) as text", "'s' as source")
    labels = spark.range(0).selectExpr("id as doc_id", "1 as quality", "1 as toxic")
    got = filter_audit.filter_audit(docs, labels).where("filter_order = 'EABCD' and step = 1").collect()
    assert [(r["kept"], r["removed"], r["unique_fails"]) for r in got] == [(3001, 5999, 0)]
