import pytest
from pyspark.sql import functions as F

from askloom.functions import scores, text
from askloom.operators.pairs import deduplicate, filter_pairs, pairs_from_turns, score_pairs

GOOD = ("What is the capital of France?", "The capital is Paris.")


def made(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, question string, answer string")


def scored(spark, *rows):
    return [r["_score"] for r in score_pairs(made(spark, rows)).orderBy("id").collect()]


def test_scores(spark):
    got = scored(spark, GOOD, ("What is it, then?", ""), ("", "An answer."), (None, "An answer."), ("What is it, then?", "x"), ("Paris in France", "A capital."), ("short", "y" * 2001), ("  \x1c", "An answer."))
    assert got == [1.0, 0.0, 0.0, 0.0, 2 / 3, 2 / 3, 0.0, 0.0]
    assert scored(spark, ("Paris, a city", "y" * 2001)) == [1 / 3]


@pytest.mark.parametrize("q,want", [("ſhould it", True), ("whatever", False), ("éis", False), ("IS it", True), ("it ends? ", True)])
def test_looks_like_question(spark, q, want):
    assert spark.createDataFrame([(q,)], "q string").select(scores.looks_like_question("q")).first()[0] is want


def test_dedup_keeps_the_first(spark):
    got = deduplicate(made(spark, [GOOD, ("Other question?", "Other."), GOOD]), ["id"])
    assert sorted(r["id"] for r in got.collect()) == [0, 1]
    alike = [(GOOD[0].upper(), GOOD[1]), GOOD, (f"  {GOOD[0]}\n", GOOD[1].replace(" ", "\t "))]
    assert [r["id"] for r in deduplicate(made(spark, alike), ["id"]).collect()] == [0]
    assert deduplicate(made(spark, alike).withColumn("d", F.col("id") % 2), ["id"], scope=["d"]).count() == 2


def test_filter(spark):
    got = filter_pairs(made(spark, [GOOD, ("?", ""), GOOD]), ["id"], min_score=0.5).collect()
    assert [(r["id"], r["_score"]) for r in got] == [(0, 1.0)]
    assert filter_pairs(made(spark, [GOOD, GOOD]), ["id"], min_score=0.0, dedup=False).count() == 2
    two_thirds = made(spark, [("Paris in France", "A capital.")])
    assert filter_pairs(two_thirds, ["id"], min_score=2 / 3).first()["_score"] == 0.6667
    assert filter_pairs(two_thirds, ["id"], min_score=0.6667).count() == 0


def test_first_of_equal_pairs_is_shuffled_in_small(spark):
    plan = deduplicate(made(spark, [GOOD]), ["id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_strip_normalize_and_lines(spark):
    odd = ["\x1c a  B\t\n", "İ ẞ ΑΣ", "a\r\nb\x85c d", "", " "]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    got = df.select(text.strip("t"), text.normalize("t"), text.lines("t")).collect()
    for x, (s, n, parts) in zip(odd, got):
        assert s == x.strip() and n == " ".join(x.strip().lower().split())
        assert [p for p in parts if p] == [p for p in x.splitlines() if p]


def test_prompt_templates(spark):
    df = spark.createDataFrame([("a {b}",)], "t string")
    assert df.select(text.render_prompt("{{x}} {chunk}!", chunk=F.col("t"))).first()[0] == "{x} a {b}!"
    for bad in ("{other}", "{chunk", "{chunk:>9}"):
        with pytest.raises(ValueError):
            text.render_prompt(bad, chunk=F.col("t"))


def test_pairs_from_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "alone"), (2, 0, "assistant", "b")], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in pairs_from_turns(turns).collect()] == [(1, 1, "q", "a")]
