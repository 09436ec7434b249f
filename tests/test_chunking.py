import random
import time

import pytest

from askloom.operators.chunking import char_windows, chunk, chunk_native, greedy_pack, slices, split_keeping, split_text
from pyspark.sql import functions as F


def test_short_text_is_one_identical_chunk():
    assert split_text("Short text.", 1000, 200) == ["Short text."]


@pytest.mark.parametrize("text", ["", "   \n\t  ", None])
def test_blank_text_has_no_chunks(text):
    assert split_text(text, 1000, 200) == []


def test_long_text_has_bounded_chunks():
    chunks = split_text("This is a sentence. " * 200, 500, 50)
    assert len(chunks) > 1 and all(0 < len(c) <= 500 for c in chunks)


def test_paragraphs_give_no_blank_chunks():
    chunks = split_text("\n".join("word " * 50 for _ in range(20)), 300, 50)
    assert chunks and all(c.strip() for c in chunks)


def test_separator_is_lost_where_chunks_meet():
    assert split_text("aaaa. bbbb. cccc", 10, 0) == ["aaaa. bbbb", "cccc"]


def test_overlap_is_made_of_whole_pieces():
    assert split_text("aaa bbb ccc ddd", 7, 3) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert split_text("aaaaa bbbbb", 6, 3) == ["aaaaa", "bbbbb"]


def test_long_words_are_cut_into_characters():
    assert split_text("abcdefgh", 4, 1) == ["abcd", "defg", "gh"]


def test_invariants_on_random_texts():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "\n\n", ". ", "é"]) for _ in range(rng.randint(0, 60)))
        size = rng.randint(1, 12)
        overlap = rng.randint(0, size - 1)
        chunks = split_text(text, size, overlap)
        assert all(c in text and 0 < len(c) <= size and not c.isspace() for c in chunks)
        if len(text) <= size and text.strip():
            assert chunks == [text]
        letters = [x for x in text if x not in " \n."]
        assert set(letters) <= set("".join(chunks))


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "aaa bbb ccc", "x"), (2, " ", "y"), (3, None, "z")], "doc_id long, text string, chunk_of string")
    got = chunk(docs, 7, 3).orderBy("doc_id", "chunk_index").collect()
    assert [tuple(r) for r in got] == [(1, "x", 0, "aaa bbb"), (1, "x", 1, "bbb ccc")]
    assert chunk(docs, 7, 3, splitter=lambda t: t.split()).where("doc_id = 1").count() == 3


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, 20), (0, 0), (5, -1)])
def test_bad_sizes_raise(spark, size, overlap):
    with pytest.raises(ValueError, match="chunk_overlap"):
        chunk(spark.createDataFrame([(1, "a")], "doc_id long, text string"), size, overlap)


def test_native_windows_and_packing(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",), ("a\nbb\ncccc\nd",)], "t string")
    assert [r[0] for r in df.select(char_windows("t", 4, 1)).collect()][0] == ["abcd", "defg", "ghij"]
    assert [r[0] for r in df.select(greedy_pack(F.col("t"), "\n", 4)).collect()][2] == ["a\nbb", "cccc", "d"]


def packed(text, separator, size):
    out, now = [], None
    for part in text.split(separator):
        if now is not None and len(now) + len(separator) + len(part) <= size:
            now += separator + part
        else:
            out += [] if now is None else [now]
            now = part
    return [*out, now]


def test_packing_of_random_texts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "bcd", "\n", "--"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for separator, size in (("\n", 7), ("--", 5), ("\n", 1)):
        got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", greedy_pack("t", separator, size).alias("p")).collect()
        assert {r["i"]: r["p"] for r in got} == {i: packed(t, separator, size) for i, t in enumerate(texts)}


@pytest.mark.parametrize("text", ["a line of about forty characters, or so.\n" * 1_250_000, "y" * 50_000_000, "word " * 10_000_000], ids=["lines", "one word", "words"])
def test_a_text_of_50_mb_is_split_in_time(text):
    began = time.perf_counter()
    chunks = split_text(text)
    assert max(map(len, chunks)) <= 1000 and sum(map(len, chunks)) >= 0.9 * len(text)
    assert time.perf_counter() - began < 60


def test_a_text_of_20_mb_is_packed_in_time(spark):
    df = spark.range(1).select(F.repeat(F.lit("a line of about forty characters, or so.\n"), 500_000).alias("t"))
    began = time.perf_counter()
    assert df.select(F.size(greedy_pack("t", "\n"))).first()[0] == 500_000 // 24 + 1
    assert time.perf_counter() - began < 60


def test_kept_separators_begin_pieces_and_are_stripped_at_ends():
    assert split_keeping("foo bar baz 123", 7, 3) == ["foo bar", "baz", "123"]
    assert split_keeping("foo bar baz 123", 7, 4) == ["foo bar", "baz", "123"]
    assert split_keeping("a b c d e f", 5, 3) == ["a b c", "c d", "d e", "e f"]
    text = "Hi.\n\nI'm Harrison.\n\nHow? Are? You?\nOkay then f f f f.\nThis is a weird text to write, but gotta test the splittingggg some how.\n\nBye!\n\n-H."
    want = ["Hi.", "I'm", "Harrison.", "How? Are?", "You?", "Okay then", "f f f f.", "This is a", "weird", "text to", "write,", "but gotta", "test the", "splitting", "gggg", "some how.", "Bye!", "-H."]
    assert split_keeping(text, 10, 1) == want


def test_kept_separators_are_used_if_they_occur():
    assert split_keeping("one two\nthree", 8, 0) == ["one two", "three"] and split_keeping("abcdefgh", 4, 1) == ["abcd", "defg", "gh"]
    assert split_keeping("abcdefghij xy", 5, 0) == ["abcde", "fghij", "xy"]
    assert split_keeping("a\n\n\n\nb", 3, 0) == ["a", "b"] and split_keeping(" \n ", 3, 0) == [] and split_keeping(None, 3, 0) == []


def test_kept_chunks_hold_all_words_within_size():
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "\n\n", "é", "  "]) for _ in range(rng.randint(0, 60)))
        size = rng.randint(2, 12)
        chunks = split_keeping(text, size, rng.randint(0, size - 1))
        assert all(c in text and 0 < len(c) <= size and c == c.strip() for c in chunks)
        at = 0
        for c in chunks:  # in order
            assert text.find(c, max(0, at - size)) >= 0
            at = max(at, text.find(c, max(0, at - size)))
        assert set(text.split("\n\n")[0].replace(" ", "").replace("\n", "")) <= set("".join(chunks))


def test_kept_chunks_take_time_in_proportion():
    took = []
    for n in (20_000, 200_000):
        began = time.perf_counter()
        split_keeping("word " * n + "x" * n + "\n" * n, 1000, 200)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 0.5


def test_a_run_keeps_separators_by_default(spark, tmp_path):
    from askloom.operators.clients import OfflineClient
    from askloom.plans.run import run_pipeline

    docs = spark.createDataFrame([(1, "One sentence. Another one. A third. " * 20)], "doc_id long, text string")
    sizes = {s: run_pipeline(spark, docs, OfflineClient(), tmp_path / s, chunk_size=100, chunk_overlap=30, separators=s).metrics["total_chunks"] for s in ("kept", "lost")}
    assert sizes["kept"] == len(split_keeping(docs.first()["text"], 100, 30)) == run_pipeline(spark, docs, OfflineClient(), tmp_path / "d", chunk_size=100, chunk_overlap=30).metrics["total_chunks"]
    with pytest.raises(ValueError, match="separators"):
        run_pipeline(spark, docs, OfflineClient(), tmp_path / "x", separators="none")


def test_native_chunks_equal_the_others(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "bc", " ", "\n", "\n\n", ". ", "é漢", "  ", "defgh"]) for _ in range(rng.randint(0, 80))) for _ in range(150)] + [None, "", "x" * 5000, "word " * 2000, "\n" * 300]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk_of string, _n int")
    for size, overlap in ((7, 3), (12, 0), (40, 39), (1, 0)):
        got, want = (sorted(map(tuple, f(docs, size, overlap).collect())) for f in (chunk_native, chunk))
        assert got == want, (size, overlap)


def test_windows_of_a_long_text(spark):
    text = "é234567890" * 30_000
    for size, overlap in ((1000, 200), (7, 6), (300_000, 10), (299_999, 0)):
        if len(text) // (size - overlap) > 50_000:
            text = text[:5000]
        got = spark.createDataFrame([(text,)], "t string").select(char_windows("t", size, overlap).alias("w")).first()["w"]
        step, last = size - overlap, max(len(text) - 1 - overlap, 0) // (size - overlap)
        assert got == [text[i * step : i * step + size] for i in range(last + 1)]
    began = time.perf_counter()
    spark.range(1).select(F.explode(char_windows(F.repeat(F.lit("é234567890"), 500_000)))).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 30


def test_a_worker_cuts_a_bounded_amount_at_a_time(spark):
    import pyarrow as pa

    texts = pa.array(["a" * 10, None, "b" * 30, "", "c" * 5, "ü" * 5, "d" * 4])
    parts = list(slices(texts, 16))
    assert pa.concat_arrays(parts).to_pylist() == texts.to_pylist()
    assert [len(p) for p in parts] == [2, 1, 3, 1] and list(slices(texts[:0])) == []


def test_batches_of_several_steps_keep_their_rows(spark):
    docs = spark.range(4000, numPartitions=1).selectExpr("id AS doc_id", "concat(id, repeat(' Some words of a line.', 100)) AS text")
    first = chunk(docs, 120, 40).where("chunk_index = 0").select("doc_id", "chunk").collect()
    assert [r["doc_id"] for r in first] == list(range(4000)) and all(r["chunk"].startswith(f"{r['doc_id']} Some") for r in first)
