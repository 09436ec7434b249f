import json
import os

import pytest
from pyspark.sql import functions as F

from askloom.sources import readers, storage, writers


def texts(df):
    return [r["text"] for r in df.orderBy("path").collect()]


def test_txt(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Hello, world!\r\nSecond line.\rThird ﻿".encode() + b"\xff")
    (tmp_path / "b.TXT").write_bytes(b"")
    assert texts(readers.ingest(spark, str(tmp_path / "a.txt"))) == ["Hello, world!\nSecond line.\nThird ﻿�"]
    assert texts(readers.ingest(spark, str(tmp_path / "b.TXT"))) == [""]


def test_csv_auto_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,body,score,ok\nOne,"First ""body""\nsecond line",1,true\nTwo,NA,,False\n')
    assert texts(readers.ingest(spark, str(tmp_path / "a.csv"))) == ['One First "body"\nsecond line\nTwo ']


def test_csv_cells_that_only_begin_like_numbers_are_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("flat,price,rate,title\n3F,1.5,-2e3,one\n10d,,.5,two\n", "utf-8")
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).first()["text"] == "3F one\n10d two"


def test_csv_explicit_columns(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("title,body,score\nOne,First,1\n")
    assert texts(readers.ingest(spark, str(path), ["score", "title", "unknown"])) == ["1 One"]
    with pytest.raises(ValueError, match="None of the specified columns"):
        readers.ingest(spark, str(path), ["unknown"])
    assert texts(readers.read_csv(spark, str(path), [], per_row=True)) == ["One First"]


def test_csv_without_rows_or_text_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,body\n")
    (tmp_path / "b.csv").write_text("n,m\n1,2.5\n3,\n")
    assert texts(readers.ingest(spark, str(tmp_path / "a.csv"))) == [""]
    assert texts(readers.ingest(spark, str(tmp_path / "b.csv"))) == ["1 2.5\n3 "]


def test_csv_columns_are_found_file_by_file(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("title,body\nOne,First\n")
    (tmp_path / "b+[1].csv").write_text("body,title\nSecond,Two\n")
    (tmp_path / "c.csv").write_text("id,body,more\n7,Third,x\n8,,y\n")
    (tmp_path / "d.csv").write_text('"a\nb",body\n1,Fourth\n')
    (tmp_path / "e.csv").write_text("title,body\n")
    (tmp_path / "f.csv").write_bytes(b"")
    got = readers.read_csv(spark, f"{tmp_path}/*.csv", ["body", "title"])
    assert texts(got) == ["First One", "Second Two", "Third\n", "Fourth", "", ""]
    assert texts(readers.read_csv(spark, f"{tmp_path}/*.csv")) == ["One First", "Second Two", "Third x\n y", "Fourth", "", ""]
    with pytest.raises(ValueError, match="None of the specified columns"):
        readers.read_csv(spark, f"{tmp_path}/*.csv", ["title"])


def test_csv_names_that_are_alike(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,title,a,a,,\n1,two,3,4,5,6\n")
    for wanted, want in ((["title"], "two"), (["Title"], "1"), (["a"], "3"), (["a.1", "a"], "4 3"), (["Unnamed: 5"], "6"), (["A", "title"], "two")):
        assert texts(readers.read_csv(spark, str(tmp_path / "a.csv"), wanted)) == [want]
    with pytest.raises(ValueError, match="None of the specified columns"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), ["TITLE"])


def test_csv_records_equal_a_plain_reader(spark, tmp_path):
    import csv
    import io
    import random

    rng = random.Random(4)
    for k in range(12):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        for _ in range(30):
            writer.writerow(["x" + "".join(rng.choice(['"', ",", "\n", "a", "é", " ", '""', ",,"]) for _ in range(rng.choice([0, 3, 12]))) for _ in range(rng.choice([1, 2, 5]))])
        (tmp_path / f"{k}.csv").write_text(out.getvalue(), "utf-8", newline="")
    long = '"' + 'y"",' * 20_000 + '"'
    (tmp_path / "long.csv").write_text(f'a,b\n{long},2\n5" wide,"open\n')
    got = {}
    for r in readers.csv_records(spark, f"{tmp_path}/*.csv").orderBy("path", "row").collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append(r["cells"])
    assert got.pop("long.csv") == [["a", "b"], ['y",' * 20_000, "2"], ['5" wide', "open"]]
    for name, cells in got.items():
        assert cells == list(csv.reader(io.StringIO((tmp_path / name).read_text("utf-8"), newline=""))), name


def test_csv_columns_have_kinds(spark, tmp_path):
    cells = {"n": ["1", "-2", ""], "f": ["1", "2.5", "NA"], "t": ["3F", "1", "2"], "b": ["true", "False", "TRUE"], "gap": ["true", "", "false"], "mix": ["true", "1", "0"], "no": ["", "null", "NaN"], "7": ["1", "2", "3"]}
    (tmp_path / "a.csv").write_text("\n".join([",".join(cells), *map(",".join, zip(*cells.values()))]) + "\n")
    got = {r["name"]: r["kind"] for r in readers.csv_columns(readers.csv_records(spark, str(tmp_path / "a.csv"))).collect()}
    assert got == {"n": "whole", "f": "decimal", "t": "text", "b": "boolean", "gap": "text", "mix": "text", "no": "missing", "7": "whole"}
    assert texts(readers.ingest(spark, str(tmp_path / "a.csv"))) == ["3F true true\n1  1\n2 false 0"]


def test_csv_cells_as_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,gap,f,b,odd,t\n007,1,1.50,true,TRUE,3F\n+5,,2,False,,1\n-3,12,1e3,TRUE,false,NA\n")
    wanted = ["n", "gap", "f", "b", "odd", "t"]
    assert texts(readers.read_csv(spark, str(tmp_path / "a.csv"), wanted, typed=True)) == ["7 1.0 1.5 True True 3F\n5  2.0 False  1\n-3 12.0 1000.0 True False "]
    assert texts(readers.read_csv(spark, str(tmp_path / "a.csv"), typed=True)) == ["True 3F\n 1\nFalse "]
    assert texts(readers.ingest(spark, str(tmp_path / "a.csv"), ["f", "n"])) == ["1.50 007\n2 +5\n1e3 -3"]
    (tmp_path / "b.csv").write_text("x,y\n1,2.5\n2,3\n")
    assert texts(readers.read_csv(spark, str(tmp_path / "b.csv"), typed=True)) == ["1 2.5\n2 3.0"]


def test_floats_are_written_as_python_does(spark):
    import random

    rng = random.Random(1)
    numbers = [0.0, -0.0, 1.0, 1e7, 12345678.9, -1e15, 1e16, 1.5e16, 123456789012345680.0, 1e22, 1e-3, 1e-4, 1.25e-4, 1e-5, -2.5e-7, 1e300, 1e100, float("inf"), float("-inf"), 9999999.0]
    numbers += [round(rng.uniform(-1, 1) * 10 ** rng.randint(-6, 18), rng.randint(0, 9)) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", readers.float_text(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got if float(r["s"]) != r["x"]] == []
    # An older Java may write a digit more where 17 are needed for some numbers of that size.
    assert [r["s"] for r in got if r["s"] != repr(r["x"]) and (abs(r["x"]) < 2**53 or len(r["s"]) < 22)] == []


def test_csv_files_are_read_once_whatever_their_headers(spark, tmp_path):
    for k in range(300):
        columns = [f"c{k}", "body", *(f"x{i}" for i in range(k % 5))]
        (tmp_path / f"{k}.csv").write_text(",".join(columns) + f"\n{k},text {k}" + ",1" * (k % 5) + "\nshort\n1,long" + ",2" * 9 + "\n")
    got = readers.read_csv(spark, f"{tmp_path}/*.csv", ["body"], per_row=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and "Union" not in plan and plan.count("Scan parquet") == 2  # records and headers, both written
    assert sorted(texts(got)) == sorted([f"text {k}" for k in range(300)] + [""] * 300 + ["long"] * 300)


def test_csv_row_ids_do_not_follow_the_partitions(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.csv").write_text("body\n" + "".join(f"row {k} {i}\n" for i in range(20)))
    ids = []
    for size in ("128m", "100b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        ids.append({r["text"]: r["doc_id"] for r in readers.read_csv(spark, f"{tmp_path}/*.csv", ["body"], per_row=True).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1] and len(set(ids[0].values())) == 100


def test_tables_without_ids_have_lasting_ones(spark):
    df = spark.range(30).selectExpr("concat('text ', id) AS body", "id AS more")
    one, other = ({r["text"]: r["doc_id"] for r in readers.from_dataframe(x, "body").collect()} for x in (df, df.repartition(7)))
    assert one == other and len(set(one.values())) == 30


def test_shared_storage(spark, tmp_path):
    from types import SimpleNamespace

    for master, where in (("local[4]", None), ("spark://host:7077", "hdfs://shared")):
        conf = SimpleNamespace(get=lambda key, default, where=where: where)
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: str(tmp_path))
        assert storage.shared_dir(SimpleNamespace(conf=conf, sparkContext=context)) in (where, str(tmp_path))
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(bare)
    kept = storage.materialise(spark.range(5), "test")
    path = kept._askloom_path.removeprefix("file:")
    assert kept.count() == 5 and os.path.isdir(path)
    storage.discard(kept)
    assert not os.path.exists(path)


def test_unsupported_suffix(spark):
    with pytest.raises(ValueError, match="Unsupported file format"):
        readers.ingest(spark, "a.docx")


def test_pdf_interface(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    got = readers.read_pdf(spark, str(tmp_path / "a.pdf"), extract=lambda content: "\n".join(content.decode().split("|")))
    assert texts(got) == ["one\ntwo"]


def test_from_dataframe(spark):
    df = spark.createDataFrame([(7, "a")], "id int, body string")
    assert tuple(readers.from_dataframe(df, "body", "id").first()) == (7, None, "a")
    with pytest.raises(ValueError):
        readers.from_dataframe(df, "id")


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(1, 0, 1, "Q two?", "Two é", 0.6667), (1, 0, 0, "Q one?", "One", 1.0)], "doc_id long, chunk_index int, pair_index int, question string, answer string, _score double")


def test_schema(pairs):
    assert writers.apply_schema(pairs).columns == ["question", "answer", "doc_id", "chunk_index", "pair_index", "_score"]
    assert writers.apply_schema(pairs, "Q", "A", include_score=False).columns == ["Q", "A", "doc_id", "chunk_index", "pair_index"]
    with pytest.raises(ValueError, match="clash"):
        writers.apply_schema(pairs, "Doc_Id", "A")


def test_jsonl_and_json(pairs, tmp_path):
    path = writers.export(pairs, tmp_path / "deep" / "a.jsonl", ".JSONL", "Q", "A", include_score=True)
    assert path.read_text("utf-8") == '{"Q": "Q one?", "A": "One", "chunk_index": 0, "_score": 1.0}\n{"Q": "Q two?", "A": "Two é", "chunk_index": 0, "_score": 0.6667}\n'
    path = writers.export(pairs, tmp_path / "a.json", "json")
    want = [{"question": "Q one?", "answer": "One", "chunk_index": 0}, {"question": "Q two?", "answer": "Two é", "chunk_index": 0}]
    assert path.read_text("utf-8") == json.dumps(want, ensure_ascii=False, indent=2)


def test_texts_with_rare_line_breaks_stay_whole(spark, tmp_path):
    texts = ["a\u2028b\u2029c", "d\x85e\x0bf\x1cg", "h\r\ni\rj\nk"]
    pairs = spark.createDataFrame([(1, 0, i, t, t) for i, t in enumerate(texts)], "doc_id long, chunk_index int, pair_index int, question string, answer string")
    want = [{"question": t, "answer": t, "chunk_index": 0} for t in texts]
    assert json.loads(writers.export(pairs, tmp_path / "a.json", "json").read_text("utf-8")) == want
    assert [json.loads(line) for line in writers.export(pairs, tmp_path / "a.jsonl", "jsonl").read_text("utf-8").split("\n")[:-1]] == want


def test_empty_exports(pairs, tmp_path):
    none = pairs.where("false")
    assert writers.export(none, tmp_path / "a.jsonl", "jsonl").read_text() == ""
    assert writers.export(none, tmp_path / "a.json", "json").read_text() == "[]"


def test_folder(spark, pairs, tmp_path):
    writers.export_folder(pairs, str(tmp_path / "out"), "Q", "A")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_unknown_format(pairs, tmp_path):
    with pytest.raises(ValueError, match="Unsupported export format"):
        writers.export(pairs, tmp_path / "a.xml", "xml")
