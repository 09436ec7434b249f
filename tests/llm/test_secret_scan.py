"""Secrets against plain regular expressions, and the ledger over several runs."""

import hashlib
import random
import re
from dataclasses import replace

import pytest
from askloom.llm import secret_scan
from askloom.sources.storage import scratch_path

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?ai:password|passwd|secret|token|api_?key))")),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= (8, 16, 32)[k]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


TEXTS = [
    None, "", "nothing here", "password: hunter2hunter", "PassWord = 'abcdefgh'", "secret=token:abcdefghij", "token=short", "api_key=\"A.b-c_d/e+f=\"", "apikey  :   12345678", "paſsword: abcdefgh1",
    "toKen: abcdefgh1", "AKIA" + "Z" * 12, "AKIA" + "Z" * 11, "xAKIAAKIAAKIAAKIAx", "a" * 31, "a" * 32, "deadbeef" * 9 + "G" + "0" * 40, "\U0001f600 é token: abcdefgh \U0001f600 " + "f" * 33,
    "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----", "see https://me:hunter2@example.org/x and http://example.org:80/", "ghp_" + "a1Z" * 12, "xoxb-1234-abcdef", "AIza" + "x" * 35,
    "password:" * 3000, "secret=" + "x" * 200_000, "token" + " " * 50_000 + ":", "password: abcdefgh", "password: abcdefgh",
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "z", True) for i, t in enumerate(TEXTS)] + [(None, "token: 12345678", 1, "z", True)] * 2, "doc_id long, text string, n_hex int, blob string, suspect boolean")


def spans(row):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in row["spans"]]


def test_base_rules_equal_plain_expressions(spark, docs):
    rng = random.Random(5)
    alphabet = ["password", "Token", "SECRET", "api_key", "=", ":", " ", '"', "'", "abcdefgh", "12345678", "AKIA", "ABCDEF", "0af", "deadbeefdeadbeef", "x", "\n", "é", "ſ"]
    fuzz = [(1000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    versions = docs.select("doc_id", "text").union(spark.createDataFrame(fuzz, "doc_id long, text string"))
    got = secret_scan.secret_scan(versions, scratch_path(spark, "ledger")).collect()
    assert len(got) == len(TEXTS) + 2 + len(fuzz)
    texts = dict(enumerate(TEXTS)) | dict(fuzz) | {None: "token: 12345678"}
    for r in got:
        own = [s for s in spans(r) if s.split(":")[0] in BASE]
        assert own == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert r["blob"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).digest()


def test_added_rules(spark, docs):
    got = {r["doc_id"]: spans(r) for r in secret_scan.secret_scan(docs, scratch_path(spark, "ledger")).where("doc_id is not null").collect()}
    at = {t: i for i, t in enumerate(TEXTS)}
    assert got[at[TEXTS[18]]] == ["pem:0:31"] and [s.split(":")[0] for s in got[at[TEXTS[19]]]] == ["url"]
    assert got[at[TEXTS[20]]] == ["github:0:40"] and got[at[TEXTS[21]]] == ["slack:0:16"] and got[at[TEXTS[22]]] == ["google:0:39"]


def ledger_rows(spark, ledger):
    return spark.read.schema(secret_scan.LEDGER).parquet(ledger).collect()


def test_only_unseen_pairs_are_scanned(spark, docs):
    ledger, rules = scratch_path(spark, "ledger"), secret_scan.RULES
    first = secret_scan.secret_scan(docs, ledger)
    want, n = sorted((repr(tuple(r)) for r in first.collect())), len(ledger_rows(spark, ledger))
    assert n == len({t or "" for t in TEXTS}) + 1  # a row for each blob
    again = secret_scan.secret_scan(docs, ledger)
    assert sorted(repr(tuple(r)) for r in again.collect()) == want and len(ledger_rows(spark, ledger)) == n
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(77, "a newer version, token: 987654321"), (78, TEXTS[3])], "doc_id long, text string"))
    got = {r["doc_id"]: spans(r) for r in secret_scan.secret_scan(more, ledger).collect()}
    assert len(ledger_rows(spark, ledger)) == n + 1 and got[77] == ["assign:17:33"] and got[78] == got[3] == base_spans(TEXTS[3])
    # A changed rule is scanned over all blobs, alone, and its old findings are not reported.
    changed = tuple(replace(r, least=33, version=2) if r.kind == "hex" else r for r in rules)
    found = {r["doc_id"]: spans(r) for r in secret_scan.secret_scan(more, ledger, changed).collect()}
    fresh = [r for r in ledger_rows(spark, ledger) if r["rules"] == ["hex@2"]]
    assert len(fresh) == n + 1
    assert found[15] == [] and got[15] == ["hex:0:32"] and found[16] == got[16]
    assert {r["doc_id"]: spans(r) for r in secret_scan.secret_scan(more, ledger, rules).collect()} == got


def test_many_paths_and_versions_of_one_blob(spark):
    history = spark.range(6000).selectExpr("concat('dir/', id % 3000) as path", "id div 3000 as version", "if(id % 7 = 0, concat('old ', id), 'token: abcdefgh') as text")
    ledger = scratch_path(spark, "ledger")
    got = secret_scan.secret_scan(history, ledger, paths=("path", "version"))
    assert got.columns == ["path", "version", "blob", "spans"]
    rows = got.collect()
    assert len(rows) == 6000 and sum(bool(r["spans"]) for r in rows) == sum(i % 7 != 0 for i in range(6000))
    assert sum(r["blob"] == hashlib.sha256(b"token: abcdefgh").digest() for r in ledger_rows(spark, ledger)) == 1


def test_empty_table(spark, docs):
    assert secret_scan.secret_scan(docs.where("doc_id < 0"), scratch_path(spark, "ledger")).count() == 0
