"""Small fixtures, brute force and round trips for the ten operators, with their edge cases."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash

from askloom.llm import chat_format, decontamination, flac_media, language_id, license_scan, mixing, quality, queries, simhash, substring_dedup, token_output
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, copy int, row string"
ODD = ["", " \n\t", None, "one", "two words", "ÀÉ ß 你好", "\x00\x1c odd  nbsp", "x " * 3000, "%%% ### |||", "A" * 5000]


def table(spark, texts, ids=None, **more):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, more.get("lang"), more.get("source"), 0, 1, 2, "z") for i, t in zip(ids, texts)], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(4)]
    texts = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 150)))]
        if i % 3 == 0:
            parts.append(rng.choice(shared))
        if i % 5 == 0 and texts:
            parts = [rng.choice(texts)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    return texts


# Every query against its SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, same, name):
    same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLES[name]))


def test_operators_on_empty_tables(spark):
    none = table(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert substring_dedup.substring_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert language_id.language_id(none, language_id.fit(none)).count() == 0
    assert mixing.mix(none, {}).count() == 0
    assert token_output.token_output(none).count() == 0
    assert decontamination.decontamination_report(none, benchmark).count() == 0
    assert decontamination.decontamination_report(table(spark, ODD), benchmark).where("n_hit > 0 or n_items > 0 or contaminated").count() == 0
    assert chat_format.read_back(chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert flac_media.media_report(flac_media.text_media(none)).count() == 0
    assert quality.quality_scores(none, quality.fit(none, labels)).count() == 0
    assert license_scan.license_scan(none).count() == 0


# 1 Substring dedup


def brute_substrings(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,m,limit", [(50, 8, 48 << 20), (20, 3, 2000), (6, 6, 500)])
def test_substring_dedup_equals_brute_force(spark, window, m, limit):
    texts = corpus() + ODD + ["r " * 300, "r " * 200, corpus()[4]]
    rows = list(enumerate(texts)) + [(3, corpus()[0]), (None, corpus()[0]), (None, None), (3, corpus()[9]), (3, corpus()[0])]
    random.Random(2).shuffle(rows)
    got = substring_dedup.substring_dedup(table(spark, [t for _, t in rows], [i for i, _ in rows]), window, m, limit)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=repr) == brute_substrings(rows, window)


def test_oversized_buckets_are_dealt_anew():
    import pyarrow as pa

    rng = random.Random(8)
    hot = " ".join(f"hot{i}" for i in range(8))  # one phrase in many contexts
    texts = [" ".join(f"c{rng.randint(0, 900)}" for _ in range(30)) + f" {hot} " + " ".join(f"c{rng.randint(0, 900)}" for _ in range(30)) for _ in range(300)] + ["same " * 60] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([zlib.crc32(t.encode()) for t in texts]), pa.array(texts)], names=["doc_id", "mark", "text"])
    sent = next(substring_dedup._scatter(4, 20, 3)(iter([batch]))).sort_by("bucket")
    out = list(substring_dedup._gather(20, 3, 4000, 64)(iter([sent])))
    handed_on = sum(len(b) - b.column("blob").null_count for b in out)
    assert handed_on > 20
    again = pa.Table.from_batches(out).filter(pa.compute.is_valid(pa.Table.from_batches(out)["blob"])).select(["bucket", "blob"]).sort_by("bucket").combine_chunks().to_batches()
    spans = pa.Table.from_batches([*out, *substring_dedup._gather(20, 3, 4000, 0)(iter(again))]).to_pylist()
    lost = {r["doc"] for r in spans if r["blob"] is None}
    assert lost == set(range(301, 600))


def test_a_document_that_repeats_itself_is_held_once(spark, monkeypatch):
    """One window over and over in documents of their own: the last pass holds different windows only."""
    rng = random.Random(3)
    line = " ".join(f"w{i}" for i in range(6))
    texts = [" ".join([line] * 400), " ".join([line] * 300) + " own end", *(" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(5)), "z " * 3000, "z " * 2000]
    rows = list(enumerate(texts, 1)) + [(1, texts[0]), (1, "other words " + texts[0])]
    rng.shuffle(rows)
    got = substring_dedup.substring_dedup(table(spark, [t for _, t in rows], [i for i, _ in rows]), 6, 6, 300)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=repr) == brute_substrings(rows, 6)
    firsts = substring_dedup.Firsts(3)
    assert firsts.removed(2, 1000, b"a " * 1002) == [] and len(firsts.least) == 1
    assert firsts.removed(5, 4, b"x a a a a y ") == [(1, 3)] and firsts.removed(5, 1, b"x a a ") == [] and len(firsts.least) == 3


def hot_phrase(rng, n, length):
    """n texts with one phrase in contexts of their own."""
    hot = " ".join(f"hot{i}" for i in range(length))
    return [" ".join(f"c{rng.randint(0, 900)}" for _ in range(rng.randint(1, 9))) + f" {hot} " + " ".join(f"c{rng.randint(0, 900)}" for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("length", [10, 17, 19, 40])
def test_a_hot_phrase_is_cut_until_its_windows_fit(length, monkeypatch):
    import pyarrow as pa

    texts = hot_phrase(random.Random(length), 400, length)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array(texts)], names=["doc_id", "mark", "text"])
    sent = pa.Table.from_batches(list(substring_dedup._scatter(8, 20, 3)(batch.slice(a, 20) for a in range(0, 400, 20)))).sort_by("bucket").combine_chunks().to_batches()[0]
    limit, buckets, spans, most = 30_000, 8, [], []
    init = substring_dedup.Strings.__init__

    def kept(self):
        init(self)
        most.append(self)

    monkeypatch.setattr(substring_dedup.Strings, "__init__", kept)
    for seed, m in enumerate((3, 12, 20, 20), 1):
        most.clear()
        out = pa.Table.from_batches(list(substring_dedup._gather(20, m, limit, 0 if seed == 4 else buckets, seed)(iter([sent]))))
        spans += out.filter(pa.compute.is_null(out["blob"])).to_pylist()
        left = out.filter(pa.compute.is_valid(out["blob"]))
        assert max((x.size for x in most), default=0) < 1.5 * limit  # what a bucket holds, with a blob more
        if not left.num_rows:
            break
        buckets = max(8, 4 * 20 * pa.compute.sum(left["size"]).as_py() // limit)
        sent = left.select(["bucket", "blob"]).sort_by("bucket").combine_chunks().to_batches()[0]
    got = {(r["doc"], k) for r in spans for k in range(r["start"], r["end"])}
    first, want = {}, set()
    for i, t in enumerate(texts):
        w = words(t)
        for p in range(len(w) - 19):
            if first.setdefault(tuple(w[p : p + 20]), i) < i:
                want |= {(i, k) for k in range(p, p + 20)}
    assert got == want and (length < 19 or want)


def test_a_hot_phrase_equals_brute_force(spark):
    rng = random.Random(21)
    texts = hot_phrase(rng, 150, 18) + hot_phrase(rng, 50, 19)[:50] + hot_phrase(rng, 30, 60) + ["long " * 3000]
    rows = list(enumerate(texts))
    got = substring_dedup.substring_dedup(table(spark, texts), 20, 3, 3000, with_text=False)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_substrings(rows, 20)


def test_equal_hashes_alone_remove_nothing(monkeypatch):
    monkeypatch.setattr(substring_dedup, "chained", lambda values, n: np.zeros(len(values) - n + 1, np.uint64))
    data = b"a b c d a b c x a b c "
    removed = substring_dedup._removed_windows(np.array([1, 2, 3]), np.array([2, 2, 1]), b"a b c d a b c x a b c ", 3)
    assert removed.tolist() == [False, False, True, False, True] and data


# 2 SimHash


def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, tau):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= tau:
                parent[find(b)] = find(a)
    least = {}
    for f, i in zip(fps, ids):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for f in fps]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(4)
    texts = corpus(3, 40) + ODD
    long = " ".join(f"v{rng.randint(0, 3000)}" for _ in range(2500))
    near = [long.replace(" v7 ", " changed ", 1), long + " more", long.replace("v1", "V1")]
    texts += [long, *near]
    ids = [*range(len(texts))]
    ids[5] = None
    got = simhash.simhash_components(table(spark, texts, ids)).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = sorted(zip(ids, (f"{f:016x}" for f in fps), brute_components(fps, ids, 2)), key=repr)
    assert sorted([tuple(r) for r in got], key=repr) == want


def clustered(seed, n, centres):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    out = set()
    while len(out) < n:
        x = int(base[rng.integers(centres)])
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("tau,hot", [(2, 2048), (2, 4), (1, 2048), (3, 6)])
def test_links_and_components_of_clusters(spark, tau, hot):
    fps = clustered(tau, 300, 12)
    nodes = spark.createDataFrame([(simhash._signed(f), i) for i, f in enumerate(fps)], "fp long, least long")
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= tau}
    found = simhash.links(nodes, tau, hot)
    assert {tuple(r) for r in found.collect()} == want
    if want:
        roots = dict(map(tuple, simhash.least_labels(found).collect()))
        assert all(roots[a] == roots[b] <= min(a, b) for a, b in want)
        whole = brute_components(fps, fps, tau)
        assert len(set(roots.values())) == len({c for f, c in zip(fps, whole) if simhash._signed(f) in roots})


@pytest.mark.parametrize("thresholds", [[0, 0, 0], [1, -1, 0], [2, -1, -1], [-1, 1, 0]])
def test_any_allocation_finds_all_links(spark, thresholds):
    fps = clustered(8, 200, 6)
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    groups = [list(range(0, 20)), list(range(20, 45)), list(range(45, 64))]
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert {tuple(r) for r in simhash.links(nodes, 2, 2048, groups, thresholds).collect()} == want


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    roots = dict(map(tuple, simhash.least_labels(edges).collect()))
    assert set(roots.values()) == {0, 1000} and len(roots) == 203


def test_allocation():
    assert simhash.allocate([[0, 5, 50, 500]] * 3, 2)[1] in ([0, 0, 0],)
    cost, chosen = simhash.allocate([[0, 900, 950, 999], [0, 1, 2, 3], [0, 1, 9, 99]], 2)
    assert sum(chosen) == 0 and chosen[0] == -1 and cost == 3


# 3 Language


def test_language_id(spark, sf_dir):
    got = queries.QUERIES["op3_language_id"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) and (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.9 and both.score.between(0, 1).all()


def test_language_edges(spark):
    train = table(spark, ["the cat and the dog with the hat " * 9] * 6, lang="en").union(table(spark, ["der hund und die katze mit dem hut " * 9] * 6, lang="de"))
    net = language_id.fit(train)
    got = {r["doc_id"]: r for r in language_id.language_id(table(spark, ODD), net).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(len(ODD))] == [not any(c.isalpha() for c in t or "") for t in ODD]
    assert all(got[i]["score"] == 0 for i in got if got[i]["lang_pred"] == "und")
    assert language_id.fit(table(spark, ["a"])) is None
    assert {r["lang_pred"] for r in language_id.language_id(table(spark, ODD), None).collect()} == {"und"}


def small_net():
    x, owner, _ = language_id.training_windows([b"abc abd abe " * 30, b"xyz xyw xyv " * 30], [1, 2])
    return language_id.train(x, [["a", "b"][i] for i in owner], epochs=1)


def brute_language(net, text):
    """The mean over the windows, weighted by their bytes, one filter and one place after the other."""
    raw, total = (text or "").encode(), np.zeros(len(net.languages))
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    for a in range(0, len(raw), 256):
        window = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw[a : a + 256])
        e = [net.embed[b].astype(float) for b in window.ljust(256, b"\0")]
        hidden = []
        for w, kernel in net.filters.items():
            at = np.array([np.concatenate(e[i : i + w]) for i in range(257 - w)]) @ kernel.reshape(-1, kernel.shape[2]).astype(float)
            hidden += at.max(axis=0).tolist()
        z = np.maximum(np.array(hidden) + net.bias, 0) @ net.dense + net.dense_bias
        total += len(window) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return net.languages[int(total.argmax())], float(total.max() / len(raw))


def test_language_of_whole_texts_equals_brute_force(spark):
    net, rng = small_net(), random.Random(3)
    texts = corpus(4, 12) + ODD + ["½ Ⅷ ²", "½x", "中", "ª", "abc xyz " * 4000] + ["".join(rng.choice("abcxyz \u0300É") for _ in range(rng.randint(1, 900))) for _ in range(30)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[-1]), (3, texts[-1])]
    got = language_id.language_id(table(spark, [t for _, t in rows], [i for i, _ in rows]), net).collect()
    want = [(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, *brute_language(net, t)) for i, t in rows]
    key = lambda r: (repr(r[0]), r[2], round(r[3], 3))
    for mine, other in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert mine[:3] == other[:3] and abs(mine[3] - other[3]) < 1e-4


def test_three_hundred_languages_are_all_learned(spark):
    rng = random.Random(5)
    alphabets = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéèüñçåøß") for _ in range(5)) for _ in range(300)]
    rows = [(k * 10 + i, " ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(30)), f"l{k:03}") for k, a in enumerate(alphabets) for i in range(3)]
    rows += [(10_000 + i, "one language has most of the rows", "big") for i in range(3000)]
    assert language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=600).languages == ["big", *(f"l{k:03}" for k in range(300))]


def test_all_windows_of_a_training_text_may_be_drawn():
    text = b"".join(b"%255d|" % i for i in range(500)) + b"end"
    x, owner, drawn = language_id.training_windows([b"", text, b"a"], [1, 2, 3])
    assert len(x) == 502 and owner.tolist() == [1] * 501 + [2] and len(set(drawn.tolist())) == 502 and bytes(x[500]).rstrip(b"\0") == b"end"
    first = set(np.argsort(drawn[:501])[:50].tolist())
    assert max(first) > 300 and min(first) < 200  # drawn from all over the text


def test_every_language_is_learned_whatever_its_ids(spark):
    rows = [(i, f"the cat number {i} and the dog with the hat", "en") for i in range(3000)]
    for one in range(4):  # all rows of a language under one id, under none, or one text
        more = [(one, f"der hund nummer {i} und die katze mit dem hut", "de") for i in range(900)] + [(None, f"le chien {i} et le chat avec le chapeau", "fr") for i in range(700)] + [(i, "il cane e il gatto con il cappello", "it") for i in range(5000, 5000 + 700)]
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
        assert language_id.fit(docs).languages == ["de", "en", "fr", "it"]
    assert language_id.fit(docs, most_languages=2).languages == ["de", "en"]


def test_tables_equal_the_network():
    net = small_net()
    x, _, _ = language_id.windows([b"abc xyz " * 40])
    e = net.embed[x]
    pooled = [np.max(sum(e[:, j : x.shape[1] - w + 1 + j] @ net.filters[w][j] for j in range(w)), axis=1) for w in language_id.WIDTHS]
    want = language_id.softmax(np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.dense + net.dense_bias)
    assert np.allclose(language_id.Scorer(net).window_probabilities(x), want, atol=1e-4)


# 4 Mixing


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "small").alias("source"), F.lit("x").alias("copy"), F.lit("y").alias("POSITION"))
    got = mixing.mix(docs, {"big": 1.0, "small": 2.0, None: 1.0}, target=40000)
    assert got.columns == ["doc_id", "source", "copy", "POSITION", "copy_", "n_copies", "position_"]
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["big"] - 10000) < 400 and abs(counts["small"] - 20000) < 600 and abs(counts[None] - 10000) < 400
    per_doc = got.where("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"))
    assert per_doc.where("n <> m").count() == 0
    places = [r[0] for r in got.select("position_").collect()]
    assert places == sorted(places)
    plain = mixing.mix(docs, {"big": 1.0, "small": 2.0, None: 1.0}, target=40000, broadcast_sources=0)
    assert plain.exceptAll(got).count() == got.exceptAll(plain).count() == 0
    assert mixing.mix(docs, {"big": 0.0, "small": 0.0}, default_weight=0.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": -1.0})


def test_mixing_tells_rows_without_an_own_id_apart(spark):
    rows = [(None, f"null {i}", "few") for i in range(400)] + [(7, f"seven {i}", "few") for i in range(400)] + [(1000 + i, f"own {i}", "few") for i in range(400)]
    rows += [(5, "equal", "few")] * 2 + [(1000 + i, "other", "many") for i in range(0, 400, 2)] + [(10_000 + i, f"own {i}", "many") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for target in (500, 2402):  # rates of about 0.2 and 1 in the source few
        got = mixing.mix(docs, {"few": 1.0, "many": 1.0}, target=target)
        plain = mixing.mix(docs.repartition(3), {"few": 1.0, "many": 1.0}, target=target, broadcast_sources=0)
        assert plain.exceptAll(got).count() == got.exceptAll(plain).count() == 0
        drawn, rate = [tuple(r) for r in got.collect()], target / 2 / 1202
        for kind in ("null", "seven", "own"):
            mine = [r for r in drawn if r[1].startswith(kind) and r[2] == "few"]
            assert abs(len(mine) - 400 * rate) < 5 * (400 * rate) ** 0.5
            assert len({r[5] for r in mine}) == len(mine) and 0.3 < np.mean([r[5] for r in mine]) < 0.7
    # Of an id that one row has, the draw is that of the SQL, whatever the other rows are.
    alone = spark.createDataFrame([(i, "x", "many") for i in range(1000)], "doc_id long, text string, source string")
    mixed = alone.union(spark.createDataFrame([(None, f"{i}", "few") for i in range(500)] + [(-1, f"{i}", "few") for i in range(500)], alone.schema))
    own = {r["doc_id"]: r["n_copies"] for r in mixing.mix(alone, {}, target=1000).collect()}
    assert own == {r["doc_id"]: r["n_copies"] for r in mixing.mix(mixed, {}, target=2000).where("source = 'many'").collect()}


def test_mixing_draws_equal_rows_one_by_one(spark):
    """A third of all rows is one row, a third has no id at all."""
    equal = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("equal").alias("text"), F.lit("s").alias("source"))
    null = spark.range(100_000).select(F.lit(None).cast("long"), F.concat(F.lit("null "), "id"), F.lit("s"))
    docs = equal.union(null).union(spark.range(10, 100_010).select("id", F.lit("own"), F.lit("s")))
    got = mixing.mix(docs, {}, target=150_000)
    per_kind = {r["kind"]: r for r in got.withColumn("part", F.spark_partition_id()).groupBy(F.substring("text", 1, 4).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("position").alias("places"), F.countDistinct("part").alias("parts")).collect()}
    for kind in ("equa", "null", "own"):
        assert abs(per_kind[kind]["n"] - 50_000) < 1500 and per_kind[kind]["places"] == per_kind[kind]["n"] and per_kind[kind]["parts"] == 4
    again = mixing.mix(docs.repartition(7), {}, target=150_000)
    assert got.exceptAll(again).count() == again.exceptAll(got).count() == 0


def test_mixing_keeps_all_rows_that_text_forms_confuse(spark):
    """Rows without an id that differ in microseconds, bytes, map values, map keys or intervals only."""
    times = spark.range(1000).selectExpr("cast(null as long) doc_id", "'t' text", "'s' source", "timestamp_micros(1700000000000000 + id) odd")
    for odd in ("odd", "unhex(hex(cast(unix_micros(odd) as string)))", "map('k', odd, 'a', odd)", "map(unix_micros(odd) div 2, struct(odd))", "make_interval(0, 0, 0, 0, 0, 0, (unix_micros(odd) % 1000) / 1000000)", "array(map('k', odd))"):
        docs = times.selectExpr("doc_id", "text", "source", f"{odd} as odd")
        got = mixing.mix(docs, {}, target=20_000)
        assert got.select(F.col("odd").cast("string")).distinct().count() == 1000, odd
        assert 19_000 < got.count() < 21_000
    equal = spark.range(100_000).selectExpr("cast(null as long) doc_id", "'t' text", "'s' source", "map('a', 1, 'b', id % 2) odd")
    assert mixing.mix(equal, {}).groupBy(F.spark_partition_id()).count().count() == 4


def test_weight_zero_drops_a_source(spark):
    docs = spark.range(300).selectExpr("id doc_id", "'t' text", "concat('src', id % 3) source")
    assert {r["source"] for r in mixing.mix(docs, {"src1": 0.0}).select("source").distinct().collect()} == {"src0", "src2"}
    assert all(w > 0 for w in mixing.WEIGHTS.values())


def test_mixing_takes_many_sources_and_rates(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, F.col("id") % 300).alias("source"), F.lit("t").alias("text"))
    got = mixing.mix(docs, {i: float(i % 3) for i in range(300)} | {None: 600.0}, target=30_000)
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert all(counts.get(i, 0) == 0 for i in range(0, 300, 3)) and abs(counts[None] - 20_000) < 800 and abs(sum(counts.values()) - 30_000) < 1200


def test_poisson_steps(spark):
    from math import exp, factorial

    for rate in (0.3, 4.0, 900.0):
        steps = mixing.poisson_steps(spark.range(1).select(F.lit("s").alias("name"), F.lit(rate).alias("rate"))).first()["steps"]
        assert abs(steps[-1] - 1) < 1e-9
        if rate < 100:
            assert np.allclose(steps[:20], np.cumsum([exp(-rate) * rate**k / factorial(k) for k in range(20)]))


# 5 Token output


def brute_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(token_output.tokenizer_path()), 0, []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_tokens_round_trip(spark, tmp_path):
    texts = corpus(5, 30) + ODD + ["it's <|endoftext|> don't", "café—b!a İx 'tis"]
    docs = table(spark, texts)
    assert sorted(tuple(r) for r in token_output.token_output(docs).collect()) == brute_tokens(list(enumerate(texts)))
    token_output.write_tokens(docs, str(tmp_path / "f"), block_ids=100, stride=7)
    got = token_output.read_tokens(spark, str(tmp_path / "f"), with_ids=True).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == brute_tokens(list(enumerate(texts)))
    assert [zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got] == [r["ids_crc32"] for r in got]


@pytest.mark.parametrize("name,end_id", [("byte_bpe_50k.json", 50256), ("word_bpe_49k.json", None)])
def test_tokens_of_other_tokenizers(spark, tmp_path, name, end_id):
    from tokenizers import Tokenizer

    path = token_output.tokenizer_path(name)
    assert token_output.has_form(path) == (name == "word_bpe_49k.json")
    texts = corpus(5, 12) + ODD + ["It's CAPITAL <|endoftext|> don't", "café—b!a İx  'tis"]
    token_output.write_tokens(table(spark, texts), str(tmp_path / "f"), path=path, end_id=end_id, block_ids=300)
    got = token_output.read_tokens(spark, str(tmp_path / "f"), with_ids=True).orderBy("start", "doc_id").collect()
    tokenizer = Tokenizer.from_file(path)
    assert {r["doc_id"]: r["ids"] for r in got} == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id] * (end_id is not None) for i, t in enumerate(texts)}


def test_files_of_another_form_are_not_cut_into_pieces(tmp_path):
    import json

    whole = json.load(open(token_output.tokenizer_path(), encoding="utf-8"))
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [*whole["added_tokens"], whole["added_tokens"][0] | {"content": "[PAD]"}]}, {"model": whole["model"] | {"end_of_word_suffix": None}}):
        (tmp_path / "t.json").write_text(json.dumps(whole | change), encoding="utf-8")
        assert not token_output.has_form(str(tmp_path / "t.json"))


def test_tokens_of_null_and_repeated_ids(spark):
    got = token_output.token_output(table(spark, ["b", "a", "c", "a"], [1, None, 1, 1])).collect()
    assert sorted(r["start"] for r in got) == [0, 2, 4, 6] and [r["doc_id"] for r in got if r["start"] == 0] == [None]


def test_a_hot_id_is_spread_over_ranges(spark):
    ids = [7] * 300 + [None] * 200 + list(range(100))
    texts = ["copy"] * 200 + [f"text {i}" for i in range(400)]
    docs = table(spark, texts, ids)
    bounds = token_output._bounds(docs, 12)
    parts = docs.select("doc_id", "text").mapInArrow(token_output._squeezed(bounds), "doc_id long, body binary, part int")
    hot = {r["part"]: r["count"] for r in parts.where("doc_id = 7").groupBy("part").count().collect()}
    assert len(hot) >= 5 and max(hot.values()) < 100
    spans = parts.groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("a"), F.max(F.coalesce("doc_id", F.lit(-1))).alias("b")).orderBy("part").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:]))
    got = token_output.token_output(docs).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(ids, key=lambda i: -1 if i is None else i)
    assert all(y["start"] == x["start"] + x["n_tokens"] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("quantiles", [5, 1000])
def test_ranges_are_equal_in_bytes(spark, quantiles):
    ids = list(range(-300, 900, 3))
    texts = ["y" * (20_000 if 40 <= k < 80 else 100) for k in range(len(ids))]  # long texts at neighbouring ids
    bounds = token_output._bounds(table(spark, texts, ids), 8, quantiles=quantiles)
    sizes = np.bincount(np.searchsorted(bounds, ids), weights=[len(t) for t in texts], minlength=8)
    assert len(bounds) == 7 and (np.diff(bounds) >= 0).all() and sizes.max() < 1.6 * sizes.sum() / 8
    assert not len(token_output._bounds(table(spark, []), 8)) and not len(token_output._bounds(table(spark, texts[:2]), 1))


@pytest.mark.parametrize("n,limit", [(1, 18), (2, 18), (3, 2), (200, 9), (5000, 18), (70000, 18)])
def test_huffman(n, limit):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.8, n) * 10).astype(np.int64) + (rng.random(n) < 0.9)
    counts[0] += 1
    lengths = token_output.limited_lengths(counts, limit)
    used = lengths > 0
    assert (used == (counts > 0)).all() and lengths.max() <= max(limit, int(np.ceil(np.log2(used.sum()))))
    assert used.sum() == 1 or np.ldexp(1.0, -lengths[used].astype(int)).sum() == 1.0
    code = token_output.Huffman(lengths)
    for size in (1, 5, 128, 129, 3000):
        ids = rng.choice(np.flatnonzero(used), size)
        payload, offsets = code.encode(ids)
        assert (code.decode(payload, offsets, size) == ids).all()
        some = len(offsets) // 2  # a reader may start at any checkpoint
        assert (code.decode(payload, offsets[some:], size - some * token_output.STRIDE) == ids[some * token_output.STRIDE :]).all()


def test_lengths_are_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert (counts * token_output.limited_lengths(counts, 18)).sum() == 132  # the plain Huffman cost
    limited = token_output.limited_lengths(counts, 4)
    assert limited.max() == 4 and (counts * limited).sum() == min(
        sum(c * x for c, x in zip(sorted(counts, reverse=True), shape)) for shape in ([1, 3, 3, 4, 4, 4, 4, 4][:8], [2, 2, 3, 3, 4, 4, 4, 4], [2, 2, 2, 4, 4, 4, 4, 9], [1, 2, 4, 4, 4, 4, 9, 9]) if sum(2.0**-x for x in shape) <= 1
    )


# 6 Decontamination


def brute_contamination(docs, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = split(t)
        size = min(window, len(w))
        for p in range(len(w) - size + 1) if size and i is not None else ():
            grams.setdefault(tuple(w[p : p + size]), set()).add(i)
    out = []
    for d, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for size in {len(g) for g in grams}:
            for p in range(len(w) - size + 1):
                if (g := tuple(w[p : p + size])) in grams:
                    hit |= set(range(p, p + size))
                    ids |= grams[g]
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4_000_000, 200, 30])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 30)))) for i in range(25)]
    items += [(25, "a1"), (26, "b2 C3"), (27, None), (28, items[0][1]), (None, "c4"), (29, ""), (5, "d5 é6 d5")]
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [f"{texts[3]}, {items[k][1]}! {texts[4]}".upper() for k in range(20)] + ODD + ["d5-É6? d5 é6 d5", items[7][1]]
    rows = list(enumerate(texts)) + [(2, texts[45]), (None, texts[46]), (2, texts[45])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows])
    got = decontamination.decontamination_report(docs, benchmark, block_words=block)
    want = brute_contamination(rows, items)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want
    kept = decontamination.without_contaminated(docs, benchmark, block_words=block)
    assert kept.columns == docs.columns and sorted([r["doc_id"] for r in kept.collect()], key=repr) == sorted([w[0] for w in want if not w[5]], key=repr)


def test_blocks_of_items(spark):
    rng = random.Random(12)
    long = [f"x{rng.randint(0, 5000)}" for _ in range(3000)]
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, "a b c"), (3, " ".join(long[:5])), (4, None), (None, "z")], "item_id long, text string")
    blocks = decontamination.Blocks(benchmark, 13, 400)
    rows = [x for k in range(blocks.n) for x in blocks[k]]
    assert 8 < blocks.n < 40 and max(sum(len(t.split()) for _, t in blocks[k]) for k in range(blocks.n)) < 1600
    pieces = [t.decode().split() for i, t in rows if i == 1]
    windows = {tuple(p[a : a + 13]) for p in pieces for a in range(len(p) - 12)}
    assert windows == {tuple(long[a : a + 13]) for a in range(len(long) - 12)} and max(map(len, pieces)) <= 26
    assert sorted(t for i, t in rows if i != 1) == [b"a b c ", " ".join([*long[:5], ""]).encode()]
    # A document that holds a stretch of the long item over several pieces and blocks is hit as a whole.
    docs = table(spark, ["before " + " ".join(long[100:1100]) + " after", " ".join(long[7:20]), " ".join(long[7:19])])
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.decontamination_report(docs, benchmark, block_words=400).collect()}
    assert got == {0: (1002, 1000, 1), 1: (13, 13, 1), 2: (12, 0, 0)}


def test_repeated_items_cost_no_more_than_one(spark):
    body = " ".join(f"k{j}" for j in range(100))
    docs = table(spark, ["x " + body + " y", " ".join(body.split()[10:23]), "nothing"])
    ids = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit(body).alias("text"))
    blocks = decontamination.Blocks(ids, 13)
    assert blocks.n == 1 and len({b for b, _ in blocks.bodies(0)}) == 1 and len(blocks[0]) == 100_000
    for benchmark, n in ((ids, 100_000), (ids.select(F.lit(7).cast("long").alias("item_id"), "text"), 1)):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontamination.decontamination_report(docs, benchmark).collect()}
        assert got == {0: (100, n), 1: (13, n), 2: (0, 0)}
    few = decontamination.Blocks(ids.limit(20_000), 13, 10_000)
    sizes = [sum(len(b.split()) + len(i) for b, i in few.bodies(k)) for k in range(few.n)]
    assert min(sizes) > 0 and max(sizes) < 12_000 and sum(len(few[k]) for k in range(few.n)) == 20_000


def test_blocks_share_scans(spark):
    rng = random.Random(9)
    items = [(i % 50, " ".join(f"v{rng.randint(0, 300)}" for _ in range(20))) for i in range(100)] + [(None, "v1 v2")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, [" ".join(f"v{rng.randint(0, 300)}" for _ in range(30)) + " " + rng.choice(items)[1] for _ in range(60)])
    blocks = decontamination.Blocks(benchmark, 13, 120)
    assert all(blocks.bodies(k) for k in range(blocks.n)) and blocks.n > 2 * decontamination.CHAIN
    got = decontamination.hits(docs, blocks, F.col("doc_id")).drop("key")
    assert blocks.scans == 2 * -(-blocks.n // decontamination.CHAIN)
    one = decontamination.hits(docs, decontamination.Blocks(benchmark, 13), F.col("doc_id")).drop("key")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, one.collect()))


def test_several_blocks_equal_one_on_many_equal_rows(spark):
    items = [(i, " ".join(f"k{i}x{j}" for j in range(20))) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hot = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(f"{items[0][1]} and {items[3][1]}").alias("text"))
    docs = hot.union(spark.range(500).select("id", F.lit("nothing of theirs")))
    one, several = (decontamination.decontamination_report(docs, benchmark, block_words=b) for b in (500_000, 40))
    assert sorted(map(repr, several.groupBy(*several.columns).count().collect())) == sorted(map(repr, one.groupBy(*one.columns).count().collect()))
    assert several.where("contaminated and n_hit = 40 and n_items = 2").count() == 100_000
    assert decontamination.without_contaminated(docs, benchmark, block_words=40).count() == 500


def test_items_without_an_id_are_hit_as_in_the_sql(spark, tmp_path, same):
    import duckdb

    import corpus_pipeline

    rng = random.Random(16)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(20)) for _ in range(6)]
    items = [(0, passages[0]), (None, passages[1]), (None, passages[2]), (3, passages[3]), (None, passages[3]), (None, None), (None, "")]
    texts = [f"some words, {p}, more words" for p in passages] + [f"{passages[1]} {passages[2]} {passages[0]}", None, "x"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = duck.sql(decontamination.OP6_SQL)
    same(decontamination.op6_benchmark_decontamination(spark, str(tmp_path)), want)
    same(decontamination.decontamination_report(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=20, unnamed=True), want)
    for kept in (corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)), decontamination.without_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=20, unnamed=True)):
        assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 7, 8]


# 7 Chat


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "[", "<", "/", "s>", "INST]", "\n", " ", "a", "é", "$1", "\U0001f600"]
    rows = [(i, t, rng.choice(["user", "assistant", "sys\ntem", "[INST]", "a%0Ab", None]), rng.choice([None] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(9)])) for i in range(300) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "x"), (1, 0, "user", "again"), (400, None, "assistant", "late" * 20000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.format_conversations(df)
    back = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    said = {}
    for c, t, r, x in rows:
        said.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(back) == set(said)
    for c, turns in said.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [x[1:] for x in sorted(turns)]
        assert back[c]["loss_text"] == "".join(x for _, r, x in sorted(turns) if r == "assistant")
    assert 0 < made.where("escaped").count() < made.count()
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_only_turns_in_conflict_are_escaped(spark):
    rows = [(1, 0, "user", "[/INST] and <s>"), (1, 1, "assistant", "[/INST] and <s>"), (1, 2, "user", r"[\\INST]"), (2, 0, "user", "</s>"), (2, 1, "assistant", "</s>"), (2, 2, "user", "</s>")]
    made = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: (r["formatted"], r["escaped"]) for r in made.collect()}
    assert got[1] == ("[INST]user\n[\\/INST] and <\\s>[/INST]<s>assistant\n[/INST] and <s></s>[INST]user\n[\\\\\\INST][/INST]", True)
    assert got[2] == ("[INST]user\n</s>[/INST]<s>assistant\n<\\/s></s>[INST]user\n</s>[/INST]", True)


def test_a_changed_conversation_raises(spark):
    turns = F.array(F.struct(F.lit("user").alias("role"), F.lit("a").alias("text")))
    form = "[INST]user\na[/INST]"
    good, *bad = (spark.range(1).select(chat_format.verified(F.lit(x), turns).alias("x")) for x in (form, form.replace("a[", "b["), form * 2, "", form[:-1]))
    assert good.first()["x"] == form
    for df in bad:
        with pytest.raises(Exception, match="does not parse to its turns"):
            df.collect()


# 8 FLAC


def test_flac_round_trip():
    rng = np.random.default_rng(1)
    slow = (128 + 100 * np.sin(np.arange(9000) / 40)).astype(np.uint8).tobytes()
    payloads = [b" " * 192, bytes(range(256)) * 3, b"\xff" * 5, b"\x00\xff" * 700, b"a", rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), slow, b"plain text, twice. " * 300]
    streams = flac_media.encode(payloads)
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac_media.decode(streams)] == payloads
    assert len(streams[6]) < len(slow) // 2 and streams == flac_media.encode(payloads)
    offset, block = flac_media.seek(streams[6], 5000)
    assert offset == 5000 // 1152 * 1152 and ((block + 128) == np.frombuffer(slow, np.uint8)[offset : offset + 1152]).all()
    kinds = {int(s[a]) for s in streams for a in [flac_media.stream_info(s)[2] + 6]}
    assert len(kinds) > 2
    # Without its seek table a stream is read frame by frame.
    s = streams[6]
    bare = s[:4] + b"\x80" + s[5:42] + s[flac_media.stream_info(s)[2] :]
    assert flac_media.decode([bare])[0].tolist() == flac_media.decode([s])[0].tolist()


@pytest.mark.parametrize("place", [-1, -40, 45])
def test_damage_is_found(place):
    stream = bytearray(flac_media.encode([b"some text that is long enough " * 90])[0])
    stream[place if place < 0 else flac_media.stream_info(bytes(stream))[2] + 2] ^= 1
    with pytest.raises(ValueError, match="FLAC"):
        flac_media.decode([bytes(stream)])


def frame(bits, n, code=None):
    """A frame of n 8-bit samples from the bits of its subframe."""
    head = bytes([0xFF, 0xF8, 7 << 4, 1 << 1, 0]) + (n - 1).to_bytes(2, "big")
    head += bytes([int(flac_media._crc8(np.frombuffer(head, np.uint8)[None].astype(np.int64), np.array([len(head)]))[0])])
    body = head + int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")
    crc = int(flac_media.crc16(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
    return body + crc.to_bytes(2, "big")


def test_decoder_of_parts_that_the_encoder_does_not_use():
    def decoded(bits, n):
        data = np.frombuffer(frame(bits, n), np.uint8)
        return flac_media.decode_frames(data, flac_media.Bits(data), np.array([0]))[0][0].tolist()

    b = lambda x, n: format(x & (1 << n) - 1, f"0{n}b")
    rice = lambda v, k: "0" * ((u := v * 2 if v >= 0 else -2 * v - 1) >> k) + "1" + (b(u, k) if k else "")
    # Fixed order 3, two partitions: Rice parameter 0, then an escape with 4-bit samples.
    samples = [1, 3, 7, 12, 20, 28, 33, 41]
    third = np.diff(samples, 3).tolist()
    bits = "0" + b(11, 6) + "0" + "".join(b(x, 8) for x in samples[:3]) + "00" + b(1, 4) + b(0, 4) + rice(third[0], 0) + b(15, 4) + b(5, 5) + "".join(b(x, 5) for x in third[1:])
    assert decoded(bits, 8) == samples
    # Five-bit parameters, wasted bits, a long unary run.
    bits = "0" + b(8, 6) + "1" + "01" + "01" + b(0, 4) + b(0, 5) + rice(30, 0) + rice(-20, 0) + rice(0, 0) + rice(5, 0)
    assert decoded(bits, 4) == [120, -80, 0, 20]
    # A linear predictor of order 2 with a shift: x[i] = (3 x[i-1] - x[i-2]) >> 1 + residual.
    want = [4, 6]
    for r in (1, -2, 0):
        want.append(((3 * want[-1] - want[-2]) >> 1) + r)
    bits = "0" + b(33, 6) + "0" + b(4, 8) + b(6, 8) + b(3, 4) + b(1, 5) + b(3, 4) + b(-1, 4) + "00" + b(0, 4) + b(1, 4) + rice(1, 1) + rice(-2, 1) + rice(0, 1)
    assert decoded(bits, 5) == want


def test_crc_values():
    data = np.frombuffer(b"123456789", np.uint8)
    assert flac_media.crc16(data, np.array([0]), np.array([9]))[0] == 0xFEE8  # CRC-16/UMTS
    assert flac_media._crc8(data[None].astype(np.int64), np.array([9]))[0] == 0xF4  # CRC-8


def test_media_columns(spark):
    texts = ODD + ["same", "same"]
    media = flac_media.text_media(table(spark, texts))
    report = {r["doc_id"]: r for r in flac_media.media_report(media).collect()}
    for i, t in enumerate(texts):
        want = flac_media.payload((t or "").encode())
        assert len(want) % 192 == 0 and len(want) > 0
        assert (report[i]["n_bytes"], report[i]["payload_bytes"], report[i]["payload_sha256"], report[i]["tail_crc32"]) == (len((t or "").encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        x = [b - 128 for b in want]
        n = len(x)
        told = dict(part.split("=") for part in report[i]["feature"].split(";"))
        assert told == {
            "mean": f"{sum(x) / n:.4f}", "rms": f"{(sum(v * v for v in x) / n) ** 0.5:.4f}", "peak": str(max(map(abs, x))), "crossings": f"{sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])) / n:.4f}",
            "still": f"{sum(a == b for a, b in zip(x, x[1:])) / n:.4f}", "blocks": str(-(-n // 1152)),
        }
        stream = next(r["media"] for r in media.where(F.col("doc_id") == i).collect())
        assert (report[i]["media_bytes"], report[i]["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest()) and stream[:4] == b"fLaC"
    assert tuple(report[len(ODD)])[1:] == tuple(report[len(ODD) + 1])[1:]
    pcm = flac_media.Pcm.of(stream := flac_media.encode([flac_media.payload(b"0123456789" * 500)])[0], flac_media.decode([stream])[0])
    assert all((pcm.read(a, b) + 128).astype(np.uint8).tobytes() == flac_media.payload(b"0123456789" * 500)[a:b] for a, b in ((0, 5184), (1151, 1153), (1152, 1152), (5000, 5184), (2303, 4609)))
    blocks = flac_media.pcm_blocks(media).where("doc_id = 7").orderBy("block").collect()
    assert [r["sample_offset"] for r in blocks] == list(range(0, sum(r["n_samples"] for r in blocks), 1152))
    assert bytes((np.frombuffer(b"".join(r["pcm"] for r in blocks), np.int8).astype(np.int64) + 128).astype(np.uint8)) == flac_media.payload(texts[7].encode())


# 9 Quality


def test_sum_of_squares_identity():
    texts = [b"one two three two", b"FOUR!! five", b""]
    rng = np.random.default_rng(0)
    text, at, weight, dense = quality.features(texts)
    m = quality.Machine(0.3, rng.normal(size=quality.BUCKETS + dense.shape[1]), rng.normal(0, 0.3, (quality.BUCKETS + dense.shape[1], 4)), dense.mean(axis=0), np.ones(dense.shape[1]))
    got = quality._margins(m, text, at, weight, dense)
    for i in range(len(texts)):
        x = np.zeros(quality.BUCKETS + dense.shape[1])
        np.add.at(x, at[text == i], weight[text == i])
        x[quality.BUCKETS :] = dense[i] - m.mean
        some = np.flatnonzero(x)
        pairs = sum(m.factors[a] @ m.factors[b] * x[a] * x[b] for k, a in enumerate(some) for b in some[k + 1 :])
        assert np.isclose(got[i], m.bias + m.linear @ x + pairs)


def test_quality_learns_and_handles_edges(spark):
    good = [f"A calm sentence number {i} about ordinary things. Nothing odd." for i in range(60)]
    bad = [f"BUY!! NOW!! {i} $$$ ### CHEAP!! %%%" for i in range(60)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    got = quality.quality_scores(docs, machine).toPandas()
    held = got[got.held_out]
    assert len(held) > 15 and (held.predicted == (held.doc_id < 60)).mean() > 0.9
    edges = quality.quality_scores(table(spark, ODD, [None, *range(1, len(ODD))]), machine).toPandas()
    assert len(edges) == len(ODD) and edges.score.between(0, 1).all() and not edges[edges.doc_id.isna()].held_out.any()
    assert set(quality.quality_scores(docs, None).toPandas().score) == {0.5} and quality.accepted(docs, None).count() == 120
    kept = quality.accepted(docs, machine)
    assert kept.columns == docs.columns and kept.count() == int(got.predicted.sum())


def test_quality_takes_metadata(spark):
    docs = spark.createDataFrame([(i, "the same text", f"from {i % 2}" if i else None) for i in range(120)], "doc_id long, text string, origin string")
    docs = docs.union(docs.where("doc_id = 5"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    machine = quality.fit(docs, labels, metadata=("origin",))
    got = quality.quality_scores(docs, machine).where("doc_id > 0").toPandas()
    assert (got.predicted == got.doc_id % 2).all() and len(got) == 120
    assert {r["origin"] for r in quality.accepted(docs.where("doc_id > 0"), machine).collect()} == {"from 1"}
    with pytest.raises(ValueError):
        quality.fit(docs, labels, metadata=("doc_id",))


def brute_quality(machine, text, metadata):
    """Its features one by one, and the sum over all pairs of them."""
    raw = (text or "").encode()
    x = np.zeros(len(machine.linear))
    said = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    times = {w: said.count(w) for w in set(said)}
    place = lambda b: xxhash.xxh32_intdigest(b) % quality.BUCKETS  # noqa: E731  a word is hashed with the space after it
    for w, n in times.items():
        x[place(w + b" ")] += (n / len(said)) ** 0.5
    held = [f"{k}={v}" for k, v in metadata.items() if v is not None]
    for m in held:
        x[place(m)] += 1
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b > 127 else 5 if b in b" \t\r\x0b\x0c" else 6 if b == 10 else 7 if b in b".,;:?!'\"()-" else 0
    kinds, n = np.bincount([kind(b) for b in raw], minlength=8), max(len(said), 1)
    again = sum(a == b for a, b in zip(said, said[1:]))
    ends = [w[-1] for w in said]
    structure = [*kinds / max(len(raw), 1), sum(kind(b) == 0 for b in ends) / n, ends.count(33) / n, len(times) / n, max(times.values(), default=0) / n, again / n, np.log1p(again) / 5, sum(map(len, said)) / n / 10]
    structure += [np.log1p(len(said)) / 10, np.log1p(len(raw)) / 10, np.log1p(len(said) / (kinds[6] + 1)) / 5, kinds[1] / max(kinds[1] + kinds[2], 1), not said]
    x[quality.BUCKETS :] = (np.array(structure, float) - machine.mean) / machine.scale
    # Features that hash to one place are features of their own: their product is a pair as well.
    parts = [(place(w + b" "), (times[w] / len(said)) ** 0.5) for w in times] + [(place(m), 1.0) for m in held]
    parts += [(quality.BUCKETS + i, v) for i, v in enumerate(x[quality.BUCKETS :])]
    z = machine.bias + machine.linear @ x + sum(machine.factors[a] @ machine.factors[b] * u * v for k, (a, u) in enumerate(parts) for b, v in parts[k + 1 :])
    return 1 / (1 + np.exp(-z))


def test_quality_of_whole_texts_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [t for t in corpus(6, 40)] + ODD[:7] + ["x y " * 700, "WOW!! wow!! " * 30]
    rows = [(i, t, None if i % 7 == 0 else len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(None, "no id", 5), (3, texts[0], 9), (3, texts[0], 9)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, rng.randint(0, 1)) for i in range(40)] + [(1, 7), (2, -1), (3, None)], "doc_id long, quality int")
    machine = quality.fit(docs, labels, metadata=("n_chars",))
    got = sorted(((r["doc_id"], r["score"], r["predicted"]) for r in quality.quality_scores(docs, machine).collect()), key=lambda r: (repr(r[0]), r[1]))
    value = lambda n: None if n is None else str(round(2 * np.log2(1 + n)))
    want = sorted(((r["doc_id"], brute_quality(machine, r["text"], {"n_chars": value(r["n_chars"])})) for r in docs.collect()), key=lambda r: (repr(r[0]), r[1]))
    for (i, score, predicted), (j, other) in zip(got, want, strict=True):
        assert i == j and abs(score - other) < 1e-6 and predicted == int(score >= 0.7)
    assert sorted((r["doc_id"] for r in quality.accepted(docs, machine).collect()), key=repr) == [i for i, _, p in got if p]
    # The threshold itself is passed, and labels other than 0 and 1 are as if they were not there.
    at = got[5][1]
    assert quality.quality_scores(docs, machine, at).where(F.col("score") == at).first()["predicted"] == 1
    same = quality.fit(docs, labels.where("quality in (0, 1)"), metadata=("n_chars",))
    assert (same.factors == machine.factors).all() and same.bias == machine.bias


def test_quality_learns_from_the_most_common_words_of_a_text(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k} " * (k % 3 + 1) for k in range(300))) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    few, all_ = quality.fit(docs, labels, words_a_text=50), quality.fit(docs, labels, words_a_text=10_000)
    assert (few.linear[: quality.BUCKETS] != 0).sum() <= 50 and (all_.linear[: quality.BUCKETS] != 0).sum() > 250


def test_quality_on_held_out(spark, sf_dir):
    got = queries.QUERIES["op9_quality_classifier"](spark, sf_dir.replace("0.001", "0.01")).toPandas()
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() > 0.9


# 10 Licences


def test_license_rules(spark):
    bsd = [license_scan.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    cases = {
        "Released under the MIT License.": (1, "MIT"),
        "text before.\nLICENSED  under CC BY-NC 4.0.\nafter": (1, "CC-BY-NC-4.0"),
        "\n".join(bsd): (1, "BSD-2-Clause"),
        "\n".join([*bsd, "Something else.", license_scan.SENTENCES["bsd-names"]]): (1, "BSD-3-Clause"),
        "\n".join([bsd[1], bsd[0]]): (0, ""),
        " ".join([license_scan.SENTENCES["mit-grant"] + "\n", license_scan.SENTENCES["mit-notice"], "Licensed under Apache 2.0."]): (2, "Apache-2.0,MIT"),
        "I like the MIT License a lot.": (0, ""),
        "Released under GPLv3. Released under GPLv3.": (2, "GPL-3.0"),
        "SPDX-License-Identifier: ISC": (1, "ISC"),
    }
    texts = list(cases) + ODD
    got = {r["doc_id"]: r for r in license_scan.license_scan(table(spark, texts)).collect()}
    assert [(got[i]["n_notices"], got[i]["licences"]) for i in range(len(cases))] == list(cases.values())
    assert all(got[i]["n_notices"] == 0 for i in range(len(cases), len(texts)))


def licences_of(spark, texts):
    got = {r["doc_id"]: r for r in license_scan.license_scan(table(spark, texts)).collect()}
    return [(got[i]["n_notices"], got[i]["licences"]) for i in range(len(texts))]


def test_wrapped_licence_texts(spark):
    import textwrap

    s = license_scan.SENTENCES
    bsd = ["Copyright (c) 2020, Some Body", s["bsd-grant"], "1. " + s["bsd-source"], "2. " + s["bsd-binary"], "3. " + s["bsd-names"]]
    apache = s["apache-header"] + " you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    long = {
        "MIT": ["MIT License", "Copyright (c) 2020 Some Body", s["mit-grant"], s["mit-notice"]],
        "BSD-3-Clause": bsd,
        "BSD-2-Clause": bsd[:-1],
        "GPL-3.0-or-later": [s["gpl-free"], s["gpl-hope"] + "  See the GNU General Public License for more details."],
        "Apache-2.0": ["Copyright 2020 Some Body", apache],
        "ISC": [s["isc-grant"]],
        "GPL-3.0": ["Some words. Licensed under the GNU General Public License, version 3. More words follow here, as they do."],
    }
    cases = []
    for licence, paragraphs in long.items():
        for width in (20, 60, 72, 10_000):
            for first, prefix, newline in (("", "", "\n"), ("/* ", " * ", "\n"), ("// ", "// ", "\r\n"), ("dnl ", "dnl ", "\n"), ("    ", "\t", "\r")):
                lines = [x for p in paragraphs for x in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
                cases.append((licence, newline.join((prefix if i else first) + x for i, x in enumerate(lines))))
    cases += [("MIT", " ".join(long["MIT"][2:])), ("BSD-2-Clause", " ".join(bsd[1:4]).replace("1.", "1)").replace("2.", "(2)"))]
    assert licences_of(spark, [t for _, t in cases]) == [(1, licence) for licence, _ in cases]
    none = ["Licensed under\n\nthe MIT License.", "Licensed under the\n *\n * MIT License.", "Licensed under.\nthe MIT License.", "is Licensed under the\nMIT License."]
    assert licences_of(spark, none) == [(0, "")] * len(none)
    assert licences_of(spark, ["Licensed under CC0\n1.0.", "Licensed under MIT\nReleased under MIT"]) == [(1, "CC0-1.0"), (2, "MIT")]


def test_every_known_licence_sentence_is_found(spark):
    names = [(licence, notice.format(name)) for licence, its in license_scan.NAMES.items() for name in its for notice in license_scan.NOTICES]
    assert licences_of(spark, [t for _, t in names]) == [(1, licence) for licence, _ in names]
    assert licences_of(spark, [f"Before. {t.replace(' ', chr(10) + ' * ')} After." for _, t in names]) == [(1, licence) for licence, _ in names]
    texts = list(license_scan.SENTENCES.values())
    got = {r["doc_id"]: r["sentence_ids"] for r in license_scan.license_scan(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [f"<{k}>" for k in license_scan.SENTENCES]
    mpl = ["This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed", "Licensed under the Mozilla Public License, v.\n2.0.", "Licensed under the Mozilla Public License, v.\n\n2.0."]
    assert licences_of(spark, mpl) == [(1, "MPL-2.0"), (1, "MPL-2.0"), (0, "")]


#: Headers and texts as files hold them, written down apart from the operator's own sentences.
FILES = {
    "MIT": """/*
 * The MIT License (MIT)
 *
 * Copyright (c) 2015 Jane Roe
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in
 * all copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
 * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
 * AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
 * LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
 * OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
 * THE SOFTWARE.
 */
int main() { return 0; }""",
    "BSD-3-Clause": """# Copyright 2009 The Some Authors. All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:
#
#    * Redistributions of source code must retain the above copyright
# notice, this list of conditions and the following disclaimer.
#    * Redistributions in binary form must reproduce the above
# copyright notice, this list of conditions and the following disclaimer
# in the documentation and/or other materials provided with the
# distribution.
#    * Neither the name of the copyright holder nor the names of its
# contributors may be used to endorse or promote products derived from
# this software without specific prior written permission.
#
# THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
# "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
# LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
# A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
    "ISC": """; Copyright (c) 2011, A. Person
;
; Permission to use, copy, modify, and/or distribute this software for any
; purpose with or without fee is hereby granted, provided that the above
; copyright notice and this permission notice appear in all copies.
;
; THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
; WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
; MERCHANTABILITY AND FITNESS.""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.""",
    "GPL-2.0-or-later": """/* This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */""",
    "GPL-2.0-only": """    This file is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; version 2 of the License.""",
    "GPL-3.0-or-later": """dnl This program is free software: you can redistribute it and/or modify
dnl it under the terms of the GNU General Public License as published by
dnl the Free Software Foundation, either version 3 of the License, or
dnl (at your option) any later version.""",
    "LGPL-2.1-or-later": """   This library is free software; you can redistribute it and/or
   modify it under the terms of the GNU Lesser General Public
   License as published by the Free Software Foundation; either
   version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0-only": """# It is free software: you can redistribute it and/or modify it under the terms of
# the GNU Lesser General Public License as published by the Free Software
# Foundation, version 3 of the License.""",
    "AGPL-3.0-or-later": """-- This program is free software: you can redistribute it and/or modify
-- it under the terms of the GNU Affero General Public License as
-- published by the Free Software Foundation, either version 3 of the
-- License, or (at your option) any later version.""",
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.""",
    "GPL-2.0": """  The licenses for most software are designed to take away your
freedom to share and change it.  By contrast, the GNU General Public
License is intended to guarantee your freedom to share and change free
software--to make sure the software is free for all its users.""",
    "MPL-2.0": """<!-- This Source Code Form is subject to the terms of the Mozilla Public
   - License, v. 2.0. If a copy of the MPL was not distributed with this
   - file, You can obtain one at https://mozilla.org/MPL/2.0/. -->""",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 3.0 Unported License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "Zlib": """  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:""",
    "Apache-2.0,MIT": "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}",
    "GPL-2.0-or-later,LGPL-2.1-only,MIT": "/* SPDX-License-Identifier: ((GPL-2.0+ WITH Linux-syscall-note) OR MIT) AND LGPL-2.1-only */",
}


def test_licences_of_real_files(spark, tmp_path, same):
    import duckdb

    texts = list(FILES.values())
    found = licences_of(spark, texts + [t.replace("\n", "\r\n") for t in texts])
    assert [x for _, x in found] == list(FILES) * 2
    assert [n for n, _ in found] == [1] * 18 + [2, 3] + [1] * 18 + [2, 3]
    # Each known sentence on one line of its own: as the SQL has it.
    lines = [k.decode().replace("orlater", "or later") for k in license_scan.known_sentences()] + ["SPDX-License-Identifier: GPL-2.0+ or bad AND (mit)", "spdx license identifier: with mit", "SPDX-License-Identifier:"]
    docs = table(spark, lines + ["\n".join(lines[a : a + 9]) for a in range(0, len(lines), 5)] + ["\n\n".join(lines)] + ODD)
    docs.write.parquet(f"{tmp_path}/documents")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    same(license_scan.license_scan(docs), duck.sql(license_scan.OP10_SQL))


NAMED = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Texts as projects have them, written apart from the operator's tables.
HOLED_FILES = [
    ("BSD-3-Clause", "{bsd}3. " + NAMED.format("Google Inc. and J. Q. Public") + "\n\n{as_is}"),
    ("BSD-3-Clause", "{bsd}* " + NAMED.format("the University of Somewhere, Elsewhere") + "\n{as_is}"),
    ("BSD-3-Clause", "{bsd}3. The name of Jane Public may not be used to endorse or promote products derived from this software without specific prior written permission.\n{as_is}"),
    ("BSD-2-Clause", "{bsd}{as_is}"),
    ("LicenseRef-BSD-other", "{bsd}3. You must send the author a postcard from your town.\n\n{as_is}"),
    ("LicenseRef-BSD-style", "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file."),
    ("GPL-2.0-only", " * This program is free software; you can redistribute it and/or modify it\n * under the terms of the GNU General Public License version 2 as published by\n * the Free Software Foundation."),
    ("LGPL-2.0-or-later", "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "# GNU Foo Bar is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."),
    ("Apache-2.0 OR MIT", "Licensed under either of Apache License, Version\n2.0 or MIT license at your option."),
    ("MIT", "{mit} The above copyright notice and this permission notice (including the next\nparagraph) shall be included in all copies or substantial portions of the\nSoftware."),
    ("Apache-2.0", "The ASF licenses this file to You under the Apache License, Version 2.0\n(the \"License\"); you may not use this file except in compliance with\nthe License."),
]


def test_sentences_with_holes(spark, tmp_path, same):
    import duckdb

    s = license_scan.SENTENCES
    parts = {"bsd": f"{s['bsd-grant']}\n\n1. {s['bsd-source']}\n2. {s['bsd-binary']}\n", "as_is": s["bsd-as-is"].replace("COPYRIGHT HOLDERS", "AUTHOR"), "mit": s["mit-grant"]}
    texts = [t.replace("{bsd}", parts["bsd"]).replace("{as_is}", parts["as_is"]).replace("{mit}", parts["mit"]) for _, t in HOLED_FILES]
    assert licences_of(spark, texts) == [(1, licence) for licence, _ in HOLED_FILES]
    # A hole has some words, not none and not a paragraph, and does not reach over a blank line.
    none = [NAMED.replace("{} ", ""), NAMED.format("very " * 20), NAMED.replace("{} ", "A\n\nB "), "is free software " * 2000]
    bsd = parts["bsd"] + "{}" + "\n" + parts["as_is"]
    assert licences_of(spark, [bsd.format(t) for t in none]) == [(1, "LicenseRef-BSD-other")] * 4
    # On one line each, as the SQL has them; repeated rows and shared ids give a row each.
    flat = ["\n".join(p.replace("\n", " ") for p in t.split("\n\n")) for t in texts[1:5]] + [NAMED.format("X"), "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."]
    docs = table(spark, flat + ["\n".join(flat)] * 2).union(table(spark, ["Released under MIT."] * 2, [500, 501]))
    docs.write.parquet(f"{tmp_path}/documents")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    same(license_scan.license_scan(docs), duck.sql(license_scan.OP10_SQL))
    shared = license_scan.license_scan(table(spark, ["Released under MIT.", "Released under MIT.", "nothing", None], [4, 4, 4, None]))
    assert sorted((tuple(r)[::4] for r in shared.collect()), key=repr) == sorted([(4, "MIT"), (4, "MIT"), (4, ""), (None, "")], key=repr)


# All: a text longer than a step of a worker, without an id and twice


def test_texts_above_one_step(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(31)
    item = " ".join(f"item{i}" for i in range(20))
    long = " ".join(f"word{rng.randint(0, 300_000)}" for _ in range(900_000)) + f" {item}. Released under the MIT License."
    assert len(long) > 8 << 20
    rows = [(1, "short " * 60), (None, long), (7, long), (8, long), (9, f"before {item} after " + " ".join(long.split()[:1500]))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").repartition(2).cache()
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, with_text=False).collect()}
    n = len(long.split())
    assert {i: got[i]["n_words"] for i in (1, None, 7, 8)} == {1: 60, None: n, 7: n, 8: n} and {i: got[i]["n_removed"] for i in (1, None, 7, 8)} == {1: 0, None: 0, 7: 0, 8: n}
    assert got[9]["n_removed"] == 1500 and got[8]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    fps = {t: brute_fingerprint(t) for t in {t for _, t in rows}}
    got = simhash.simhash_components(docs).collect()
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in got), key=repr) == sorted(((i, f"{fps[t]:016x}") for i, t in rows), key=repr)
    net = small_net()
    got = language_id.language_id(docs, net).collect()
    p = language_id.Scorer(net).probabilities([t.encode() for _, t in rows])
    assert sorted((repr(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in got) == sorted((repr(i), net.languages[int(x.argmax())], round(float(x.max()), 6)) for (i, _), x in zip(rows, p))
    assert mixing.mix(docs, {}, target=50).where("length(text) > 8000000").count() > 0
    tokenizer = Tokenizer.from_file(token_output.tokenizer_path())
    sizes = {t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in fps}
    assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in token_output.token_output(docs).collect()) == sorted((repr(i), sizes[t]) for i, t in rows)
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontamination.decontamination_report(docs, benchmark).collect()
    assert sorted((repr(r["doc_id"]), r["n_hit"], r["contaminated"]) for r in got) == [("1", 0, False), ("7", 20, False), ("8", 20, False), ("9", 20, False), ("None", 20, False)]
    chat = docs.selectExpr("doc_id AS conv_id", "1L AS turn", "'assistant' AS role", "concat(text, '</s>') AS text")
    back = {r["conv_id"]: r["loss_text"] for r in chat_format.read_back(chat_format.format_conversations(chat.where("conv_id is null or conv_id < 7"))).collect()}
    assert back == {1: rows[0][1] + "</s>", None: long + "</s>"}
    media = {(r["n_bytes"], r["payload_sha256"]) for r in flac_media.media_report(flac_media.text_media(docs)).collect()}
    assert media == {(len(t), hashlib.sha256(flac_media.payload(t.encode())).hexdigest()) for t in fps}
    labels = spark.createDataFrame([(1, 1), (9, 0), (7, 0)], "doc_id long, quality int")
    scores = [r["score"] for r in quality.quality_scores(docs, quality.fit(docs, labels)).where("doc_id is null or doc_id in (7, 8)").collect()]
    assert len(scores) == 3 and max(scores) - min(scores) < 1e-12
    assert {r["doc_id"]: r["n_notices"] for r in license_scan.license_scan(docs).collect()} == {1: 0, None: 1, 7: 1, 8: 1, 9: 0}
    docs.unpersist()
