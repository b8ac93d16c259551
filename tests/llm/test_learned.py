"""Token counts, language, toxicity, quality, near duplicates, fingerprints, the pipeline."""

import base64
import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from viewlark.llm import op1_token_counts, op2_language_id, op3_toxicity, op6_quality, op7_near_dedup, op9_fingerprints
from viewlark.llm.common import fold_of, lookup

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "xx", "s", 0), (3, "123 !?", "xx", "s", 6), (None, "some words here", "xx", None, 1), (4, "z" * 300_000, "xx", "s", 1), (4, "z" * 300_000, "xx", "s", 1)]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def docs_of(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS).withColumns({"x": F.lit(1), "score": F.lit("s"), "held_out": F.lit(2), "id": F.lit(3), "key": F.lit("k")})


# ---- token counts


def test_scan_of_any_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    want = []
    for k in range(4):
        docs = [rng.integers(0, 50_000, rng.integers(0, 60)) for _ in range(20)]
        ids = np.concatenate([x for d in docs for x in (d, [50256])])
        at = 0
        for i, d in enumerate(docs):
            want.append((f"f{k}", i, at, len(d), True))
            at += len(d) + 1
        if k % 2:
            ids = np.concatenate([ids, rng.integers(0, 50_000, 33)])
            want.append((f"f{k}", 20, at, 33, False))
        ids.astype("<u2").tofile(tmp_path / f"f{k}")
    (tmp_path / "empty").touch()
    for block in (2, 14, 1000, 1 << 20):
        got = op1_token_counts.scan(spark, str(tmp_path), block_bytes=block).collect()
        assert sorted((os.path.basename(r.file), r.document, r.start, r.tokens, r.closed) for r in got) == sorted(want), block
    with open(tmp_path / "odd", "wb") as f:
        f.write(b"abc")
    with pytest.raises(Exception, match="multiple of"):
        op1_token_counts.scan(spark, str(tmp_path)).collect()


def test_written_tokens(spark, tmp_path):
    texts = ["hello world", None, "", "<|endoftext|>", "é𝔘 \u0000 x"]
    op1_token_counts.write_tokens(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), str(tmp_path / "t"))
    e = op1_token_counts.encoder(op1_token_counts.vocabulary_path())
    got = op1_token_counts.scan(spark, str(tmp_path / "t")).orderBy("file", "document").collect()
    assert [r.tokens for r in got] == [len(e.encode_ordinary(t or "")) for t in texts]


# ---- language


def test_language_of_odd_rows(spark):
    latin = [(i, "lorem ipsum dolor sit amet " * 3, "la", "s", 1) for i in range(10, 40)] + [(i, "кот и пёс живут дома " * 3, "ru", "s", 1) for i in range(40, 70)]
    docs = docs_of(spark, latin)
    net = op2_language_id.fit(docs, fold_of(F.col("doc_id"), 5) == 0)
    assert net.languages == ["la", "ru"]
    got = {r.doc_id: r for r in op2_language_id.identify(docs.unionByName(docs_of(spark)), net).collect()}
    assert all(got[i].lang_pred == ("la" if i < 40 else "ru") for i in range(10, 70))
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und" and 0 <= got[4].score <= 1
    assert {r.doc_id for r in op2_language_id.keep(docs_of(spark), net, 0.0).collect()} == {None, 4}
    mixed = docs_of(spark, [(1, "lorem ipsum dolor sit amet " * 40 + "кот и пёс живут дома " * 30, "la", "s", 1), (2, "кот и пёс " * 9, "ru", "s", 1)])
    one, two = (r.score for r in op2_language_id.identify(mixed, net).orderBy("doc_id").collect())
    assert one < two  # half way between these, in parts of what is above chance
    assert [r.doc_id for r in op2_language_id.keep(mixed, net, (one + two) - 1).collect()] == [2]
    assert op2_language_id.fit(docs_of(spark, []), F.lit(False)) is None
    with pytest.raises(ValueError, match="values of lang"):
        op2_language_id.fit(spark.range(2000).selectExpr("id AS doc_id", "'x' AS text", "string(id) AS lang"), F.lit(False))


def test_network_against_plain_convolution():
    o = op2_language_id
    net = o.Network(["a", "b", "c"], seed=5)
    texts = ["hello there, this is a text of some length " * 9, "é", "xyz", "k" * 130, "12 ?"]
    index, score = o.predict(net, pa.array([*texts, None, ""]))
    for t, i, s in zip(texts, index, score):
        x, step = t.encode(), o.LENGTH - net.reach + 1
        found = []
        for at in range(0, max(1, len(x) - net.reach + 1), step):
            w = [*x[at : at + o.LENGTH], *[o.PAD] * o.LENGTH][: o.LENGTH]
            top = []
            for k in range(o.FILTERS * len(o.WIDTHS)):
                width = o.WIDTHS[k // o.FILTERS]
                own = net.p["w"][: width * o.EMBEDDING, k]
                top.append(max(float(np.concatenate([net.p["e"][b] for b in w[j : j + width]]) @ own) for j in range(o.LENGTH - net.reach + 1)) + net.p["b"][k])
            z = np.maximum(top, 0) @ net.p["v"] + net.p["c"]
            found.append(np.exp(z) / np.exp(z).sum())
        p = np.mean(found, axis=0)
        if any(c.isalpha() for c in t):
            assert i == p.argmax() and s == pytest.approx(p.max(), rel=1e-4)
        else:
            assert i == -1 and s == 0
    assert index[-2:].tolist() == [-1, -1]


def test_gradient_against_differences():
    o = op2_language_id
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 123, (8, o.LENGTH)).astype(np.int16), rng.integers(0, 3, 8)
    net = o.Network(["a", "b", "c"], seed=1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}

    def loss():
        cols = net._columns(x)
        z = np.maximum((cols @ net.p["w"]).max(axis=1) + net.p["b"], 0) @ net.p["v"] + net.p["c"]
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(8), y]).mean()

    for name, g in net.gradients(x, y).items():
        for i in np.argsort(-np.abs(g).ravel())[:8]:
            at, slope = np.unravel_index(i, g.shape), 0.0
            for h in (1e-6, -1e-6):
                net.p[name][at] += h
                slope += np.sign(h) * loss()
                net.p[name][at] -= h
            assert g[at] == pytest.approx(slope / 2e-6, rel=1e-3, abs=1e-7), name


def test_windows_cover_the_whole_text(spark):
    net = op2_language_id.Network(["a", "b"])
    seen = []
    net.log_probabilities = lambda x: seen.append(x) or np.zeros((len(x), 2), np.float32)
    text = bytes(range(32, 122)) * 9
    op2_language_id.predict(net, pa.array([text.decode(), None, "ab"]))
    rows = np.concatenate(seen)
    step = op2_language_id.LENGTH - net.reach + 1
    for k in range(len(rows) - 2):
        part = rows[k][rows[k] != op2_language_id.PAD]
        assert bytes(part.astype(np.uint8)) == text[k * step : k * step + op2_language_id.LENGTH]
    assert (len(rows) - 3) * step + op2_language_id.LENGTH >= len(text)


@needs_data
def test_language_held_out(spark):
    got = op2_language_id.query(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


# ---- toxicity and quality


@needs_data
def test_toxicity_held_out(spark):
    df = op3_toxicity.query(spark, DATA)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and df.count() == 1000
    got = df.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() > 0.9 and got[got.toxic == 1].predicted.mean() > 0.7


def test_toxicity_of_planted_words(spark):
    r = random.Random(0)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(300)]
    text = lambda bad: " ".join([*r.choices(words, k=60), *(["zqxwort"] if bad else [])])
    rows = [(i, text(i % 4 == 0), "en", "s", 1) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = op3_toxicity.fit(docs_of(spark, rows), labels)
    bad, good, *none = model.score([text(True), text(False), None, "", "17 !"])
    assert bad > 0.7 and good < 0.3 and len(set(none)) == 1
    out = op3_toxicity.score(docs_of(spark), model).collect()
    assert len(out) == len(ODD) and all(0 <= x.score <= 1 for x in out)
    assert op3_toxicity.fit(docs_of(spark, rows), labels.limit(0)).score(["x"]).tolist() == [0.0]
    # rows that repeat an id, and copies of a text, count once
    again = docs_of(spark, rows).unionByName(docs_of(spark, [r for r in rows if r[0] < 20])).repartition(7)
    assert op3_toxicity.fit(again, labels).distance.data == model.distance.data


def test_toxicity_scores_against_one_window_at_a_time():
    words = [f" w{chr(97 + i % 26)}{chr(97 + i // 26)}rd ".encode() for i in range(300)]
    distance = op3_toxicity.Distance(b"".join(w.rstrip() for w in words), b" ", b" wrqzkel zqxwort ")
    model = op3_toxicity.Model(distance, 2, np.array([-1.0, 0.5, 0.25, 0.1, 0.2]))
    docs = ["waard zqxwort wbard", "waard wbard wcard", "", None, "Zqxwort! wrqzkel " * 40, "x" * 100, "é zqxwort"]
    base, *ends = distance.data
    size = max(map(len, ends))
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, window_log=20, chain_log=15, hash_log=15, search_log=6, min_match=4, target_length=64,
        write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    for doc, got in zip(docs, model.score(docs)):
        found = [w[i : i + 24] for w in re.findall(r"[^\W\d_]+", (doc or "").lower()) for i in range(0, len(w), 24)]
        made = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(base + e.rjust(size) + b"\n" * 16, dict_type=1), compression_params=params) for e in ends]
        differ = lambda w: (lambda n: n[0] - n[1])([len(c.compress(f" {w} ".encode() + bytes(24))) for c in made])
        pairs = [found[i : i + 2] for i in range(0, len(found), 2)]
        diffs = [differ(" ".join(p)) if any(map(differ, p)) else 0 for p in pairs]
        hits = sum(d >= 2 for d in diffs)
        z = -1 + 0.5 * (hits > 0) + 0.25 * math.log1p(hits) + math.sqrt(hits / max(1, len(diffs))) + 0.2 * max([0, *diffs]) / 4
        assert got == pytest.approx(1 / (1 + math.exp(-z)))
    assert model.score(docs)[0] > model.score(docs)[1]


def test_every_window_is_compressed():
    distance = op3_toxicity.Distance(b" plain words of ordinary talk " * 40, b" ", b" wrqzkel zqxwort ")
    r = random.Random(5)
    heads, tails = ["barel", "wrakel", "plain", "vuzkel"], ["zqa", "zqxb", "talk", "zquv"]
    text = " ".join(r.choice(heads if i % 2 == 0 else tails) for i in range(201))
    alone = lambda words: int(distance([f" {words} ".encode()])[0])
    words = text.split()
    diffs = [alone(" ".join(words[i : i + 2])) for i in range(0, len(words), 2)]
    # words that cost the same, each alone, and differ as a window: their end and beginning are the toxic dictionary's
    assert any(d and not any(map(alone, words[2 * k : 2 * k + 2])) for k, d in enumerate(diffs))
    got = op3_toxicity.Model(distance).spectra(["", text, None, text])
    want = np.bincount(np.array(diffs) - op3_toxicity.LOWEST, minlength=op3_toxicity.CELLS)
    assert (got[1] == want).all() and (got[3] == want).all() and not got[[0, 2]].any()


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join("w" + chr(97 + i % 26) + chr(97 + i // 26) + "x" for i in range(600)) + " zqxwort wrqzkel " * 8
    model = op3_toxicity.Model(op3_toxicity.Distance(b"one two three " * 40, b" ", b" wrqzkel zqxwort "))
    whole = model.spectra([text, "", "zqxwort"])
    monkeypatch.setattr(op3_toxicity, "PIECE", 10)
    monkeypatch.setattr(op3_toxicity, "BLOCK", 50)
    monkeypatch.setattr(op3_toxicity, "MEMO", 20)
    assert (model.spectra([text, "", "zqxwort"]) == whole).all() and whole[0].sum() == 308 and whole[0, 3 - op3_toxicity.LOWEST :].sum() == 8


@needs_data
def test_quality_held_out(spark):
    got = op6_quality.query(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_parts_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(op6_quality.STATISTICS)))
    y = (x[:, 0] > 0).astype(int)
    train = spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y))], "doc_id long, x array<double>, y int")
    f = op6_quality.Fourier(x.mean(0), x.std(0), 32, 3.0, 0)
    a = np.hstack([f(x), y[:, None]])
    assert np.allclose(op6_quality._normal_equations(train.repartition(5).select("x", "y"), f), a.T @ a)
    one = op6_quality.isotonic(np.array([0.0, 3, 1, 0, 4]), np.array([4.0, 4, 4, 0, 4]))
    assert (np.diff(one) >= 0).all() and one[1] == one[2] and one[0] < one[1] < one[4]
    assert op6_quality.fit(train.filter("y = 1")).score(x[:2]).tolist() == [1.0, 1.0] and op6_quality.fit(train.limit(0)).score(x[:1]).tolist() == [0.5]


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    found = op6_quality.scores(docs_of(spark), labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert op6_quality.keep(docs_of(spark, []), labels).count() == 0
    named = docs_of(spark).withColumn("doc_id", F.col("doc_id").cast("string")).withColumns({"y": F.lit(1), "X": F.lit(2)})
    kept = op6_quality.keep(named, labels.withColumn("doc_id", F.col("doc_id").cast("string")), 0.0)
    assert kept.count() == len(ODD) and kept.columns == named.columns


def test_quality_statistics_against_counting():
    text = "The CAT sat sat on 12 mats!  It said: héllo | |x\nA-b sat on 12"
    got, w = dict(zip(op6_quality.STATISTICS, op6_quality.statistics(text))), text.split()
    raw = text.encode()
    share = lambda f: sum(map(f, raw)) / len(raw)
    pairs = list(zip(w, w[1:]))
    want = {
        "log_chars": math.log(1 + len(text)), "log_words": math.log(1 + len(w)), "word_length": sum(map(len, w)) / len(w),
        "upper": share(lambda b: 65 <= b <= 90), "digits": share(lambda b: 48 <= b <= 57), "punctuation": share(lambda b: chr(b) in "!\"'(),-.:;?"),
        "symbols": share(lambda b: chr(b) in "#$%&*+/<=>@[\\]^_`{|}~"), "space": share(lambda b: b in (9, 32)), "newlines": share(lambda b: b == 10),
        "non_ascii": share(lambda b: b > 127), "entropy": -sum(raw.count(b) / len(raw) * math.log2(raw.count(b) / len(raw)) for b in set(raw)),
        "distinct_words": len(set(w)) / len(w), "repeats_next": sum(a == b for a, b in pairs) / len(w), "top_word": max(map(w.count, w)) / len(w),
        "repeated_pairs": 1 - len(set(pairs)) / (len(w) - 1), "word_ends": sum(not x[-1].isalnum() for x in set(w)) / len(set(w)),
        "shouted_words": sum(x.isupper() for x in w) / len(w), "piped_words": sum(not x[0].isalnum() for x in w) / len(w),
    }
    assert got == pytest.approx(want)


# ---- near duplicates


def shingles(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*[w[i:] for i in range(k)]))


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n=220):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    bases = [[word() for _ in range(n_)] for n_ in (1, 2, 3, 40, 80, 150, 150)]
    rows = []
    for i in range(n):
        t = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 8])):
            t[r.randrange(len(t))] = word()
        rows.append((i * 3 % 1000, r.choice([" ", "\n", "\t "]).join(t).replace("a", r.choice("aA"))))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "É x y z"), (5004, "é x y z")]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 1024), (5, 80, 7)])
def test_components_against_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(op7_near_dedup, "BLOCK", block)  # small blocks: groups are dealt over many tasks
    rows = near_copies(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "key": F.lit("x"), "size": F.lit(2)}).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op7_near_dedup.classes(df, k, percent).collect()}
    assert got == brute(rows, k, percent)
    df = df.withColumns({"_id": F.lit(3), "_row": F.lit(4), "place": F.lit(5)})
    kept = op7_near_dedup.dedup(df, k, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c) and kept.columns == df.columns


def test_shared_counts_as_pairs_do():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 40)).astype(np.uint64) for _ in range(12)]
    got = op7_near_dedup._shared(sets, np.arange(5), np.arange(3, 12))
    assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in range(3, 12)] for i in range(5)]


def test_near_duplicates_of_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op7_near_dedup.classes(docs_of(spark), 5, 80).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (None, 1, None), (4, 1, 4), (4, 1, 4)], key=str)
    assert sorted((r.doc_id for r in op7_near_dedup.dedup(docs_of(spark)).collect()), key=str) == sorted([1, 2, 3, None, 4], key=str)
    assert op7_near_dedup.classes(docs_of(spark, []), 5, 80).count() == 0


def test_dedup_of_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words that are not near"), (2, "A b c d e f"), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit(4), "id": F.lit(5), "_id": F.lit(6)})
    got = sorted(((r.doc_id, r.text) for r in op7_near_dedup.dedup(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (1, "other words that are not near"), (None, "a b c d e f")], key=str)


def test_chance_to_miss_a_pair_at_the_threshold():
    o, r = op7_near_dedup, np.random.default_rng(3)
    bands, missed, below = o.bands_for(0.85), 0, 0
    for _ in range(1500):
        union = r.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(union[:37]), np.unique(union[3:])  # 34 of 40 in common
        sig = o.signatures([a, b], bands * o.ROWS)
        keys = o.band_keys(sig, bands)
        missed += not (keys[0] == keys[1]).any()
        below += (sig[0].astype(np.uint8) == sig[1].astype(np.uint8)).mean() < 0.85 - o.MARGIN
    assert missed == 0 and below == 0


def test_lookup_with_hot_keys(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(0)).otherwise(F.col("id")).alias("key"), F.col("id").alias("v"))
    unique = spark.range(0, 2500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("w"))
    got = lookup(big, unique, "key", parts=8).collect()
    assert len(got) == 3000 and all(r.w == (r.key * 2 if r.key < 2500 else None) for r in got)


# ---- fingerprints


def test_pairs_and_edits_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op9_fingerprints, "ROWS_PER_RANGE", 7)  # many ranges, whose ends meet
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijk é") for _ in range(r.randint(2, 9)))
    rows = [(i * 7, " ".join(word() for _ in range(r.choice([0, 1, 20, 90, 400])))) for i in range(60)] + [(1000, None), (1001, "same text " * 40), (1002, "same text " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(0)).repartition(6)
    rank = op9_fingerprints.ranks(op9_fingerprints.count_levels(df))
    got = {x.doc_id: x for x in op9_fingerprints.with_next(df, rank).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (i, t), (j, n) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        print_of = lambda x: op9_fingerprints.digest(op9_fingerprints.features(*op9_fingerprints._pack([x]), rank)[0])
        assert got[i].near_edited == pytest.approx(op9_fingerprints.likeness(print_of(t), print_of(edited)))
        assert got[i].near_next == pytest.approx(op9_fingerprints.likeness(print_of(t), print_of(n)))
        assert (got[i].fingerprint == got[j].fingerprint) == (t == n) or len(t) < 40
        assert base64.b64decode(got[i].fingerprint) == print_of(t)
    assert got[1002].near_next == 1.0 and got[1001].near_next == 0.0 and got[1002].fingerprint


def test_entropy_levels_against_counting():
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(0, 256, 200), np.zeros(100), r.integers(97, 100, 150)]).astype(np.uint8)
    got = op9_fingerprints.entropy_levels(x)
    for i in range(len(x) - op9_fingerprints.WINDOW + 1):
        p = np.bincount(x[i : i + op9_fingerprints.WINDOW]) / op9_fingerprints.WINDOW
        e = -(p[p > 0] * np.log2(p[p > 0])).sum()
        assert abs(got[i] - e * (op9_fingerprints.LEVELS - 1) / np.log2(op9_fingerprints.WINDOW)) <= 0.501


def plain_features(text, rank):
    """The features of one text by the words of the docstring."""
    o, x = op9_fingerprints, text.encode()
    if len(x) < o.WINDOW:
        return [x] if x else []
    keys = []
    for i in range(len(x) - o.WINDOW + 1):
        p = np.bincount(np.frombuffer(x[i : i + o.WINDOW], np.uint8)) / o.WINDOW
        e = -(p[p > 0] * np.log2(p[p > 0])).sum()
        keys.append((rank[int(np.clip(np.rint(e * (o.LEVELS - 1) / np.log2(o.WINDOW)), 0, o.LEVELS - 1))], i))
    wins = dict.fromkeys(range(len(keys)), 0)
    for s in range(1 - o.NEIGHBOURS, len(keys)):
        wins[min(keys[max(0, s) : s + o.NEIGHBOURS])[1]] += 1
    return [x[i : i + o.WINDOW] for i, n in wins.items() if n >= o.LEAST]


@pytest.mark.parametrize("size", [1, 31, 32, 33, 64, 95, 127, 128, 255, 256, 257, 700])
def test_features_at_every_length_against_brute_force(size):
    r, o = random.Random(size), op9_fingerprints
    rank = o.ranks(np.random.default_rng(1).integers(0, 50, o.LEVELS))
    texts = ["".join(r.choice("abcdefgh ,.XYZ019") for _ in range(size)), "ab" * 40, "x" * size, "", "another text, which stands behind " * 4]
    hashed = lambda f: o._hash(np.frombuffer(f, np.uint8), np.array([0]), o.WINDOW)[0] if len(f) == o.WINDOW else np.frombuffer(hashlib.blake2b(f, digest_size=8).digest(), np.uint64)[0]
    for t, got in zip(texts, o.features(*o._pack(texts), rank)):
        assert got.tolist() == [hashed(f) for f in plain_features(t, rank)] and (len(got) > 0) == bool(t)


def test_fingerprints_of_texts_of_like_length_can_be_compared():
    o, r = op9_fingerprints, random.Random(0)
    text = "".join(r.choice("abcdefghijklm nop") for _ in range(257))
    rank = o.ranks(np.random.default_rng(1).integers(0, 50, o.LEVELS))
    a, b, c = (o.digest(f) for f in o.features(*o._pack([text[:255], text[:256], text]), rank))
    assert min(o.likeness(a, b), o.likeness(b, c), o.likeness(a, c)) > 0.6


def test_ranges_of_ids(spark):
    bounds = sorted(random.Random(1).sample(range(1000), 50), reverse=True)
    got = spark.range(-5, 1005).select("id", op9_fingerprints._range_of(F.col("id"), bounds).alias("p")).collect()
    assert all(r.p == sum(b >= r.id for b in bounds) for r in got)


@needs_data
def test_exact_columns_of_fingerprints_against_sql(spark):
    sql = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC, text) AS n FROM '{DATA}/documents.parquet'),
      f AS (SELECT t FROM d ORDER BY doc_id DESC, t LIMIT 1)
      SELECT d.doc_id, length(d.t), sha256(substr(d.t, 1, length(d.t) - length(d.t) // 2) || substr(coalesce(n, f.t), 1, length(d.t) // 2)) FROM d, f"""
    got = op9_fingerprints.query(spark, DATA).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


def test_fingerprints_of_odd_rows(spark):
    rank = op9_fingerprints.ranks(op9_fingerprints.count_levels(docs_of(spark)))
    got = op9_fingerprints.with_next(docs_of(spark), rank).collect()
    assert len(got) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.fingerprint for r in got if r.n_chars == 0} == {""}
    assert op9_fingerprints.with_next(docs_of(spark, []), rank).count() == 0
    alone = op9_fingerprints.with_next(docs_of(spark, [(9, "only one here", None, None, None)]), rank).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# ---- the pipeline


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    data = DATA
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, data), name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before is None or ids <= before, name
        before = ids
        assert name == "mix" or docs.columns == names
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert not [i for i in before if labels.get(i) == 0]
    assert corpus_pipeline.run(spark, data).count() == docs.count()


@needs_data
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from viewlark.llm import op4_mixing, op8_decontamination

    small = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: {r.doc_id for r in df.collect()}
    # quality: the model's score of each text alone
    y = op6_quality._labels(labels, "quality")
    train = docs.filter(fold_of(F.col("doc_id"), 5) != 0).select("doc_id", "text").join(y, "doc_id", "left_semi")
    model = op6_quality.fit(op6_quality.measure(train).join(y, "doc_id"))
    want = {i for i, t in texts.items() if model.score(np.array([op6_quality.statistics(t)]))[0] >= op6_quality.THRESHOLD}
    assert ids(stages["quality"](spark, docs, small)) == want
    # language: each text alone, over the part of what is above chance
    net = op2_language_id.fit(docs, fold_of(F.col("doc_id"), 5) == 0)
    chance = 1 / len(net.languages)
    told = {i: op2_language_id.predict(net, pa.array([t], pa.string())) for i, t in texts.items()}
    want = {i for i, (k, s) in told.items() if k[0] >= 0 and s[0] >= chance + op2_language_id.MARGIN * (1 - chance) - 1e-6}
    assert ids(stages["language"](spark, docs, small)) == want
    # near duplicates: all pairs
    assert ids(stages["near_dedup"](spark, docs, small)) == {i for i, (_, c) in brute(list(texts.items()), 5, 80).items() if i == c}
    # decontamination: what the SQL finds goes, and what shares no five words with the benchmark stays
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{small}/benchmark.parquet'")
    found = {r[0] for r in c.execute(f"SELECT DISTINCT doc_id FROM ({op8_decontamination.ORACLE_SQL})").fetchall()}
    kept = ids(stages["decontaminate"](spark, docs, small))
    fives = set().union(*(shingles(r[0], 5) for r in c.execute("SELECT text FROM benchmark").fetchall()))
    assert found and not kept & found and {i for i, t in texts.items() if not shingles(t, 5) & fives} <= kept
    # mixing: the SQL over the stage's input
    mixed = stages["mix"](spark, docs, small)
    rows = c.execute(f"SELECT {', '.join(mixed.columns)} FROM ({op4_mixing.ORACLE_SQL})").fetchall()
    assert sorted(map(str, map(tuple, mixed.collect()))) == sorted(map(str, rows))


def test_pipeline_stages_take_odd_rows(spark):
    """Nulls in every column, repeated rows, blank and long texts, columns with clashing names."""
    import corpus_pipeline

    more = [(10 + i, f"some plain words of text number {i} that are not near others {i * 7} at all", "en", "s", 1) for i in range(6)]
    for name, stage in corpus_pipeline.STAGES:
        docs = docs_of(spark, ODD + more).withColumns({"_id": F.lit(1), "_row": F.lit(2), "lang_pred": F.lit("x"), "hash": F.lit(1), "tokens": F.lit("t")})
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert name == "mix" or out.columns == docs.columns, name
        assert len({(r.doc_id) for r in out.collect()} - {None, 1, 2, 3, 4, *range(10, 16)}) == 0, name


def test_pipeline_stages_take_empty_tables(spark):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        if os.path.isdir("/root/testdata/sf0.001"):
            assert stage(spark, spark.createDataFrame([], DOCS), "/root/testdata/sf0.001").count() == 0, name
