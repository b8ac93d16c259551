"""Chat formatting, mixing, decontamination, licences: SQL on the smallest tables, odd rows, planted cases."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from viewlark.llm import op4_mixing, op5_chat, op7_near_dedup, op8_decontamination, op10_licenses

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("module", [op4_mixing, op5_chat, op7_near_dedup, op8_decontamination, op10_licenses])
def test_against_sql(spark, module):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = module.query(spark, DATA)
    found = c.execute(module.ORACLE_SQL)
    names = [x[0] for x in found.description]
    want = sorted(str([r[names.index(n)] for n in df.columns]) for r in found.fetchall())
    assert sorted(str(list(r)) for r in df.collect()) == want and sorted(names) == sorted(df.columns)


# ---- chat

EVENTS = "conv_id long, turn long, part int, seq long, kind string, role string, text string"


def test_fold_of_events(spark):
    log = [
        (1, 0, 0, 1, "start", "user", "hi"), (1, 1, 0, 2, "start", "assistant", ""), (1, 1, 0, 4, "delta", None, "lo"), (1, 1, 0, 3, "delta", None, "hel"),
        (1, 2, 0, 5, "start", "user", "void"), (1, 1, 0, 6, "regenerate", None, None), (1, 1, 0, 7, "delta", None, "bye"), (1, 2, 0, 8, "start", "user", "new"),
        (1, 3, 0, 9, "start", "user", "gone"), (1, 3, 0, 10, "delete", None, None), (2, 0, 0, 1, "start", "user", "a"), (2, 0, 0, 2, "edit", None, "b"),
        (2, 0, 0, 3, "delta", None, "c"), (None, 0, 0, 1, "start", None, None), (3, 0, 0, 1, "start", "user", "x"), (3, 1, 0, 2, "start", "user", "dropped"),
        (3, 0, 0, 3, "regenerate", None, None),
    ]
    random.Random(1).shuffle(log)
    got = op5_chat.reconstruct(spark.createDataFrame(log, EVENTS)).drop("part")
    want = [(1, 0, "user", "hi"), (1, 1, "assistant", "bye"), (1, 2, "user", "new"), (2, 0, "user", "bc"), (None, 0, "", ""), (3, 0, "user", "")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_rendering_is_reversible(spark):
    nasty = ["\\### Assistant: </turn> ok", "", None, "\\b\\h\\l\\\\", "### a: </turn>\n### b: ", "a:b\n", "é𝔘", "x" * 200_000, "</turn>\n"]
    rows = [(k % 3, k, r, t) for k, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "odd: #role\\", None))]
    rows.append(rows[0])  # a repeated row is a turn of its own
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(5) for c in ("part", "seq", "kind", "at", "log", "loss")})
    messages = op5_chat.reconstruct(op5_chat.events_of(df))
    out = op5_chat.render(messages).select("*", op5_chat.parse(F.col("formatted")).alias("turns"), op5_chat.under_loss(F.col("formatted"), F.col("loss")).alias("under")).collect()
    assert len(out) == 3
    for o in out:
        own = sorted((t, r or "", x or "") for c, t, r, x in rows if c == o.conv_id)
        assert [(t.role, t.text) for t in o.turns] == [(r, x) for _, r, x in own]
        assert o.formatted.count("</turn>\n") == len(own) == len(o.loss)
        under = [t[m.start : m.start + m.length] for t, m in zip(o.formatted.split("</turn>\n"), o.loss)]  # the mask alone
        undone = [u.replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\") for u in under]
        assert undone == [x if r == "assistant" else "" for _, r, x in own] == list(o.under)


def test_fold_against_a_plain_loop(spark):
    r = random.Random(4)
    log = []
    for conv in range(6):
        for seq in range(60):
            kind = r.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            log.append((conv, r.choice([None, 0, 1, 2]), r.randint(0, 1), seq, kind, r.choice([None, "user", "assistant"]), r.choice([None, "a", "b"])))
    want = {}
    for conv, turn, part, seq, kind, role, text in log:
        if kind == "regenerate":
            for k, m in want.items():
                if k[0] == conv and (k[1] if k[1] is not None else -1) > (turn if turn is not None else -1):
                    m["void"] = True
        m = want.setdefault((conv, turn, part), {"role": "", "text": "", "void": False, "gone": False})
        m["void"] = False
        if kind == "start":
            m["role"] = role or ""
        m["gone"] = kind == "delete" or (m["gone"] and kind == "delta")
        m["text"] = {"delta": m["text"] + (text or ""), "regenerate": "", "delete": ""}.get(kind, text or "")
    want = [(*k, m["role"], m["text"]) for k, m in want.items() if not m["void"] and not m["gone"]]
    r.shuffle(log)
    got = map(tuple, op5_chat.reconstruct(spark.createDataFrame(log, EVENTS).repartition(3)).collect())
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_exchange(spark):
    rows = spark.range(100).selectExpr("id % 7 AS conv_id", "id AS turn", "'assistant' AS role", "'x' AS text")
    out = op5_chat.render(op5_chat.reconstruct(op5_chat.events_of(rows)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op5_chat.render(op5_chat.reconstruct(op5_chat.events_of(empty))).count() == 0


# ---- mixing


def corpus(spark, sizes, seed=0):
    r = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * r.randint(0, 30)), "en", source, 0))
            i += 1
    return spark.createDataFrame(rows, DOCS)


def test_mixing_meets_entropy_and_budget(spark):
    docs = corpus(spark, {"a": 600, "b": 150, "c": 60, None: 40})
    counts = op4_mixing.token_counts(docs)
    plan = {r.source: r for r in op4_mixing.quotas(counts, 0.9, 100.0, None).collect()}
    total = sum(r.source_tokens for r in plan.values())
    w = {s: r.quota / total for s, r in plan.items()}
    assert sum(w.values()) == pytest.approx(1) and -sum(x * math.log(x) for x in w.values()) == pytest.approx(0.9 * math.log(4), rel=1e-6)
    limited = op4_mixing.quotas(counts, 1.0, 1.5, None).collect()
    assert max(r.quota / r.source_tokens for r in limited) == pytest.approx(1.5, rel=1e-6)
    rows = op4_mixing.mix(docs, entropy=0.9, repeats=100.0, block_tokens=500).collect()
    size = {r.doc_id: r.tokens for r in counts.collect()}
    for s, p in plan.items():
        own = [r for r in rows if r.source == s]
        assert p.quota <= sum(r.tokens for r in own) + 30 and sum(r.tokens for r in own) < p.quota + 30
        last = max(r.epoch for r in own)
        for e in range(last):  # whole epochs hold every document once
            assert sorted(r.doc_id for r in own if r.epoch == e) == sorted(r.doc_id for r in own if r.epoch == 0)
    assert all(r.tokens == size[r.doc_id] for r in rows)
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, []).append(r)
    assert all(sorted(r.position for r in b) == list(range(1, len(b) + 1)) for b in blocks.values())
    inner = [sum(r.tokens for r in blocks[b]) for b in sorted(blocks)[:-1]]
    assert all(abs(x - 500) < 150 for x in inner)


def test_mixing_does_not_depend_on_slices(spark, monkeypatch):
    docs = corpus(spark, {"a": 300, "b": 30})
    before = rows_of(op4_mixing.mix(docs))
    monkeypatch.setattr(op4_mixing, "SLICE", 1)
    monkeypatch.setattr(op4_mixing, "BROADCAST_SOURCES", 0)
    assert rows_of(op4_mixing.mix(docs)) == before


def test_mixing_of_many_sources(spark, monkeypatch):
    docs = corpus(spark, {f"s{i}": 3 + i for i in range(40)})
    counts = op4_mixing.token_counts(docs)
    exact = {r.source: r.quota for r in op4_mixing.quotas(counts, 0.9, 4.0, None).collect()}
    monkeypatch.setattr(op4_mixing, "SHARES", 5)  # by classes of like size
    near = {r.source: r.quota for r in op4_mixing.quotas(counts, 0.9, 4.0, None).collect()}
    assert exact.keys() == near.keys() and all(near[s] == pytest.approx(q, rel=1e-3) for s, q in exact.items())


@pytest.mark.parametrize("entropy, repeats, budget", [(0.9, 100.0, None), (1.0, 1.5, 9_000)])
def test_mixing_is_the_same_however_many_sources_are_gathered(spark, monkeypatch, entropy, repeats, budget):
    r = random.Random(2)  # counts that differ by less than 1 in 10,000, and some twice
    sizes = {f"s{i}": r.choice([20, 300, 30_000]) + i % 30 for i in range(40)}
    counts = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, tokens long")
    quotas = lambda: {x.source: tuple(x) for x in op4_mixing.quotas(counts, entropy, repeats, budget).collect()}
    before = quotas()
    monkeypatch.setattr(op4_mixing, "SHARES", 5)
    assert quotas() == before and len(before) == 40


def test_mixing_leaves_out_sources_without_tokens(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1), (2, " ", "en", "empty", 1), (3, "c", "en", None, 1), (4, "d", "en", "", 1)], DOCS)
    got = op4_mixing.mix(docs, entropy=0.0).collect()
    assert {r.source for r in got} == {"s", ""} and {r.doc_id for r in got} == {1, 3, 4}


def test_mixing_odd_rows(spark):
    assert op4_mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert op4_mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, " ", "en", "a", 1)], DOCS)).count() == 0
    rows = [(None, "a b", None, None, None), (1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (1, "a b c", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tokens": F.lit("x"), "quota": F.lit(1), "key": F.lit(2)})
    assert op4_mixing.mix(docs, entropy=0.0).count() >= 4


# ---- decontamination


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


Q = "on monday Alice bought 12 apples for 30 dollars and gave 12 of them to Bob before the long walk home again"


def test_templates(spark):
    docs = [
        (1, "Noise first. " + Q + " and after."), (2, Q.replace("Alice", "Carol").replace("12", "77").replace("30", "8")),
        (3, Q.replace("gave 12", "gave 13")), (4, "nothing of this kind"), (5, None), (6, ""), (7, Q.upper()), (None, Q), (1, "again " + Q),
        (8, " ".join(str(k) for k in range(60))),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit(1), "hash": F.lit(2), "n": F.lit(3), "item_id": F.lit(4)})
    items = bench(spark, Q, " ".join(str(k) for k in range(40)), None, "short one").withColumn("doc_id", F.lit(9))
    got = {r.doc_id: r for r in op8_decontamination.matches(df, items).collect()}
    # 3 breaks the slots (12 becomes both 12 and 13), but its windows before the change hold
    assert {1, 2, 7, None} <= set(got) and not {4, 5, 6, 8} & set(got)
    assert got[1].n_exact == got[1].n_windows and got[2].n_exact < got[2].n_windows
    assert got[3].n_windows < got[1].n_windows
    odd = df.unionByName(df.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).withColumns({"_id": F.lit(1), "id": F.lit(2)})
    clean = op8_decontamination.decontaminate(odd, items)
    got = [r.doc_id for r in clean.collect()]
    assert {4, 5, 6, 8} <= set(got) and not {1, 2} & set(got) and got.count(None) == 1 and clean.columns == odd.columns


def test_both_ways_of_joining_agree(spark, monkeypatch):
    r = random.Random(3)
    words = ["alpha", "beta", "12", "7", "km", "Zoe", "and", "of", "run", "sat"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [text(r.choice([6, 9, 20])) for _ in range(12)]
    docs = [(i, f"{text(8)} {r.choice(items)} {text(5)}") for i in range(60)]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, *items)
    before = rows_of(op8_decontamination.matches(df, b))
    monkeypatch.setattr(op8_decontamination, "BROADCAST_WINDOWS", 0)
    assert rows_of(op8_decontamination.matches(df, b)) == before and before


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, Q)], "doc_id long, text string")
    assert op8_decontamination.matches(docs, none).count() == 0 and op8_decontamination.matches(docs.limit(0), bench(spark, Q)).count() == 0


def found_in(spark, items, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in op8_decontamination.matches(df, bench(spark, *items)).collect())
    kept = {r.doc_id for r in op8_decontamination.decontaminate(df, bench(spark, *items)).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in got}
    return got


def test_names_that_start_a_sentence_and_numbers_with_points(spark):
    items = [
        "John has 5 apples and 3 pears. Mary gives him 4 more apples. John eats 2 apples. How many apples does he have now?",
        "John has 5 apples and buys 3 more. How many now?",
        "A shop sold 1,200 pens and took 5.50 dollars from everyone who came by before noon that day",
    ]
    docs = [
        "Peter has 7 apples and 4 pears. Susan gives him 6 more apples. Peter eats 3 apples. How many apples does he have now?",
        'He asks: "Mary has 7 apples and buys 2 more. How many now?"', "Well.\nMary has 7 apples and sells 2 more. How many now?",
        "Then: a shop sold 87 pens and took 12 dollars from everyone who came by before noon that day", "A shop sold 9,999 pens",
    ]
    assert found_in(spark, items, docs) == [(0, 0), (1, 1), (3, 2)]
    # a place is that of the words with 1,200 as two
    df = spark.createDataFrame([(1, "on 1,000 days. " + items[2].replace("5.50", "7"))], "doc_id long, text string")
    assert [r.first_word for r in op8_decontamination.matches(df, bench(spark, items[2])).collect()] == [4]


def test_copies_whose_names_differ_from_the_item_only_by_their_place(spark):
    items = ["What is the capital city of the country France?", "the old mill by the stream was sold to a man from town"]
    docs = [
        "and so on to the quiz What is the capital city of the country France? and more", "the quiz What is the capital city of the country france",
        "so The Old mill by the Stream was sold to a Man from town", "What is the capital river of the country France?",
    ]
    assert found_in(spark, items, docs) == [(0, 0), (1, 0), (2, 1)]


def test_copies_that_are_mostly_slots(spark):
    items = [
        "The singers were Anna Netrebko, Placido Domingo, Luciano Pavarotti, Maria Callas, Renata Tebaldi and Cecilia Bartoli.",
        "Compute 12 + 7 * 3 - 15 / 5 and add 44 to 9.",
    ]
    docs = [f"Some text. {x} More text." for x in items] + [items[1].replace("44", "45"), items[0].replace("Maria", "Clara").replace("Anna", "Edita").replace("Renata", "Mirella")]
    assert found_in(spark, items, docs) == [(0, 0), (1, 1)]


def test_short_items(spark):
    items = ["Blue whales sing", "Who was 44?", "", None, "Yes"]
    docs = ["They say that blue WHALES sing.", "blue whales eat and sing", "Then: who was 44? He", "who was 45", "so yes, it is", "yesterday"]
    assert found_in(spark, items, docs) == [(0, 0), (2, 1), (4, 4)]


def test_slot_heavy_windows_in_sql_and_query(spark, tmp_path):
    items = ["The singers were Anna Netrebko, Placido Domingo, Luciano Pavarotti, Maria Callas, Renata Tebaldi and Cecilia Bartoli.", "Compute 12 + 7 * 3 - 15 / 5 and add 44 to 9.", "Blue whales sing"]
    docs = [f"Some text. {x} More text." for x in items] + [items[1].replace("44", "45"), "nothing"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, *items).write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = op8_decontamination.query(spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({op8_decontamination.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and {(r[0], r[1]) for r in want} >= {(1, 1), (2, 2)}


def test_query_looks_at_all_readings_and_gives_the_rows_of_its_sql(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    words = ["Alice", "bob", "Bob", "Zoe", "has", "12", "1,200", "5.50", "7", "km", "apples", "And", "of", "run.", "sat;", "ran,", "He", '"Mary']
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    other = {"Alice": "Carol", "Bob": "Dan", "12": "99", "1,200": "7", "5.50": "2,000"}
    vary = lambda t: r.choice([t, t.lower(), " ".join(other.get(w, w) for w in t.split())])
    items = ["John has 5 apples and buys 3 more. How many now?"] + [text(r.choice([2, 4, 6, 12, 13, 20])) for _ in range(15)]
    docs = ["Mary has 7 apples and buys 2 more. How many now?"] + [f"{text(4)} {vary(r.choice(items))} {text(4)}" for _ in range(80)]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, *items).write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    looked, whole = [], op8_decontamination.matches
    monkeypatch.setattr(op8_decontamination, "matches", lambda *a, **k: looked.append(whole(*a, **k)) or looked[-1])
    df = op8_decontamination.query(spark, str(tmp_path))
    want = sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM ({op8_decontamination.ORACLE_SQL})").fetchall())
    assert sorted(map(tuple, df.collect())) == want
    # what the query looked at holds its rows, and pairs that only other readings show
    rows = looked[0].collect()
    assert {(x.doc_id, x.item_id) for x in rows} > {x[:2] for x in want} and (0, 0) in {(x.doc_id, x.item_id) for x in rows} - {x[:2] for x in want}
    assert sorted((x.doc_id, x.item_id, x.plain_windows, x.plain_exact, x.plain_first) for x in rows if x.plain_windows) == want
    assert all(x.n_windows >= x.plain_windows and x.n_exact >= x.plain_exact and (x.plain_first is None) == (x.plain_windows == 0) for x in rows)
    monkeypatch.setattr(op8_decontamination, "BROADCAST_WINDOWS", 0)
    assert rows_of(whole(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark")))) == sorted(map(str, rows))


# ---- licences


def test_licences(spark):
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:\n\n"
        "Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.\n"
        "Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.\n"
    )
    endorse = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    docs = [
        (1, "Text of mine\nReleased under the MIT License."), (2, bsd), (3, bsd + endorse), (4, endorse + bsd), (5, None), (6, ""),
        (7, "x. Licensed under the Apache License, Version 2.0. y. All rights reserved."), (8, "We released under the MIT License long ago"), (1, "twice"),
        (9, "a. " * 100_000 + "\nLicensed under CC BY-NC 4.0."),
    ]
    got = [(r.doc_id, r.licenses) for r in op10_licenses.scan(spark.createDataFrame(docs, "doc_id long, text string").withColumn("fine", F.lit(0))).collect()]
    want = [
        (1, ["MIT"]), (2, ["BSD-2-Clause"]), (3, ["BSD-3-Clause"]), (4, ["BSD-2-Clause"]), (5, []), (6, []), (7, ["Apache-2.0", "all-rights-reserved"]), (8, []),
        (1, []), (9, ["CC-BY-NC-4.0"]),
    ]
    assert sorted(got) == sorted(want)
    assert op10_licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


HOPE = (
    "\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"
)
GPL = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n"
NOTICES = {
    "GPL-3.0-or-later": "A tool\nCopyright (C) 2020 Jo\n\n" + GPL.format(":", ",", 3) + HOPE,
    "GPL-2.0-or-later": "A tool\nCopyright (C) 2020 Jo\n\n" + GPL.format(";", ";", 2) + HOPE,
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.\n",
    "Apache-2.0-header": (
        'Copyright 2020 Jo\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\n"
        'distributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n'
        "See the License for the specific language governing permissions and\nlimitations under the License.\n"
    ),
    "ISC": (
        "ISC License\n\nCopyright (c) 2020, Jo\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
        'copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\n'
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE\n"
    ),
    "MIT-text": (
        "MIT License\n\nCopyright (c) 2020 Jo\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
        "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\n"
        "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT\n'
    ),
}


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_standard_notices(spark, prefix):
    docs = [(k, "".join(f"{prefix}{x}".rstrip() + "\n" for x in text.splitlines())) for k, text in NOTICES.items()]
    got = {r.doc_id: r.licenses for r in op10_licenses.scan(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    more = {"Apache-2.0-header": ["Apache-2.0"], "MIT-text": ["MIT"]}
    assert got == {k: [*more.get(k, []), k] for k in NOTICES}


def test_shared_templates_and_one_copy_of_the_bits(spark):
    """what readings share is made once, with the templates of each reading alone; F1: the plan has few copies of the bitmap."""
    o = op8_decontamination
    texts = ["Ran 5 Miles, then 5 miles. 1,200 Kg and 7 kg", "at 5. Kg of 5.50 Mm x", "raw \x015 \x01m 6 m\x01 9 \x01km ab\x01cd", "", "In Mr De Ab 3m 3Mm", "3 \x04kg \x0512 S"]
    t = o.with_templates(o.forms(spark.createDataFrame(list(enumerate(texts)), "key int, text string"), "key", "text"))
    alone = {r: o.template_of(o.numbered(F.col("w")) if r != "none" else o.numbered(o.words_read(F.col("w"), r)), r) for r in o.READINGS}
    for row in t.select("w", *o.READINGS, *(c.alias(f"{r}_alone") for r, c in alone.items())).collect():
        assert all(row[r] == row[f"{r}_alone"] for r in o.READINGS), row
    rows = spark.createDataFrame([(1, "a b c d e f")], "key int, text string")
    plan = o.windows(o.forms(rows, "key", "text"), [13], ["inside"], o.LEAST, [1, 2, 3, 4])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("getbit(") <= 3
