"""Each operator on odd tables, and against brute force on small ones."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import components, decontam, fmindex, html, jaccard, licenses, lines, mixing, quality, substrings, tokens, urls
from kinfold.llm.queries import model_path
from kinfold.sources import store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, host string, row long"
ITEMS = "item_id long, text string, key string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(400)]
    texts = [" ".join(rnd.choice(vocabulary) + ("\n" if rnd.random() < 0.08 else "") for _ in range(rnd.choice([0, 3, 30, 80, 150]))) for _ in range(n)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(70))
    for k in range(0, n, 4):
        texts[k] += " " + passage
    for k in range(5, n, 9):
        parts = texts[0].split(" ")
        parts[k % len(parts)] = "edited"
        texts[k] = " ".join(parts)
    texts[7] = texts[3]
    texts[11] = "x" * 30000 + " y" * 3000
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, len(t), "k", "h", 1) for k, t in enumerate(texts)]
    return [*rows, (7, texts[7], "en", "s1", 1, "k", "h", 1), (None, texts[0], None, None, None, None, None, None), (900, None, None, "s0", None, None, None, None), (901, "", "en", "s0", 0, "", "", 0), (902, " \n\t ", "en", "s0", 4, "", "", 0)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(params=["usual", "tight"])
def limits(request, monkeypatch):
    """Limits as they are, and so tight that every way of an operator is taken: no broadcasts, many blocks, parts, shards and crowds."""
    if request.param == "tight":
        monkeypatch.setattr(store, "BROADCAST_BYTES", -1)
        for module, name, value in (
            (substrings, "CROWD", 3), (substrings, "SHARD", 20), (substrings, "HOT", 2), (jaccard, "BLOCK_WORDS", 300), (jaccard, "SPLIT_BLOCKS", 1),
            (decontam, "BLOCK_BYTES", 40), (mixing, "PART_ROWS", 2), (urls, "BUCKET_DAYS", 5),
        ):
            monkeypatch.setattr(module, name, value)


def test_empty_tables(spark, none):
    items = spark.createDataFrame([], ITEMS)
    assert licenses.scans(none).count() == substrings.removed(none).count() == mixing.mix(none).count() == lines.judge(none).count() == 0
    assert decontam.judge(none, items).count() == quality.judge(none).count() == jaccard.classes(none).count() == tokens.counts(none, model_path()).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licences():
    found = licenses.scan("Hello world.\nReleased under the MIT License.")[1], licenses.scan("SPDX-License-Identifier: BSD-3-Clause\nint x;")[1], licenses.scan(None)[1], licenses.scan("I have a driving licence.")[1]
    assert found == (["MIT"], ["BSD-3-Clause"], [], [])
    assert licenses.scan("This work is licensed under the GNU General Public License, version 3.")[1] == ["GPL-3.0"]


MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
LICENCES = {
    "MIT": MIT,
    "BSD-3-Clause": BSD,
    "BSD-2-Clause": "\n\n".join(x for x in BSD.split("\n\n") if "Neither" not in x),
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": GPL,
    "GPL-2.0-or-later": GPL.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL": GPL.replace("GNU General", "GNU Lesser General"),
    "AGPL-3.0": GPL.replace("GNU General", "GNU Affero General"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated this work under Creative Commons Zero.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "BSD": "This module may be used by all and is released under the terms of the BSD License.",
}


@pytest.mark.parametrize("name", LICENCES)
@pytest.mark.parametrize("width", [10_000, 100, 80, 72, 40, 20])
def test_licence_texts(name, width):
    """Wrapped at any width, commented, in capitals, and between other lines."""
    import textwrap

    wrapped = "\n\n".join("\n".join(textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False)) for x in LICENCES[name].split("\n\n"))
    for text in (wrapped, wrapped.upper()):
        marked = [textwrap.indent(text, m, lambda _: True) for m in ("# ", "// ", " * ", "-- ", ";; ", "    ")]
        for form in (text, *marked, f"/*\n{marked[2]}\n */\nint x;", f"<!--\n{text}\n-->\n<p>", text.replace("\n", "\r\n"), *(f"Some words of mine.\n{text}\n{after}" for after in ("lower case follows", "ñandú", "über alles", "Upper case"))):
            assert licenses.scan(form)[1] == [name], form


def test_licence_lines():
    assert licenses.scan("Copyright 2020 Foo\nReleased under the MIT License\nint main")[0] == ["Copyright", "MITRef"]
    assert licenses.scan("Notes on copyright\n1234 items. All about a licence. In 2020 copyright was old.")[0] == []
    assert licenses.scan("# SPDX-License-Identifier: MIT\n# Copyright 2020 Foo")[1] == ["MIT"]


def test_substrings(docs, rows, limits):
    texts = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    low = {}
    for i, w in texts:
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            low[x] = min(low.get(x, 10**9), -1 if i is None else i)
    expected = []
    for i, w in texts:
        gone = {p for k in range(len(w) - 49) if low[tuple(w[k : k + 50])] < (-1 if i is None else i) for p in range(k, k + 50)}
        expected.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs).collect()]
    assert sorted(got) == sorted(expected)


def test_matching_statistics():
    rnd = np.random.default_rng(3)
    for _ in range(8):
        sequences = [rnd.integers(1, 4, rnd.integers(1, 30)).astype(np.uint64) for _ in range(12)]
        owner = rnd.integers(0, 5, 12)
        index = fmindex.Index(sequences, owner)
        got = index.statistics(owner)
        for s, o, b in zip(sequences, owner, index.begin, strict=True):
            for k in range(len(s)):
                best = 0
                for t, p in zip(sequences, owner, strict=True):
                    if p < o:
                        for j in range(len(t)):
                            n = 0
                            while k + n < len(s) and j + n < len(t) and s[k + n] == t[j + n]:
                                n += 1
                            best = max(best, n)
                assert got[b + k] == best


def test_mix(docs, rows, limits):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in got)
    assert sum(r.size for r in got) == sum(len(WORD.findall(r[1] or "")) for r in rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    for source in {r.source for r in got}:
        part = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 2 * max(r.size for r in part)


def test_lines(docs, rows, limits):
    seen = []
    for r in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])):
        for k, line in enumerate((r[1] or "").split("\n")):
            if words := frozenset(WORD.findall(line)):
                seen.append((-1 if r[0] is None else r[0], k, words))
    first = {}
    for i, k, s in seen:
        first[s] = min(first.get(s, (10**9, 0)), (i, k))
    earliest = {s: min(first[o] for o in first if len(s & o) / len(s | o) >= 0.8) for s in first}
    expected = {}
    for i, k, s in seen:
        if earliest[s] >= (i, k):
            expected.setdefault(i, set()).add(k)
    got = {(-1 if r.doc_id is None else r.doc_id): set(r.kept) for r in lines.judge(docs).collect()}
    assert {i: k for i, k in got.items() if k} == expected


def test_lines_apply(docs):
    kept = lines.apply(docs, lines.judge(docs))
    assert kept.columns == docs.columns
    assert kept.filter("text IS NOT NULL AND n_chars IS NOT NULL AND doc_id <> 7").filter(F.length("text") != F.col("n_chars")).count() == 0


def test_repeated_rows_meet_once(spark):
    """60 equal rows and a copy of theirs: joined with themselves they would make 3,600."""
    text = " ".join(f"w{k}" for k in range(120))
    docs = spark.createDataFrame([(5, text, "s")] * 60 + [(1, text + " end", "s"), (9, text, "s")], "doc_id long, text string, source string")
    facts, texts, runs = substrings._found(docs)
    assert facts.count() == 62 and texts.count() <= 61 and runs.count() == 1
    assert sorted((r.doc_id, r.n_removed) for r in substrings.removed(docs).collect()) == [(1, 0)] + [(5, 120)] * 60 + [(9, 120)]
    assert lines.judge(docs).filter("size(kept) = 1").count() == 1
    assert jaccard.classes(docs).filter("class_id = 1 AND n_links = 61").count() == 62


def near_copies(n, size=60, seed=4):
    """Lines of ``size`` words, each with one to six of them changed, of which most pairs are a little less than 0.8 alike."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"base{j}" for j in range(size)]
        for j in rnd.sample(range(size), rnd.choice([1, 2, 3, 4, 4, 5, 5, 6])):
            words[j] = f"edit{k}x{j}"
        rows.append((k, " ".join(words)))
    return rows


def test_near_copies_make_few_pairs(spark, limits, monkeypatch):
    """The pairs to verify grew with the square of such a group: 25 for each line of 200, 50 for each of 400."""
    made, cut = [], lines.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["id", "other"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(lines, "cut", counted)
    rows = near_copies(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [frozenset(t.split()) for _, t in rows]
    stays = {i for i, s in enumerate(sets) if not any(len(s & t) >= 0.8 * len(s | t) for t in sets[:i])}
    assert {r.doc_id for r in lines.judge(docs).collect() if r.kept} == stays
    assert 1 < len(stays) < 200 and sum(made) < 20 * len(rows)


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_lines_are_dealt_in_blocks(spark):
    """3,000 lines with 27,000 prefix words, each of them a row in three shuffles before: 90,498 rows were shuffled."""
    rnd = random.Random(6)
    rows = [(None if k < 20 else k // 3, " ".join(rnd.choices([f"w{j}" for j in range(4000)], k=40)), "s") for k in range(2400)]
    for k in range(600):
        words = rows[k * 4][1].split()
        words[rnd.randrange(40)] = f"e{k}"
        rows.append((900 + k, " ".join(words) + (f" more{k}" if k % 2 else ""), "s"))
    before = shuffled_rows(spark)
    got = lines.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "kept").collect()
    assert len(got) == 3000 and sorted(-1 if r.doc_id is None else r.doc_id for r in got if not r.kept) == list(range(900, 1500))
    assert shuffled_rows(spark) - before < 30_000


def test_line_ranges(spark):
    """Limits between ranges, nulls and equal doc_ids: an earlier line has a smaller id, and lines of one text are in one range."""
    order = [(known, doc, key) for known, doc in ((False, 0), (True, -5), (True, 3)) for key in (-(2**40), -1, 0, 7)]
    limits = {c: np.array([order[k][j] for k in (2, 5, 9)]) for j, c in enumerate(("known", "doc_id", "key"))}
    n = len(order) * 2
    values = {c: np.zeros(n, np.int64) for c in lines._SET} | {c: np.repeat([x[j] for x in order], 2) for j, c in enumerate(("known", "doc_id", "key"))}
    values |= {"s1": np.arange(n), "line": np.tile([1, 0], len(order)), "size": np.ones(n, np.int32), "prefix": np.arange(n)}
    block = lines._block(np.zeros(n, np.int64), values, lines._SET)
    (dealt,) = lines._firsts_dealt(type("Held", (), {"value": limits}))(iter([block]))
    assert dealt.column("part").to_pylist() == [0, 1, 2, 3]
    made = [r for k in range(4) for out in lines._numbered(iter([dealt.slice(k, 1)])) for r in out.to_pylist()]
    assert [r["id"] for r in made] == sorted({r["id"] for r in made}) and len(made) == n
    assert [(r["doc_id"], r["key"], r["line"]) for r in made] == [(x[1] if x[0] else None, x[2], k) for x in order for k in (0, 1)]
    assert [r["prefix"] for r in made] == [[2 * k + 1 - j] for k in range(len(order)) for j in (0, 1)]


def test_clashing_columns(spark, rows):
    extra = {"__id": 1, "__key": 2, "__kept": 3, "__gone": 4, "__host": 5, "__of": 6, "__content": 7, "lists": 8, "host": 9, "blocked": 10, "__url": 11}
    docs = spark.createDataFrame([(r[0], r[1], r[3], r[4]) for r in rows], "doc_id long, text string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in extra.items()})
    items = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    for out in (quality.apply(docs), quality.apply(docs, held=0), lines.apply(docs, lines.judge(docs)), jaccard.keep(docs), decontam.keep(docs, items)):
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    for judged in (licenses.scans(docs), substrings.removed(docs), mixing.mix(docs), quality.judge(docs), tokens.counts(docs, model_path())):
        assert judged.count() == len(rows)
    captures = docs.select(F.lit("http://a.com/").alias("url"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), *extra)
    out = urls.judge(captures, spark.createDataFrame([("l", "domain", "a.com", "add", "2024-01-01")], "list string, kind string, key string, action string, day string"))
    assert out.filter("blocked AND host = 'a.com' AND lists = 'l'").count() == len(rows)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, rnd.randrange(2, 60)) for _ in range(200)] + [(70, 70), (7, 3), (3, 7)]
    group = {x: {x} for e in edges for x in e}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(g) for x, g in group.items() if len(g) > 1}


def test_licence_rows(spark):
    texts = [None, "", "Released under the MIT License.", "Released under the MIT License.", "word " * 200_000 + ".\nSPDX-License-Identifier: Apache-2.0 OR My-Own\n"]
    got = licenses.scans(spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.licence) for r in got) == [("1", ""), ("2", "MIT"), ("3", "MIT"), ("4", "Apache-2.0,my-own"), ("None", "")]


def test_url_history(spark, limits):
    """A host with 300 entries, and captures at every day: each is judged by the last entry up to its day."""
    day = lambda k: str(np.datetime64("2023-01-01") + k)
    rnd = random.Random(8)
    entries = [("l", "domain", "hot.com", rnd.choice(["add", "remove"]), day(rnd.randrange(600))) for _ in range(300)]
    captures = spark.createDataFrame([(k, "http://a.hot.com/x", day(k)) for k in range(700)] + [(999, None, day(1))], "page_id long, url string, t string").withColumn("fetched_at", F.col("t").cast("timestamp"))
    got = {r.page_id: r.blocked for r in urls.judge(captures, spark.createDataFrame(entries, "list string, kind string, key string, action string, day string")).collect()}
    for k in range(700):
        known = [(d, a) for _, _, _, a, d in entries if d <= day(k)]
        last = max((d for d, _ in known), default=None)
        assert got[k] == (last is not None and all(a == "add" for d, a in known if d == last))
    assert not got[999]
    assert urls.judge(captures.limit(0), spark.createDataFrame(entries, "list string, kind string, key string, action string, day string")).count() == 0


def test_urls(spark, limits):
    entries = spark.createDataFrame([("l", "domain", "a.com", "add", "2024-01-10"), ("l", "domain", "a.com", "remove", "2024-02-01"), ("l", "prefix", "b.com/x", "add", "2024-01-01"), (None, "domain", "c.com", "add", "2024-01-01")], "list string, kind string, key string, action string, day string")
    asked = [("http://www.a.com/1", "2024-01-10", True), ("http://www.a.com/1", "2024-02-01", False), ("http://www.a.com/1", "2024-01-09", False), ("http://aa.com/", "2024-01-15", False), ("https://u@B.com:80/x/y?q", "2024-03-01", True), ("https://b.com/xy", "2024-03-01", False), (None, "2024-03-01", False), ("junk", "2024-03-01", False), ("http://c.com", None, False), ("http://www.a.com/1", "2024-01-10", True)]
    captures = spark.createDataFrame([(k, u, t) for k, (u, t, _) in enumerate(asked)], "page_id long, url string, t string").withColumn("fetched_at", F.col("t").cast("timestamp"))
    got = {r.page_id: r.blocked for r in urls.judge(captures, entries).collect()}
    assert got == {k: x for k, (_, _, x) in enumerate(asked)}
    assert urls.judge(captures, entries.limit(0)).filter("blocked").count() == 0


def low(text):
    """A-Z in lower case, other letters as they are."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_decontamination(spark, docs, rows, limits):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = [(1, " ".join((rows[0][1]).split()[3:20]).upper()), (2, "w1 W2"), (3, None), (4, ""), (12, rows[12][1]), (None, "w3 w9"), (2, "w5")]
    windows = {}
    for i, t in items:
        w = words.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    expected = []
    for r in rows:
        w, hit, found = words.findall(low(r[1])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x - {None}
        expected.append((str(r[0]), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    table = spark.createDataFrame([(*x, "k") for x in items], ITEMS)
    got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.judge(docs, table).collect()]
    assert sorted(got) == sorted(expected)


def test_proximity(spark):
    texts = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a b c"), (4, "a x x x b c")], "doc_id long, text string")
    built = decontam.index(texts)
    ids = built.select("segment", F.posexplode("docs").alias("place", "doc_id"))
    found = decontam.search(built, spark.createDataFrame([(1, "A b c")], "item_id long, text string"), slop=2)
    assert {r.doc_id for r in found.join(ids, ["segment", "place"]).collect()} == {1, 3}


def test_quality(spark):
    same = "subscribe to our newsletter today and read more every day of the whole week"
    texts = [(k, f"{same}\n{' '.join(f'u{k}x{j}' for j in range(60))}", "s") for k in range(300)] + [(1000 + k, "\n".join([same] * 2 + [f"{same} number {k} here {j}" for j in range(3)]), "s") for k in range(3)] + [(2000, "\n".join([same] * 5), "s")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()}
    assert all(got[k].kept and got[k].removed_words == 14 for k in range(300))
    assert not got[2000].kept and got[2000].n_dup_lines == 4


def test_quality_of_a_hot_host(spark):
    """Boilerplate in 5 % of a host's 4,000 documents is above its limit of 63; a line in 63 of them isn't."""
    own = lambda k: " ".join(f"u{k}x{j}" for j in range(60))
    shared = lambda k: "all rights reserved by us" if k < 200 else "a rare line of ours" if k < 263 else ""
    texts = [(k, f"{shared(k)}\n{own(k)}", "s") for k in range(3998)] + [(5000, "\n".join(["all rights reserved by us"] * 40 + [own(5000)[:200]]), "s"), (5001, own(5001), "s")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()}
    assert {k for k, r in got.items() if r.removed_words} == {*range(200), 5000}
    assert all(got[k].removed_words == 5 and got[k].kept for k in range(200))
    assert got[5000].removed_words == 200 and not got[5000].kept


def shared_corpus():
    """The corpus, and lines that many documents of a source share; judged in plain Python."""
    rows = [r for r in corpus(6, 90)]
    line = "Subscribe  to our Newsletter\ttoday"
    rows = [(r[0], f"{line}\n{r[1]}\n{line.upper()}" if r[1] and r[0] is not None and r[0] % 2 else r[1], *r[2:]) for r in rows]
    footer = [f"f{k} a{k} b{k} c{k}" for k in range(20)]
    for k in range(24):
        own = " ".join(f"own{k}x{j}" for j in range(10 + 50 * (k % 2)))
        rows.append((500 + k, "\n".join([*footer, own]), "en", "s1" if k < 12 else None, 9, "k", "h", 1))
    return rows


def judged(rows):
    """The counts, kept and the text without lines above the limit of each row."""
    low_key = lambda line: low(" ".join(WORD.findall(line)))
    holds = {}
    for host, text in {(r[3], r[1]) for r in rows}:
        for key in {low_key(x) for x in (text or "").split("\n")} - {""}:
            holds.setdefault((host, key), set()).add(text)
    size = {h: len({r[1] for r in rows if r[3] == h}) for h in {r[3] for r in rows}}
    above = {(h, k) for (h, k), texts in holds.items() if len(texts) > 10 and len(texts) ** 2 > size[h]}
    out = []
    for r in rows:
        text, words = r[1] or "", WORD.findall(r[1] or "")
        raw = [x for x in text.split("\n") if WORD.findall(x)]
        triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        again = {p for k, t in enumerate(triples) if triples.count(t) > 1 for p in range(k, k + 3)}
        bad = len(words) < 50 or 2 * len(again) > len(words)
        gone = sum(len(WORD.findall(x)) for x in raw if (r[3], low_key(x)) in above)
        left = "\n".join(x for x in text.split("\n") if (r[3], low_key(x)) not in above)
        counts = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(raw) - len(set(raw)), len(again), bad, gone)
        out.append((r[0], *counts, not bad and gone <= 0.8 * len(words), left))
    return out


def test_quality_apply(spark):
    rows = shared_corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = [(*r[:1], j[-1], *r[2:4], len(j[-1]) if j[7] else r[4], *r[5:]) for r, j in zip(rows, judged(rows), strict=True) if j[-2]]
    assert 0 < sum(j[7] > 0 for j in judged(rows) if j[-2]) and any(j[7] and not j[6] and not j[-2] for j in judged(rows))
    for held in (50_000, 0):
        got = quality.apply(docs, held=held)
        assert got.columns == docs.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_quality_rows(spark):
    """All counts and kept of op7 against plain Python."""
    rows = shared_corpus()
    got = quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(x[:-1]) for x in judged(rows))


def test_html():
    page = '<html><body><header>top</header><nav><a href="/">home</a></nav><div class="post"><h1>Title</h1><p>One &amp; two<br>three</p><p>a < b <b>bold</b>ly</p><div class="ad">buy</div><ul><li>x</li><li>y</li></ul></div><div class="comments"><p>me too</p></div><footer>end</footer><script>var a="</p>"</script></body>'
    assert html.extract_one(page, None) == ("Title\nOne & two three\na < b boldly\nx\ny", "body>div.post")
    assert html.extract_one(None, None)[0] == "" and html.extract_one("plain", [])[0] == "plain"
    assert html.extract_one("<article><p>cut off &am", None)[0] == "cut off &am"


@pytest.mark.parametrize(("page", "text"), [
    ('<div class="layout with-sidebar"><article><h1>T</h1><p>some text</p></article><div class="sidebar"><p>side</p></div></div>', "T\nsome text"),
    ("<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>text of it</p><footer>tags</footer></article></body>", "Title\ntext of it"),
    ('<article><p class="form-factor">one</p><p id="search-results">two</p><p>press <label>this</label> now</p><p>a <span class="share">x</span> b</p></article>', "one\ntwo\npress this now\na b"),
    ('<div class="header"><p>a long main text that is most of the page</p></div><p>x</p>', "a long main text that is most of the page\nx"),
    ('<div class="ad">an advert that is longer than the article</div><article><p>short</p></article>', "short"),
    ('<div class="post-comments"><p>one</p></div><div class="a"><p>main text</p><p>more</p></div><div class="site-footer">f</div><div class="cookie-banner">c</div>', "main text\nmore"),
])
def test_html_names(page, text):
    assert html.extract_one(page, None)[0] == text


def test_deep_and_long_pages():
    """Memory grows with the page, not with its depth times its length."""
    import tracemalloc

    tracemalloc.start()
    for page, n in (("<div>" * 40_000 + "<p>deep</p>", 4), ("<div><p>t</p>" * 40_000, 79_999), ("<b>" * 40_000 + "<p>x</p>" * 20_000, 39_999)):
        assert len(html.extract_one(page, None)[0]) == n
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_host_consensus(spark, limits):
    """Two templates on one host win; a page whose main text the winners don't hold is read by itself."""
    one = lambda k: f'<body><div class="post p{k}"><p>text of page {k}{" on" * 50}</p><p>and more</p></div><div class="teasers">{"other news " * (40 if k == 3 else 1)}</div></body>'
    two = lambda k: f'<body><section class="story"><p>story {k}{" on" * 50}</p></section><section class="most-read">a</section></body>'
    odd = '<body><div class="post p9">no</div><div class="entry"><p>the real text of this page is here</p></div></body>'
    rows = [(k, "http://h.com/1", one(k) if k % 2 else two(k), "x") for k in range(20)] + [(100, "http://h.com/odd", odd, "x"), (101, "http://h.com/none", None, None), (1, "http://h.com/1", one(1), "x"), (None, None, "<p>alone</p>", "x")]
    got = [(r.page_id, r.text, r.path) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, paths string")).collect()]
    text = dict((i, t) for i, t, _ in got)
    assert len(got) == len(rows) and [t for i, t, _ in got if i == 1] == ["text of page 1" + " on" * 50 + "\nand more"] * 2
    assert text[2] == "story 2" + " on" * 50 and text[100] == "the real text of this page is here" and text[101] == "" and text[None] == "alone"
    assert {p for i, _, p in got if i is not None and i < 20 and i != 3} == {"body>div.p.post", "body>section.story"}


def test_jaccard(docs, rows, limits):
    sets = []
    for k, r in enumerate(rows):
        w = WORD.findall(r[1] or "")
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if n else frozenset({k}))
    linked = {a: {b for b in range(len(rows)) if a != b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8} for a in range(len(rows))}
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[a], *(group[b] for b in linked[a])]) for a in range(len(rows))]
    name = {g: min((rows[a][0] for a in range(len(rows)) if group[a] == g and rows[a][0] is not None), default=None) for g in group}
    expected = sorted((str(rows[a][0]), str(name[group[a]]), len(linked[a])) for a in range(len(rows)))
    got = jaccard.classes(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == expected
    assert sum(r.stays for r in got) == len(set(group))


def test_pairs_of_large_blocks():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rnd.random(200) < 0.93], rnd.integers(0, 2**63, 8).astype(np.uint64)])) for _ in range(60)]
    i, j = jaccard.pairs(sets, None)
    brute = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == brute


def test_tokens(docs, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rnd = random.Random(2)
    alphabet = ["a", " ", "  ", "▁", "é", "日本", "😀", "\n", "the", "ing", "members", "<s>", "aaaa", "\x00", "'"]
    texts = ["", " ", "a" * 3000, "ab" * 900, *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(800))]
    assert tokens.count(texts, model_path()) == [len(x) for x in model.encode(texts)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.counts(docs, model_path()).collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in rows)
