"""Whole results: cases that a shortened job would miss."""

import hashlib

from granary.llm import decontaminate, fingerprint, licenses, urlgraph, viterbi

MIT = """MIT License

Copyright (c) 2001 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of Example & Sons Inc. nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
GPL = """# This program is free software{} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
"""


def test_genuine_licences_wrapped_and_on_one_line(spark):
    cases = [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + ENDORSE, "BSD-3-Clause"), (BSD + ENDORSE + "\n" + BSD, "BSD-2-Clause,BSD-3-Clause"), (GPL.format(";", 2), "GPL-2.0-or-later"), (GPL.format(":", 3), "GPL-3.0-or-later"), (APACHE, "Apache-2.0")]
    texts = [(t, want) for t, want in cases] + [(t.replace("\n", "\r\n"), want) for t, want in cases] + [(" ".join(t.split()), want) for t, want in cases]
    texts.append(("Licensed under" + "." * 4000 + "CC BY 4.0", "CC-BY-4.0"))  # longer than any sentence before normalisation
    texts.append(("This is not licensed under CC BY 4.0.", ""))
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(texts)}


def test_odd_texts_for_licences(spark):
    rows = [(1, None, "mine", 3), (2, "", "", 0), (2, "", "", 0), (None, "Released under the MIT license.", "", 0), (4, "filler words. " * 30_000 + "\nAll rights reserved.\n", "", 0), (5, "license " * 50_000, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, known string, n_known int").repartition(3)
    got = sorted(((r.doc_id, r.n_known, r.licenses) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (2, 0, ""), (None, 1, "MIT"), (4, 1, "proprietary"), (5, 0, "")], key=str)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_each_row_gives_one_row_at_every_benchmark_size(spark):
    rows = [(1, "a b c x x"), (1, "l m n o"), (None, "b c d"), (None, "x"), (2, "a b c d e f g h i j k l m n o"), (2, "a b c d e f g h i j k l m n o"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, "a b c"), (2, "m n o"), (3, "b c d"), (1, "h i j"), (1, "a b")], "item_id long, text string")
    one, many = (sorted(((r.doc_id, r.n_words, r.hit, r["items"]) for r in decontaminate.matches(docs, bench, limit=n).withColumn("hit", decontaminate.union_length("span_start", "span_end")).collect()), key=str) for n in (99, 3))
    want = [(1, 5, 3, ["1"]), (1, 4, 3, ["2"]), (None, 3, 3, ["3"]), (None, 1, 0, []), (2, 15, 10, ["1", "2", "3"]), (2, 15, 10, ["1", "2", "3"]), (3, 0, 0, [])]
    assert one == many == sorted(want, key=str)


def test_items_without_an_id_hit_words_too(spark):
    import duckdb

    word = lambda i: f"w{i}"
    passage = " ".join(map(word, range(20)))
    docs = spark.createDataFrame([(1, f"x {passage} y", "mine"), (2, None, ""), (3, "w5 w6", ""), (3, passage, ""), (None, passage, "")], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(None, passage), (7, passage), (7, "w5 w6"), (8, None), (9, " ")], "item_id long, text string")
    for limit in (99, 3):
        m = decontaminate.matches(docs, bench, limit=limit)
        got = sorted(((r.doc_id, r["items"]) for r in m.collect()), key=str)
        assert got == sorted([(1, ["7", None]), (2, []), (3, ["7"]), (3, ["7", None]), (None, ["7", None])], key=str)
    ours = sorted((tuple(r.asDict().items()) for r in decontaminate.judged(docs, bench).collect()), key=str)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", bench.toPandas().astype({"item_id": "Int64"}))
    names = [k for k, _ in ours[0]]
    theirs = con.sql(decontaminate.OP5_SQL).fetchall()
    columns = con.sql(decontaminate.OP5_SQL).columns
    want = sorted((tuple((k, dict(zip(columns, r, strict=True))[k]) for k in names) for r in theirs), key=str)
    assert ours == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    far = spark.createDataFrame([(5, "z " * 500 + passage + " end", "h")], "doc_id long, text string, hits string")
    assert [len(r.text.split()) for r in decontaminate.clean(far, bench, cut_spans=True).collect()] == [501]
    assert decontaminate.judged(docs.limit(0), bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == 5


def test_no_row_of_large_ids_vanishes(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_IN_RANGE", 10)
    for ids in ([i * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63) for i in range(150)], [(1 << 62) + 2 * i + 1 for i in range(200)], [(1 << 63) - 1 - i for i in range(100)], [-(1 << 63) + 3 * i for i in range(100)]):
        docs = spark.createDataFrame([(k, f"text {k}, and more.") for k in ids] + [(ids[50], "again")], "doc_id long, text string")
        order = sorted([(k, f"text {k}, and more.") for k in ids] + [(ids[50], "again")])
        want = sorted((k, hashlib.sha256(fingerprint.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (k, t) in enumerate(order))
        assert sorted((r.doc_id, r.edited_sha256) for r in fingerprint.compared(docs).collect()) == want


def test_distrust_reaches_over_many_links(spark):
    link = '<a href="http://h{}.io/">x</a>'.format
    rows = [(i, f"http://h{i}.io/", link(i + 1)) for i in range(12)] + [(12, "http://h12.io/", '<a href="http://bad.net/">x</a>'), (13, "http://bad.net/", None), (14, "http://ok.org/fr/", None)]
    got = {r.page_id: r for r in urlgraph.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(14)] == ["block"] * 14 and got[14].verdict == "allow"
    for i in range(13):
        assert abs(got[i].distrust - 0.15 * 0.85 ** (13 - i)) < 1e-9


def test_ranks_of_a_cycle_converge(spark):
    link = '<a href="http://{}/">x</a>'.format
    rows = [(1, "http://ok.org/fr/", link("a.io")), (2, "http://a.io/", link("ok.org")), (3, "http://bad.net/", None)]
    got = {r.page_id: r for r in urlgraph.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert abs(got[1].trust - 0.15 / (1 - 0.85**2)) < 1e-9 and abs(got[2].trust - 0.15 * 0.85 / (1 - 0.85**2)) < 1e-9


def test_ids_are_those_of_the_bpe_model(spark):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=viterbi.MODEL)
    texts = ["the river ran", "x", " a", "a  b", "ends ", "no\nspace\t", "ñandú the the", "☃𝄞 é", "internationalisation of unknown wordforms, 12345!", "   three", "zq" * 500, "日本語の文章", "b   \n c"]
    got = {r.doc_id: r for r in viterbi.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].ids for i in range(len(texts))] == [theirs.encode(t) for t in texts] and all(r.round_trip for r in got.values())


def test_first_copies_stay(spark):
    import random

    from granary.llm import substrings

    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdef ", k=r.randint(80, 300)))
    shared = [word() for _ in range(4)]
    rows = [(i, word() + r.choice(shared) + word() + r.choice(shared)) for i in range(12)]
    rows += [(i + 12, t) for i, t in rows[:3]] + [(40, rows[1][1][:90] + rows[2][1][40:]), (41, None), (42, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (1 << 21, 300):  # also with every block parted
        substrings.BLOCK, before = block, substrings.BLOCK
        try:
            got = {x.doc_id: x for x in substrings.removed(docs, 60, 25, later_only=True).collect()}
            both = {x.doc_id: x for x in substrings.removed(docs, 60, 25).collect()}
        finally:
            substrings.BLOCK = before
        seen, all_ = set(), [(t or "")[i : i + 60] for _, t in rows for i in range(len(t or "") - 59)]
        for k, t in sorted(rows):
            t = t or ""
            later = [i for i in range(len(t) - 59) if t[i : i + 60] in seen or t[i : i + 60] in [t[j : j + 60] for j in range(i)]]
            copies = [i for i in range(len(t) - 59) if all_.count(t[i : i + 60]) > 1]
            seen |= {t[i : i + 60] for i in range(len(t) - 59)}
            for name, starts in ((got, later), (both, copies)):
                gone = {j for i in starts for j in range(i, i + 60)}
                assert name[k].text == "".join(c for j, c in enumerate(t) if j not in gone), (block, k)
                assert name[k].n_removed == len(gone) and name[k].repeats == bool(gone)


def test_likeness_counts_what_both_texts_share(spark):
    import random
    from collections import Counter

    r = random.Random(11)
    clause = lambda: f"{r.choice('abcdef')} {r.randint(0, 6)}"
    texts = [". ".join(clause() for _ in range(r.choice([0, 1, 3, 12, 60]))) for _ in range(50)] + ["", "x" * 30_000, ", ".join(str(i) for i in range(4000))]
    docs = spark.createDataFrame([(7 * i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(3)
    got = {x.doc_id: x for x in fingerprint.compared(docs).collect()}

    def parts(t):
        found = [p.strip() for p in fingerprint.PARAGRAPH.findall(t.encode())]
        return Counter(p for p in found if p) if any(found) else Counter([t.encode()])

    def like(a, b):
        x, y = parts(a), parts(b)
        return (x & y).total() / (x | y).total()

    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        row = got[7 * i]
        assert abs(row.near_next - like(t, after)) < 1e-12 and abs(row.near_edited - like(t, fingerprint.edited(t, after))) < 1e-12
    assert all(row.fingerprint == fingerprint.fingerprint(texts[k // 7]) for k, row in got.items())
