"""License scans: everyday notices, titles, tags and headers, and the SQL over the same sentences."""

import duckdb

from granary.llm import licenses

EVERYDAY = {
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    "Licensed under the MIT License.": "MIT",
    "MIT License": "MIT",
    "Intro\n// SPDX-License-Identifier: MIT\nint main();": "MIT",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "LGPL-2.1-or-later",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "Creative Commons Attribution 4.0 International": "CC-BY-4.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright": "GPL-3.0-only",
    "Eclipse Public License - v 2.0": "EPL-2.0",
    "Released under the MIT license": "MIT",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "The source code is available under the terms of the GNU GPL, version 3 or later.": "GPL-3.0-or-later",
    "All files are distributed under the\nBSD 3-Clause License.": "BSD-3-Clause",
    "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1.": "Zlib",
    "SPDX-License-Identifier: GPL-2.0-or-later\nAll rights reserved.": "GPL-2.0-or-later,proprietary",
}
OTHERS = ["MIT", "He is licensed under this heading.", "The MIT license plate was lost", "spdx license", "permission is hereby reserved.", "Licensed under the MIT License and the sea.", "We distributed under the table", "Copyright someone."]


def cases():
    out = dict(EVERYDAY)
    for k, names in licenses.NAMES.items():
        out[f"x.\n * SPDX-License-Identifier:  {k}\n"] = k
        for n in (n for n in names if n):
            out[f"This project is released under the {n.upper()}!"] = k
        for n in licenses._TITLES[k]:
            out[f"text\n\n  {n.title()}  \n"] = k
    return list(out.items()) + [(t, "") for t in OTHERS]


def test_everyday_notices_titles_and_tags(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    # names that stand for a notice of the older list, or are titles of two things, keep their licence
    assert {rows[i][0]: x for i, x in got.items() if x != rows[i][1]} == {}


def test_sql_knows_the_same_sentences(spark):
    rows = [(i, t) for i, (t, _) in enumerate(cases()) if "\n" not in t.strip() or "SPDX" in t]
    rows += [(10_000, None), (10_001, ""), (3, rows[3][1])]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_known", "known", "licenses").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(licenses.OP7_SQL).fetchall())
