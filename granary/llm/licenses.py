"""License scans by sentence rules. [native]

A text's sentences are normalised and looked up among known licence sentences, which may be wrapped over lines;
the sequence of their identifiers is matched against ordered rules of licences: longer rules first, then as they
stand. Identifiers that a rule has used are no longer there for later ones.

Known sentences are those of genuine texts and headers, and for each licence of NAMES its titles, its SPDX tag, and
notices of the form `this work is licensed under the ...`.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known licence sentences, normalised: lower case, letters and digits, one space between words.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-may-not-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl2-notice": "this program is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by": "licensed under cc by 4 0",
    "all-rights": "all rights reserved",
}
#: Ordered rules: (licence, identifiers that must stand in this order with no other known sentence between them).
RULES = [
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-may-not-use", "apache-copy"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "as-is"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-hope"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("proprietary", ["all-rights"]),
]
#: Whole sentences of the genuine licence texts, with variants, each up to its own sentence end. OP7_SQL doesn't know them.
_FREE = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_ENDORSE = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
GENUINE = [
    ("apache-notice", "licensed under the apache license version 2 0 the license"),
    ("apache-may-not-use", "you may not use this file except in compliance with the license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and noninfringement"),
    ("gpl-free", f"{_FREE} either version 2 of the license or at your option any later version"),
    ("gpl2-only", f"{_FREE} version 2 of the license"),
    ("gpl3-free", f"{_FREE} either version 3 of the license or at your option any later version"),
    ("gpl3-only", f"{_FREE} version 3 of the license"),
    ("bsd-source", _SOURCE),
    ("bsd-binary", _BINARY),
    ("bsd-endorse", f"{_ENDORSE} without specific prior written permission"),
]
#: In the GPL's notice a sentence ends after `software;` or `software:`, so that the long one stands alone or with its subject.
GENUINE += [(k, f"this program is free software {s}") for k, s in GENUINE if s.startswith(_FREE)]
#: Rules of the identifiers that only genuine texts have.
GENUINE_RULES = [("GPL-2.0-only", ["gpl2-only", "gpl-hope"]), ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope"]), ("GPL-3.0-only", ["gpl3-only", "gpl-hope"])]
#: Licences by their names, normalised. The first names are titles as well; those after None stand only in notices.
NAMES = {
    "MIT": ["mit license", "mit licence", "expat license", None, "mit"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache software license version 2 0", None, "apache 2 0", "apache v2", "apache 2 0 license", "apache license"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2 0", "gnu general public license version 2 june 1991", None, "gpl version 2", "gplv2", "gpl v2", "gpl 2 0", "gnu gpl version 2", "gnu gpl v2"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3 0", "gnu general public license version 3 29 june 2007", None, "gpl version 3", "gplv3", "gpl v3", "gpl 3 0", "gnu gpl version 3", "gnu gpl v3"],
    "GPL-2.0-or-later": [None, "gnu general public license version 2 or later", "gnu general public license version 2 or any later version", "gnu gpl version 2 or later", "gplv2 or later"],
    "GPL-3.0-or-later": [None, "gnu general public license version 3 or later", "gnu general public license version 3 or any later version", "gnu gpl version 3 or later", "gplv3 or later"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1 february 1999", None, "lgpl version 2 1", "lgplv2 1", "lgpl 2 1", "gnu lgpl version 2 1"],
    "LGPL-2.1-or-later": [None, "gnu lesser general public license version 2 1 or later", "lgplv2 1 or later"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "gnu lesser general public license version 3 29 june 2007", None, "lgpl version 3", "lgplv3", "lgpl 3 0", "gnu lgpl version 3"],
    "LGPL-3.0-or-later": [None, "gnu lesser general public license version 3 or later", "lgplv3 or later"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu affero general public license version 3 19 november 2007", None, "agpl version 3", "agplv3", "agpl 3 0", "gnu agpl version 3"],
    "AGPL-3.0-or-later": [None, "gnu affero general public license version 3 or later", "agplv3 or later"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "2 clause bsd license", "freebsd license", None, "bsd 2 clause", "2 clause bsd"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "modified bsd license", "3 clause bsd license", "revised bsd license", None, "bsd 3 clause", "3 clause bsd", "bsd license"],
    "0BSD": ["bsd zero clause license", "zero clause bsd license", None, "0bsd"],
    "ISC": ["isc license", "isc licence", None, "isc"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", None, "mpl 2 0", "mpl version 2 0"],
    "EPL-1.0": ["eclipse public license v 1 0", "eclipse public license version 1 0", "eclipse public license 1 0", None, "epl 1 0"],
    "EPL-2.0": ["eclipse public license v 2 0", "eclipse public license version 2 0", "eclipse public license 2 0", None, "epl 2 0"],
    "Unlicense": ["the unlicense", None, "unlicense"],
    "CC0-1.0": ["creative commons zero v1 0 universal", "cc0 1 0 universal", "creative commons cc0 1 0 universal", None, "cc0", "cc0 1 0"],
    "CC-BY-4.0": ["creative commons attribution 4 0 international", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 international public license", None, "cc by 4 0 license"],
    "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0 international", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international public license", None, "cc by sa 4 0 license"],
    "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international public license", None, "cc by nc 4 0 license"],
    "CC-BY-ND-4.0": ["creative commons attribution noderivatives 4 0 international", "creative commons attribution noderivatives 4 0 international license", None, "cc by nd 4 0", "cc by nd 4 0 license"],
    "CC-BY-NC-SA-4.0": ["creative commons attribution noncommercial sharealike 4 0 international", "creative commons attribution noncommercial sharealike 4 0 international license", None, "cc by nc sa 4 0", "cc by nc sa 4 0 license"],
    "Zlib": ["zlib license", None, "zlib"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license version 1 0 august 17th 2003"],
    "Artistic-2.0": ["artistic license 2 0", "the artistic license 2 0"],
    "WTFPL": ["do what the fuck you want to public license", None, "wtfpl"],
    "PostgreSQL": ["postgresql license", "postgresql licence"],
    "NCSA": ["university of illinois ncsa open source license"],
    "EUPL-1.2": ["european union public licence v 1 2", "european union public license 1 2", None, "eupl 1 2"],
    "CDDL-1.0": ["common development and distribution license 1 0", "common development and distribution license cddl version 1 0"],
    "MS-PL": ["microsoft public license", "microsoft public license ms pl"],
}
#: What a notice has before the name.
_SUBJECT = "(?:(?:this|the|all) (?:work|project|program|software|source|source code|code|file|files|library|package|repository|content|document|documentation|model|dataset|data|text) (?:is |are |may be )?|it is )?"
NOTICE = rf"{_SUBJECT}(?:dual |also )?(?:licensed|released|distributed|redistributed|made available|available|published|provided|offered) under (?:the terms of |the terms and conditions of )?(?:the |a |an )?"
#: A tag's value stands in the sentence of its name.
TAG = r"(?i)spdx-license-identifier:[ \t]*"
_TITLES = {k: [n for n in names[: names.index(None) if None in names else len(names)]] for k, names in NAMES.items()}
SHORT = {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', k.lower())}": f"spdx-{k}" for k in NAMES}
SHORT |= {n: f"title-{k}" for k, names in _TITLES.items() for n in names}
NOTICES = {f"under {n}": f"notice-{k}" for k, names in NAMES.items() for n in names if n}
_LESSER = "you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation"
_EITHER = "either version {} of the license or at your option any later version"
GENUINE += [
    (f"{k}-{form}", f"{subject}{_LESSER.format(word)} {end}")
    for k, word, version in (("lgpl21", "lesser", "2 1"), ("lgpl3", "lesser", "3"), ("agpl3", "affero", "3"))
    for form, end in (("free", _EITHER.format(version)), ("only", f"version {version} of the license"))
    for subject in ("", "this library is free software ", "this program is free software ")
]
GENUINE += [("lgpl-free", f"{subject}{_LESSER.format('lesser')}") for subject in ("", "this library is free software ")]
GENUINE += [("later-2.1", _EITHER.format("2 1"))]  # `Foundation;` ends a sentence
_ISC = "permission to use copy modify {} distribute this software for any purpose with or without fee is hereby granted"
GENUINE += [
    *(("isc-grant", f"{_ISC.format(x)} provided that the above copyright notice and this permission notice appear in all copies") for x in ("and", "and or")),
    *(("0bsd-grant", _ISC.format(x)) for x in ("and", "and or")),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v"),  # `v. 2.0` ends a sentence
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v2 0"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("epl2-notice", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("epl2-notice", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which accompanies this distribution and is available at https www eclipse org legal epl 2 0"),
]
GENUINE_RULES += [
    ("ISC", ["isc-grant"]), ("0BSD", ["0bsd-grant"]), ("MPL-2.0", ["mpl-notice", "mpl-copy"]), ("MPL-2.0", ["mpl-notice"]), ("Unlicense", ["unlicense"]), ("Zlib", ["zlib-as-is", "zlib-grant"]), ("EPL-2.0", ["epl2-notice"]), ("LGPL-2.1-or-later", ["lgpl-free", "later-2.1"]),
    *((f"{name}-{'or-later' if form == 'free' else 'only'}", [f"{k}-{form}"]) for k, name in (("lgpl21", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"), ("agpl3", "AGPL-3.0")) for form in ("free", "only")),
    *((k, [f"{form}-{k}"]) for k in NAMES for form in ("spdx", "title", "notice")),
]
#: A sentence may go on over line ends, and ends at them, after . ! ? ; : that white space follows, and at the text's end.
_HARD = r"[.!?;:](?:[ \t]+|(?=\n))"
#: The holder's name in the BSD clause is anyone's, with stops as in `Inc.`, of at most 300 characters.
HOLDER = r"^neither the names? of .+ nor the names of (?:its|any|other|their) contributors"
#: A copyright notice without a stop may stand before these on one line.
AFTER_NOTICE = ("mit-grant", "apache-notice")
CLUES = "(?i)licen[sc]|permission|warranty|redistribut|rights reserved|copyright|public domain|creative commons|cc0|released under|available under|distributed under|published under|provided under|offered under"


USED = " | "


def known(text: F.Column) -> F.Column:
    """Identifiers of the known sentences of a text, in its order."""
    ids = SHORT | {s: k for k, s in GENUINE} | {s: k for k, s in SENTENCES.items()}
    lookup = F.create_map(*map(F.lit, chain.from_iterable(ids.items())))
    words = lambda s: "[ \n]+".join(map(re.escape, s.split()))
    held = "[ \n]+".join(["neither", "the", "names?", r"of[ \n]+[a-z0-9 \r\n]{1,300}?[ \r\n]+nor", "the", "names", "of", "(?:its|any|other|their)", "contributors"])
    start = " ".join(_ENDORSE.split()[: _ENDORSE.split().index("contributors") + 1])
    each = [held + "[ \n]+" + words(s.removeprefix(start)) if s.startswith(start) else words(s) for s in sorted(ids, key=lambda s: (-len(s), s))]
    later = "|".join(words(s) for k, s in GENUINE if k in AFTER_NOTICE)
    each.append(f"{NOTICE.replace(' ', '[ \n]+')}(?:{'|'.join(words(s.removeprefix('under ')) for s in sorted(NOTICES, key=lambda s: (-len(s), s)))})")
    pattern = rf"(?<![^\r\n]) ?(?:{'|'.join(each)}|[a-z0-9 ]*\bcopyright [a-z0-9 ]+? (?:{later}))(?= ?(?:[\r\n]|\z))"
    # \r marks a sentence end, \n a line end
    plain = F.translate(F.lower(F.regexp_replace(text, TAG, "spdx-license-identifier ")), "\r", "\n")
    plain = F.regexp_replace(F.regexp_replace(plain, _HARD, "\r"), "[^a-z0-9\r\n]+", " ")
    found = F.when(F.lower(text).rlike(CLUES), F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    notice = f"^.*copyright .* (?=(?:{'|'.join(s for k, s in GENUINE if k in AFTER_NOTICE)})$)"
    sentence = lambda s: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(s, "[ \r\n]+", " ")), HOLDER, start), notice, "")
    notices = F.create_map(*map(F.lit, chain.from_iterable(NOTICES.items())))
    named = F.transform(found, sentence)
    return F.transform(named, lambda s: F.coalesce(F.element_at(lookup, s), F.element_at(notices, F.regexp_replace(s, f"^{NOTICE}", "under "))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, known (identifiers in order), licenses (sorted, each once) of every row of docs.

    Null and empty texts: no known sentence, licenses ''. A sentence of unusual white space or punctuation, of any
    length before normalisation, or wrapped over lines (marks of comments before them too) is still recognised.
    Repeated rows stay; an empty table gives no rows; further columns are ignored.
    """
    found = docs.select("doc_id", known(F.coalesce(F.col("text"), F.lit(""))).alias("k"))
    # each identifier stands between blanks of its own, so that neighbouring matches don't share one
    line = F.concat(F.lit("  "), F.array_join("k", "  "), F.lit("  "))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(sequence(ids)).alias("ids")) for name, ids in ordered()))
    start = F.struct(line.alias("line"), F.expr("cast(array() as array<string>)").alias("names"))

    def tried(acc, rule):
        names = F.when(acc["line"].contains(rule["ids"]), F.concat(acc["names"], F.array(rule["name"]))).otherwise(acc["names"])
        return F.struct(F.replace(acc["line"], rule["ids"], F.lit(USED)).alias("line"), names.alias("names"))

    return found.select(
        "doc_id", F.size("k").cast("bigint").alias("n_known"), F.array_join("k", " ").alias("known"),
        F.array_join(F.array_sort(F.array_distinct(F.aggregate(rules, start, tried)["names"])), ",").alias("licenses"),
    )


def sequence(ids: list[str]) -> str:
    return f" {'  '.join(ids)} "


def ordered() -> list[tuple[str, list[str]]]:
    return sorted(RULES + GENUINE_RULES, key=lambda r: -len(r[1]))


def op7_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_KNOWN = ", ".join(f"('{k}', '{s}')" for s, k in (SHORT | {s: k for k, s in GENUINE} | {s: k for k, s in SENTENCES.items()}).items())
_NAMED = ", ".join(f"('{k}', '{s}')" for s, k in NOTICES.items())
_TRIED = "SELECT r, doc_id, n_known, known, '  ' || replace(known, ' ', '  ') || '  ' AS line, '' AS names FROM lines"
for _name, _ids in ordered():
    _s = sequence(_ids)
    _TRIED = f"SELECT r, doc_id, n_known, known, replace(line, '{_s}', '{USED}') AS line, names || CASE WHEN contains(line, '{_s}') THEN ',{_name}' ELSE '' END AS names FROM ({_TRIED})"
OP7_SQL = rf"""
WITH ids(k, s) AS (VALUES {_KNOWN}), notices(k, s) AS (VALUES {_NAMED}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '{TAG}', 'spdx-license-identifier ', 'g'), '[.!?;:][ \t]+|[\r\n]+') AS ss FROM documents),
each AS (SELECT r, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s, i FROM (SELECT r, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM docs)),
found AS (SELECT r, string_agg(coalesce(ids.k, notices.k), ' ' ORDER BY i) AS known, count(*) AS n FROM each LEFT JOIN ids ON ids.s = each.s LEFT JOIN notices ON notices.s = regexp_replace(each.s, '^{NOTICE}', 'under ') AND each.s <> notices.s WHERE ids.k IS NOT NULL OR notices.k IS NOT NULL GROUP BY r),
lines AS (SELECT r, doc_id, coalesce(n, 0) AS n_known, coalesce(known, '') AS known FROM docs LEFT JOIN found USING (r)),
tried AS ({_TRIED})
SELECT doc_id, CAST(n_known AS BIGINT) AS n_known, known, array_to_string(list_sort(list_distinct(string_split(names[2:], ','))), ',') AS licenses FROM tried
"""
