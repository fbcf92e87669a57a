"""Licence recognition by sentences and ordered rules.

Texts are cut into sentences, each sentence is normalised (letters and digits, lower case, single
spaces) and looked up by its hash among known licence sentences. The identifiers found, in order, are
matched against rules: ordered sequences of identifiers that make a licence. A longer rule goes first,
and what it covers no shorter rule matches again. All of it is one projection: no shuffle at all.

A licence text is mostly wrapped, often inside comments. So marks of comments and lists at a line's begin
are dropped, a single line end is white space, and a blank line ends a sentence, as . ! ? ; : do with white
space behind them. Titles and SPDX tags are known by their line: such a line is cut out as a sentence of
its own wherever it stands. The same steps are plain regular expressions in Spark and in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table

#: SPDX identifiers that a tag line may name.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: Older tags and what they are called now.
SPDX_OLD = (("AGPL-3.0", "AGPL-3.0-only"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-3.0", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-3.0", "LGPL-3.0-only"))
#: Titles that stand in a line of their own, with the licence they name.
TITLES = (
    ("MIT License", "MIT"), ("The MIT License", "MIT"), ("The MIT License (MIT)", "MIT"), ("ISC License", "ISC"), ("BSD 2-Clause License", "BSD-2-Clause"),
    ("BSD 3-Clause License", "BSD-3-Clause"), ("Mozilla Public License Version 2.0", "MPL-2.0"), ("Boost Software License - Version 1.0", "BSL-1.0"),
)
#: Sentences of public licences and notices, by identifier, as they are written.
SENTENCES = (
    ("apache2-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache2-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache2-obtain", "You may obtain a copy of the License at"),
    ("apache2-url", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-obtain-url", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-asis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-asis", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ccbync4-notice", "Licensed under CC BY-NC 4.0."),
    ("ccby4-notice", "Licensed under CC BY 4.0."),
    ("ccbysa4-notice", "Licensed under CC BY-SA 4.0."),
    ("ccby4-work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ccbysa4-work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-see", "See the GNU General Public License for more details."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant-and", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense-free", "This is free and unencumbered software released into the public domain."),
    ("mpl2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("cc0-work", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: Licences by ordered sequences of sentence identifiers.
RULES = (
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-header", "apache2-obtain", "apache2-url", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-header", "apache2-obtain-url", "apache2-asis", "apache2-see")),
    ("Apache-2.0", ("apache2-header",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-condition", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("CC-BY-4.0", ("ccby4-work",)),
    ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4-work",)),
    ("CC0-1.0", ("cc0-work",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL-2.1-or-later", ("lgpl-free",)),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("ISC", ("isc-grant", "mit-asis")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and", "mit-asis")),
    ("ISC", ("isc-grant-and",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
)
#: What may stand between a line's begin and its words: comment and list marks.
MARKS = r"\n[ \t\x0B\f]*(?:<!--|--|[*#/;%!>\-]+)?[ \t\x0B\f]*"
SPACE = r"[ \t\x0B\f]"
CUT = "\x01"
#: A tag's name, and how many licences one tag may join to the first by OR or AND.
TAG, JOINED_TAGS = rf"spdx-license-identifier:{SPACE}*\(*", 4


def normal(sentence: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", sentence.lower()))


def lines_known(titles=TITLES, spdx=SPDX) -> list[tuple[str, str, str]]:
    """(normalised line, identifier, licence) of titles and tags."""
    out = [(normal(t), "title-" + normal(t).replace(" ", "-"), licence) for t, licence in titles]
    tags = [*((x, x) for x in spdx), *SPDX_OLD]
    return out + [(normal("SPDX-License-Identifier " + x), "spdx-" + x.lower(), licence) for x, licence in tags]


def _parts(sentences=SENTENCES) -> dict[str, list[str]]:
    """The normalised pieces of each sentence: one, or several where . ! ? ; : cut it."""
    return {name: [n for x in re.split(r"(?<=[.!?;:])\s+", text) if (n := normal(x))] for name, text in sentences}


def known_sentences(sentences=SENTENCES, titles=TITLES, spdx=SPDX) -> dict[str, str]:
    """Identifier by normalised sentence; pieces are numbered, and the first sentence with a piece names it."""
    out = {n: name for n, name, _ in lines_known(titles, spdx)}
    for name, parts in _parts(sentences).items():
        for i, p in enumerate(parts, 1):
            if p in out and len(parts) == 1:
                raise ValueError(f"{name} is known as {out[p]}")
            out.setdefault(p, name if len(parts) == 1 else f"{name}.{i}")
    return out


def ordered_rules(rules=RULES, sentences=SENTENCES, titles=TITLES, spdx=SPDX) -> list[tuple[str, str]]:
    """(licence, identifiers as ``,a,,b,``: each has commas of its own, so that neighbours are told apart), longest sequence first."""
    known, parts = known_sentences(sentences, titles, spdx), _parts(sentences)
    out = {(licence, f",{i},") for _, i, licence in lines_known(titles, spdx)}
    out |= {(licence, "".join(f",{known[p]}," for x in ids for p in parts[x])) for licence, ids in rules}
    return sorted(out, key=lambda r: (-r[1].count(","), r))


def _title_pattern(titles=TITLES) -> str:
    """A line that is a title or a tag, whatever stands between its words and behind the last; lines are two line ends apart."""
    spaced = sorted({normal(t).replace(" ", r"[^A-Za-z0-9\n]+") for t, _ in titles}, key=lambda t: (-len(t), t))
    return r"(?i)\n((?:" + "|".join(spaced) + rf"|{TAG}[a-z0-9.+\-]+)[^A-Za-z0-9\n]*)\n"


#: Steps in turn: pattern and replacement, with $1 for the first group.
def steps(titles=TITLES) -> list[tuple[str, str]]:
    return [
        (r"\r\n?", "\n"),
        (MARKS, "\n\n"),
        (rf"(?i)({TAG}[a-z0-9.\-]+)\+", "$1-or-later"),
        (rf"(?i)({TAG}[a-z0-9.\-]+)\)?{SPACE}+with{SPACE}+[a-z0-9.\-]+", "$1"),
        *[(rf"(?i)({TAG})([a-z0-9.\-]+)\)?{SPACE}+(?:or|and){SPACE}+\(*", "$1$2\n\n$1")] * JOINED_TAGS,
        (_title_pattern(titles), "\n\n\n$1\n\n\n"),
        (rf"(?i)(spdx-license-identifier):{SPACE}*\(*", "$1 "),
        (r"\n\n\n+", CUT),
        (rf"([.!?;:])[\n \t\x0B\f]+", "$1" + CUT),
    ]


def sentence_ids(text: Column, sentences=SENTENCES, titles=TITLES, spdx=SPDX) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = known_sentences(sentences, titles, spdx)
    cut = F.concat(F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n"))
    for pattern, to in steps(titles):
        cut = F.regexp_replace(cut, pattern, to)
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    longest = max(len(k) for k in known)
    normalised = F.transform(F.split(cut, CUT), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    fits = F.filter(normalised, lambda s: F.length(s).between(3, longest) & s.isin(*known))  # a hash set of constants
    return F.transform(fits, lambda s: F.element_at(names, s))


def matched(ids: Column, rules=RULES, sentences=SENTENCES, titles=TITLES, spdx=SPDX) -> tuple[Column, Column]:
    """Licences of the rules that match, and the identifiers that no rule covers."""
    rest = F.array_join(F.transform(ids, lambda i: F.concat(F.lit(","), i, F.lit(","))), "")
    found = F.array().cast("array<string>")
    listed = F.array(*[F.struct(F.lit(a).alias("licence"), F.lit(b).alias("ids")) for a, b in ordered_rules(rules, sentences, titles, spdx)])
    start = F.struct(rest.alias("rest"), found.alias("found"))
    state = F.aggregate(
        listed, start,
        lambda acc, r: F.when(F.instr(acc["rest"], r["ids"]) > 0, F.struct(F.replace(acc["rest"], r["ids"], F.lit(",;,")).alias("rest"), F.array_append(acc["found"], r["licence"]).alias("found"))).otherwise(acc),
    )
    return state["found"], state["rest"]


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sentences=SENTENCES, titles=TITLES, spdx=SPDX) -> DataFrame:
    """One row per input row: id, sentence_ids, n_sentences (known ones), licences, unmatched.

    ``licences`` joins the sorted distinct licences with ``|``; ``unmatched`` counts known sentences
    that no rule covers. A null or empty text has none of either; repeated rows and ids give repeated
    rows; ties between rules of one length go by name; an empty table gives no rows. Whole texts of any
    length are read; other columns are ignored.
    """
    scanned = docs.select(F.col(id_col), sentence_ids(F.col(text_col), sentences, titles, spdx).alias("ids"))
    # rules are tried for texts with a known sentence only
    found, rest = matched(F.col("ids"), rules, sentences, titles, spdx)
    some = F.size("ids") > 0
    return scanned.withColumn("found", F.when(some, F.struct(found.alias("licences"), rest.alias("rest")))).select(
        id_col,
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size("ids").cast("long").alias("n_sentences"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("found.licences")), "|"), F.lit("")).alias("licences"),
        F.coalesce(F.size(F.filter(F.split("found.rest", ","), lambda x: (x != "") & (x != ";"))), F.lit(0)).cast("long").alias("unmatched"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in known_sentences().items())
    rest = "',' || array_to_string(ids, ',,') || ','"
    cut = "chr(10) || coalesce(text, '') || chr(10)"
    for pattern, to in steps():
        to = to.replace("$1", "\\1").replace("$2", "\\2").replace("\n", "' || chr(10) || '").replace(CUT, "' || chr(1) || '")
        cut = f"regexp_replace({cut}, '{pattern}', '{to}', 'g')"
    chain, prev = [], "r0"
    for i, (licence, ids) in enumerate(ordered_rules(), 1):
        chain.append(f"r{i} AS (SELECT rn, ids, replace(rest, '{ids}', ',;,') AS rest, CASE WHEN strpos(rest, '{ids}') > 0 THEN list_append(found, '{licence}') ELSE found END AS found FROM {prev})")
        prev = f"r{i}"
    return rf"""
WITH known(s, i) AS (VALUES {known}),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, doc_id, text FROM documents
), y AS (
  SELECT rn, string_split({cut}, chr(1)) AS ss FROM d
), z AS (
  SELECT rn, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM y
), n AS (
  SELECT rn, k, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM z
), h AS (
  SELECT rn, list(known.i ORDER BY k) AS ids FROM n JOIN known ON n.s = known.s GROUP BY rn
), r0 AS (
  SELECT rn, ids, {rest} AS rest, CAST([] AS VARCHAR[]) AS found FROM h
), {", ".join(chain)}
SELECT d.doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(len(ids), 0) AS n_sentences,
       coalesce(array_to_string(list_sort(list_distinct(found)), '|'), '') AS licences,
       coalesce(len(list_filter(string_split(rest, ','), lambda q: q <> '' AND q <> ';')), 0) AS unmatched
FROM d LEFT JOIN {prev} ON d.rn = {prev}.rn
"""


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE = {"op5_license_scan": _sql()}
