"""Licence scan by sentence rules, with DataFrame functions only.

A text is cut into sentences and lines and each is normalised (lower case, runs of anything but a-z and
0-9 as one blank).  Sentences of the table below become identifiers, the longest first.  A sentence of the
table may be wrapped: a single line end may stand for any of its blanks, in comments too; a blank line may
not.  Where it has a comma, colon, semicolon or full stop inside, a text may end a sentence.  A document's
sequence of identifiers is matched against ordered rules: the rule's sentences must follow each other in
that order, others may stand between them.

Defined cases: null, empty and unmatched texts give no rows; repeated rows give repeated results; a
sentence that occurs twice counts once for a rule; very long texts are scanned whole; other columns are
ignored; empty tables give none.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of the published licence texts, by identifier.
TEXTS = {
    "mit.name": "Released under the MIT License",
    "mit.name2": "Licensed under the MIT License",
    "mit.title": "The MIT License (MIT)",
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit.liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache2.name": "Licensed under the Apache License, Version 2.0",
    "apache2.short": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache2.comply": "you may not use this file except in compliance with the License",
    "apache2.obtain": "You may obtain a copy of the License at",
    "apache2.asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache2.see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3.name": "This work is licensed under the GNU General Public License, version 3",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl.warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl.name": "This work is licensed under the GNU Lesser General Public License, version 3",
    "bsd.redist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.asis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd.liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "isc.liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "zlib.asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib.liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib.origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib.marked": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib.notice": "This notice may not be removed or altered from any source distribution",
    "bsl.short": "Distributed under the Boost Software License, Version 1.0",
    "bsl.grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "mpl2.name": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl2.header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl1.header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "unlicense.name": "This is free and unencumbered software released into the public domain",
    "unlicense.free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "ccby4.name": "Licensed under CC BY 4.0",
    "ccbysa4.name": "Licensed under CC BY-SA 4.0",
    "ccbync4.name": "Licensed under CC BY-NC 4.0",
    "ccbyncnd4.name": "Licensed under CC BY-NC-ND 4.0",
    "ccby4.long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbysa4.long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ccbync4.long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0.dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0.name": "Licensed under CC0 1.0",
    "wtfpl.title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "wtfpl.copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "postgresql.grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "rights.all": "All rights reserved under copyright",
}
#: Names by which a notice grants a licence (identifier, names).
NAMES = {
    "MIT": ["MIT License", "MIT license (MIT)"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "PostgreSQL": ["PostgreSQL License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2"],
    "GPL-3.0-only": ["GNU General Public License, version 3"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3"],
}
#: How such a notice begins.
VERBS = ["Released under the", "Licensed under the", "Distributed under the", "This project is licensed under the", "This software is licensed under the", "This work is licensed under the"]
#: The GNU licences whose headers differ by name, version and noun (identifier, name, version, noun).
GNU = [
    ("GPL-2.0", "GNU General Public License", "2", "program"), ("GPL-3.0", "GNU General Public License", "3", "program"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "library"), ("LGPL-3.0", "GNU Lesser General Public License", "3", "program"), ("AGPL-3.0", "GNU Affero General Public License", "3", "program"),
]
#: The Creative Commons licences (code, words) and versions (number, words).
CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
CC_VERSIONS = [("4.0", "4.0 International"), ("3.0", "3.0 Unported")]
#: Rules over the sentences of TEXTS (rule, licence, sentences in order).
TEXT_RULES = [
    ("mit-short", "MIT", ["mit.name"]),
    ("mit-short-2", "MIT", ["mit.name2"]),
    ("mit-title", "MIT", ["mit.title"]),
    ("mit-full", "MIT", ["mit.grant", "mit.notice", "mit.warranty"]),
    ("apache2-short", "Apache-2.0", ["apache2.name"]),
    ("apache2-header", "Apache-2.0", ["apache2.short", "apache2.comply", "apache2.obtain", "apache2.asis"]),
    ("gpl3-short", "GPL-3.0-only", ["gpl3.name"]),
    ("gpl3-header", "GPL-3.0-or-later", ["gpl.free", "gpl.warranty"]),
    ("lgpl3-short", "LGPL-3.0-only", ["lgpl.name"]),
    ("bsd2-full", "BSD-2-Clause", ["bsd.redist", "bsd.source", "bsd.binary"]),
    ("bsd3-full", "BSD-3-Clause", ["bsd.redist", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("isc", "ISC", ["isc.grant"]),
    ("isc-full", "ISC", ["isc.grant", "isc.warranty", "isc.liability"]),
    ("0bsd-full", "0BSD", ["0bsd.grant", "isc.warranty", "isc.liability"]),
    ("zlib-full", "Zlib", ["zlib.asis", "zlib.liability", "zlib.grant", "zlib.origin", "zlib.marked", "zlib.notice"]),
    ("bsl-short", "BSL-1.0", ["bsl.short"]),
    ("bsl-full", "BSL-1.0", ["bsl.grant"]),
    ("mpl2-header", "MPL-2.0", ["mpl2.name"]),
    ("cc-by", "CC-BY-4.0", ["ccby4.name"]),
    ("cc-by-long", "CC-BY-4.0", ["ccby4.long"]),
    ("cc-by-sa", "CC-BY-SA-4.0", ["ccbysa4.name"]),
    ("cc-by-sa-long", "CC-BY-SA-4.0", ["ccbysa4.long"]),
    ("cc-by-nc", "CC-BY-NC-4.0", ["ccbync4.name"]),
    ("cc-by-nc-long", "CC-BY-NC-4.0", ["ccbync4.long"]),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", ["ccbyncnd4.name"]),
    ("epl2-header", "EPL-2.0", ["epl2.header"]),
    ("epl1-header", "EPL-1.0", ["epl1.header"]),
    ("unlicense", "Unlicense", ["unlicense.name"]),
    ("unlicense-full", "Unlicense", ["unlicense.name", "unlicense.free"]),
    ("cc0", "CC0-1.0", ["cc0.name"]),
    ("cc0-dedication", "CC0-1.0", ["cc0.dedication"]),
    ("wtfpl", "WTFPL", ["wtfpl.title", "wtfpl.copy"]),
    ("postgresql", "PostgreSQL", ["postgresql.grant"]),
    ("proprietary", "LicenseRef-all-rights-reserved", ["rights.all"]),
]
SPLIT = r"([.!?;:])[\x20\x09-\x0D]+"


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def _tables() -> tuple[dict[str, str], list[tuple[str, str, list[str]]]]:
    """The sentences of TEXTS and of the families, and the rules over them; equal sentences, and rules of equal sentences, are one."""
    sentences, rules, seen = dict(TEXTS), list(TEXT_RULES), {normal(v): k for k, v in TEXTS.items()}
    had = {tuple(s) for _, _, s in rules}

    def known(key: str, text: str) -> str:
        key = seen.setdefault(normal(text), key)
        sentences.setdefault(key, text)
        return key

    def rule(name: str, license_: str, *keys: str) -> None:
        if keys not in had:
            had.add(keys)
            rules.append((name, license_, list(keys)))

    for license_, names in NAMES.items():
        for i, name in enumerate(names):
            for j, verb in enumerate(VERBS):
                rule(f"{license_}-short-{i}-{j}", license_, known(f"{license_}.name{i}.{j}", f"{verb} {name}"))
    for license_ in [*NAMES, "0BSD", "CC0-1.0", *(f"{g}-or-later" for g in dict.fromkeys(x for x, *_ in GNU)), *(f"CC-{c}-{v}" for c, _ in CC for v, _ in CC_VERSIONS)]:
        rule(f"{license_}-spdx", license_, known(f"{license_}.spdx", f"SPDX-License-Identifier: {license_}"))
    for key, name, version, noun in GNU:
        lead = f"This {noun} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation,"
        hope = known(f"gnu.{noun}.warranty", f"This {noun} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;")
        known(f"{key}.see", f"See the {name} for more details")
        known(f"{key}.{noun}.copy", f"You should have received a copy of the {name} along with this {noun}")
        rule(f"{key}-{noun}-later", f"{key}-or-later", known(f"{key}.{noun}.later", f"{lead} either version {version} of the License, or (at your option) any later version"), hope)
        for i, x in enumerate((f"version {version}", f"version {version} of the License")):
            rule(f"{key}-{noun}-only-{i}", f"{key}-only", known(f"{key}.{noun}.only{i}", f"{lead} {x}"), hope)
    known("gnu.implied", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE")
    for code, words in CC:
        for v, long in CC_VERSIONS:
            forms = [f"Licensed under CC {code} {v}", f"This work is licensed under CC {code} {v}", f"This work is licensed under a Creative Commons {words} {long} License", f"This work is licensed under the Creative Commons {words} {long} License"]
            for i, x in enumerate(forms):
                rule(f"cc-{code.lower()}-{v}-{i}", f"CC-{code}-{v}", known(f"cc.{code}.{v}.{i}", x))
    return sentences, rules


SENTENCES, RULES = _tables()
#: Every sentence of the table holds one of these, so texts without any are passed over.
ANCHORS = ("licen", "distribut", "permission", "warrant", "copyright", "software", "wtfpl")


def rule_pattern(sentences: list[str]) -> str:
    """A pattern over ' id id id ': the identifiers in order, any others between them."""
    return " " + " (?:.* )?".join(re.escape(s) for s in sentences) + " "


def entry_pattern(sentence: str, wrap: str = "/") -> str:
    """A pattern of an entry in a cut text: | is an end of a sentence, which may stand at its own punctuation; wrap a line end, at any blank."""
    parts = [normal(p) for p in re.split(r"[.,!?;:][\x20\x09-\x0D]+", sentence.lower())]
    return f"[ {wrap}|]".join(f"[ {wrap}]".join(p.split(" ")) for p in parts if p)


def known_pattern(sentences: list[str]) -> str:
    """A pattern of any entry in a cut text, between ends of sentences or lines; of entries that begin alike, the longest.

    Entries share the pattern of the words that they begin with, so a place is tried once for each beginning.
    """
    tree: dict = {}
    for sentence in sorted(sentences, key=lambda s: -len(normal(s))):
        node = tree
        for word in re.split(r"(?<=\])(?=[a-z0-9])", "[]" + entry_pattern(sentence).replace("[", "\0[").replace("]", "]")):
            for part in word.split("\0"):
                if part != "[]":
                    node = node.setdefault(part, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        found = [part + pattern(below) for part, below in node.items() if part]
        end = ["(?=[|/])"] if "" in node else []
        return found[0] if len(found) == 1 and not end else "(?:" + "|".join(found + end) + ")" if found else end[0]

    return "(?<=[|/])" + pattern(tree)


KNOWN = known_pattern(list(SENTENCES.values()))


def sentence_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the known sentences of each document in order, for documents that have any."""
    table = F.create_map(*(F.lit(x) for k, v in SENTENCES.items() for x in (normal(v), k)))
    text = F.lower(F.col(text_col))
    some = F.lit(False)
    for anchor in ANCHORS:
        some = some | F.contains(text, F.lit(anchor))
    hit = docs.filter(some)
    marked = F.regexp_replace(F.concat(F.lit("\n"), text, F.lit("\n")), SPLIT, "$1\u0001")  # \u0001: an end of a sentence
    bare = F.regexp_replace(marked, "[^a-z0-9\n\u0001]+", " ")
    cut = F.regexp_replace(F.regexp_replace(bare, " ?\u0001 ?", "|"), " ?\n ?", "/")
    found = F.regexp_extract_all(cut, F.lit(KNOWN), F.lit(0))
    ids = F.transform(found, lambda s: F.try_element_at(table, F.translate(s, "|/", "  ")))
    return hit.select(F.col(id_col).alias(id_col), ids.alias("ids")).filter(F.size("ids") > 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, license, n_known, sequence): one row for each rule that a document matches."""
    rows = sentence_ids(docs, id_col, text_col).withColumn("sequence", F.array_join("ids", " "))
    padded = F.concat(F.lit(" "), F.col("sequence"), F.lit(" "))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(x).alias("license"), F.lit(rule_pattern(s)).alias("pattern")) for r, x, s in RULES))
    found = rows.select(id_col, F.size("ids").cast("long").alias("n_known"), "sequence", F.explode(F.filter(rules, lambda r: F.rlike(padded, r["pattern"]))).alias("r"))
    return found.select(id_col, F.col("r.rule").alias("rule"), F.col("r.license").alias("license"), "n_known", "sequence")


def op8_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs)


def _sql() -> str:
    """Pieces between line and sentence ends, runs of pieces looked up in the table, the longest run from each place, taken from left to right."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(normal(v))}, {quote(k)}, {quote(entry_pattern(v, ' '))})" for k, v in SENTENCES.items())
    rules = ", ".join(f"({quote(r)}, {quote(x)}, {i}, {quote(s)})" for r, x, ss in RULES for i, s in enumerate(ss))
    most = max(len(normal(v)) for v in SENTENCES.values())
    return rf"""
WITH RECURSIVE known(words, id, pattern) AS (VALUES {known}), rules(rule, license, place, id) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL),
sentences AS (SELECT rid, unnest(string_split(regexp_replace(text, '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)), 1) AS a FROM docs),
lines AS (SELECT rid, a, unnest(string_split(s, chr(10))) AS s, generate_subscripts(string_split(s, chr(10)), 1) AS b FROM sentences),
pieces AS (SELECT rid, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS s, row_number() OVER d AS i, CASE WHEN lead(a) OVER d = a THEN ' ' ELSE '|' END AS sep FROM lines WINDOW d AS (PARTITION BY rid ORDER BY a, b)),
first_words AS (SELECT DISTINCT string_split(words, ' ')[1] AS w FROM known),
runs AS (
  SELECT rid, i, i AS j, s AS run, sep FROM pieces WHERE s <> '' AND string_split(s, ' ')[1] IN (SELECT w FROM first_words)
  UNION ALL
  SELECT r.rid, r.i, p.i, r.run || r.sep || p.s, p.sep FROM runs r JOIN pieces p ON p.rid = r.rid AND p.i = r.j + 1 WHERE p.s <> '' AND length(r.run) + 1 + length(p.s) <= {most}),
spans AS (SELECT rid, i, max_by(j, length(run)) AS j, max_by(id, length(run)) AS id FROM runs JOIN known ON words = replace(run, '|', ' ') AND regexp_full_match(run, pattern) GROUP BY rid, i),
taken AS (
  SELECT rid, min(i) AS i FROM spans GROUP BY rid
  UNION ALL
  SELECT t.rid, (SELECT min(n.i) FROM spans n WHERE n.rid = t.rid AND n.i > c.j) FROM taken t JOIN spans c ON c.rid = t.rid AND c.i = t.i WHERE EXISTS (SELECT 1 FROM spans n WHERE n.rid = t.rid AND n.i > c.j)),
found AS (SELECT rid, i, id FROM taken JOIN spans USING (rid, i)),
sequences AS (SELECT rid, list(id ORDER BY i) AS ids FROM found GROUP BY rid),
steps AS (
  SELECT rid, rule, license, 0 AS place, list_position(ids, id) AS at FROM sequences, rules WHERE place = 0 AND list_contains(ids, id)
  UNION ALL
  SELECT s.rid, s.rule, s.license, r.place, s.at + list_position(q.ids[s.at + 1:], r.id) FROM steps s JOIN sequences q ON q.rid = s.rid JOIN rules r ON r.rule = s.rule AND r.place = s.place + 1 WHERE list_contains(q.ids[s.at + 1:], r.id)),
whole AS (SELECT rule, max(place) AS last FROM rules GROUP BY rule)
SELECT doc_id, s.rule, license, len(ids)::BIGINT AS n_known, array_to_string(ids, ' ') AS sequence
FROM steps s JOIN whole w ON w.rule = s.rule AND w.last = s.place JOIN sequences USING (rid) JOIN docs USING (rid)"""


#: By DuckDB, over the view documents.
OP8_SQL = _sql()
