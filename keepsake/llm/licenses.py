"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (ASCII lower case, plain quotes and dashes, copyright lines left out, equivalent
spellings made one, punctuation and white space made single spaces) and its SHA-256 is joined to those of known texts.
The same is done for every single line against known notices, so a document that only states its licence is found too.
Known are the short licences below and those of the folder ``license_texts``, as published, each with and without its
title or what follows its terms.

Defined results: a null text is empty; a text that is no known licence has a null license; of known texts or notices with
one canonical form the first given counts, and one without words is none; notices are distinct and in
rising order, empty if there are none; repeated rows give repeated rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, text_of

#: Words that stand for one another in licence texts.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("judgement", "judgment"), ("labour", "labor"), ("programme", "program"), ("whilst", "while"), ("wilful", "willful"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("https://", "http://"))
#: Typographic marks and their plain forms.
MARKS = ("“”‘’–— ", "\"\"''-- ")
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright[ \t]+(\(c\)|©|[0-9<\[])|\(c\)[ \t]|©|all rights reserved)"
APART = r"[\x00-/:-@\[-`{-\x7f]+"

WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Known licence texts, as published.
TEXTS = {
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{WARRANTY}""",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_REST}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{ISC_REST}",
    "BSD-2-Clause": BSD_HEAD + BSD_REST,
    "BSD-3-Clause": BSD_HEAD + BSD_THIRD + BSD_REST,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
for _name in sorted(os.listdir(FOLDER)) if os.path.isdir(FOLDER) else ():  # the workers need none
    with open(os.path.join(FOLDER, _name), encoding="utf-8") as _text:
        TEXTS[_name.removesuffix(".txt")] = _text.read()
#: What ends the terms of a licence that has an appendix.
END = "END OF TERMS AND CONDITIONS"
#: Titles with which a text may begin.
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}
#: Known one-line notices.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
}


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line that isn't a copyright line."""
    plain = F.translate(F.translate(text, ASCII_UPPER, ASCII_LOWER), *MARKS)
    plain = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, plain)
    lines = F.filter(F.split(plain, "\n", -1), lambda line: ~line.rlike(COPYRIGHT_LINE))
    return F.transform(lines, lambda line: F.trim(F.regexp_replace(line, APART, " ")))


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def variants(texts: dict[str, str], titles: dict[str, str], notices: dict[str, str]) -> list[tuple[int, str, str]]:
    """Number, text and licence of all that is known: texts alone, with their title, and without what follows their terms; notices by themselves."""
    rows = []
    for name, text in texts.items():
        rows += [(text, name), (f"{titles.get(name, '')}\n{text}", name)]
        if END in text:
            rows.append((text[: text.index(END) + len(END)], name))
    return [(i, *row) for i, row in enumerate([*rows, *notices.items()])]


def known_texts(spark, texts: dict[str, str] = TEXTS, titles: dict[str, str] = TITLES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """digest and license, a row for each canonical form: as many rows as are given, at most."""
    known = spark.createDataFrame(variants(texts, titles, notices), "number int, text string, license string").select("number", "license", whole(canonical_lines(F.col("text"))).alias("plain"))
    return known.filter("plain != ''").groupBy(digest(F.col("plain")).alias("digest")).agg(F.min_by("license", "number").alias("license"))


def scanned(docs: DataFrame, texts: dict[str, str] = TEXTS, titles: dict[str, str] = TITLES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, digest, license (of the whole text) and notices (licences named by whole lines, joined by commas)."""
    spark = docs.sparkSession
    given = spark.createDataFrame([(i, *x) for i, x in enumerate(notices.items())], "number int, text string, license string").select("number", "license", whole(canonical_lines(F.col("text"))).alias("plain")).filter("plain != ''")
    named = sorted((r["plain"], r["license"]) for r in given.groupBy("plain").agg(F.min_by("license", "number").alias("license")).collect())
    plain, of = (F.array(*(F.lit(x[i]) for x in named)).cast("array<string>") for i in (0, 1))
    lines = docs.select("doc_id", canonical_lines(text_of()).alias("lines"))
    found = F.transform(F.array_intersect("lines", plain), lambda line: F.element_at(of, F.array_position(plain, line).cast("int")))
    rows = lines.select("doc_id", digest(whole(F.col("lines"))).alias("digest"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"))
    return rows.join(known_texts(spark, texts, titles, notices), "digest", "left").select("doc_id", "digest", "license", "notices")


def op10_license_scan(spark, sf_dir):
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql() -> str:
    """The same for DuckDB."""
    plain = f"translate(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), {quoted(MARKS[0])}, {quoted(MARKS[1])})"
    for a, b in SPELLINGS:
        plain = f"replace({plain}, {quoted(a)}, {quoted(b)})"
    lines = f"list_transform(list_filter(string_split({plain}, chr(10)), lambda x: NOT regexp_matches(x, {quoted(COPYRIGHT_LINE)})), lambda x: trim(regexp_replace(x, {quoted(APART)}, ' ', 'g')))"
    joined = "array_to_string(list_filter(lines, lambda x: x <> ''), ' ')"
    values = lambda rows: ", ".join(f"({i}, {quoted(t)}, {quoted(n)})" for i, t, n in rows)
    return f"""
WITH known_text(number, text, license) AS (VALUES {values(variants(TEXTS, TITLES, NOTICES))}),
notice_text(number, text, license) AS (VALUES {values([(i, *x) for i, x in enumerate(NOTICES.items())])}),
known AS (SELECT sha256({joined}) AS digest, arg_min(license, number) AS license FROM (SELECT number, license, {lines} AS lines FROM known_text) WHERE {joined} <> '' GROUP BY 1),
notice AS (SELECT sha256({joined}) AS digest, arg_min(license, number) AS license FROM (SELECT number, license, {lines} AS lines FROM notice_text) WHERE {joined} <> '' GROUP BY 1),
doc AS (SELECT doc_id, {lines} AS lines, row_number() OVER () AS place FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
named AS (SELECT place, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT place, sha256(line) AS digest FROM (SELECT place, unnest(lines) AS line FROM doc)) JOIN notice USING (digest) GROUP BY place)
SELECT d.doc_id, d.digest, k.license, coalesce(n.notices, '') AS notices
FROM (SELECT doc_id, place, sha256({joined}) AS digest FROM doc) d LEFT JOIN known k USING (digest) LEFT JOIN named n USING (place)
"""
