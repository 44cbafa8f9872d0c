"""Texts that are a known licence, by digest of their canonical form, and texts that hold one.

A text holds a licence if all words of its terms stand in it one after another, whatever comes
before and after and however the lines are broken.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Full texts of short licences and usual notices.
KNOWN: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}
#: Spellings taken for the same.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sublicences": "sublicenses", "sub license": "sublicense", "sub licence": "sublicense",
    "organisations": "organizations", "authorised": "authorized", "authorisation": "authorization", "acknowledgements": "acknowledgments", "copyright owners": "copyright holders",
    "noncommercial": "non commercial", "organisation": "organization", "authorise": "authorize", "favour": "favor", "honour": "honor",
    "merchantibility": "merchantability", "acknowledgement": "acknowledgment", "non infringement": "noninfringement", "wilful": "willful", "and or": "andor", "copyright owner": "copyright holder",
}
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Copyright lines: a year, sign, bracket, or nothing but a name after the word. A wrapped line of the terms may begin with the word as well.
NOTICES = r"(^|\n)[ \t#/*;]*((?i:copyright)[ \t]+((?i:\(c\))|©|[0-9<\[])[^\n]*|(©|(?i:\(c\))[ \t]*[0-9])[^\n]*|[Cc]opyright([ \t]+[A-Z][^ \t\n]*)+[ \t]*(?m:$)|(?i:all rights reserved)[^\n]*)"
#: Titles that may stand before the terms, as words.
TITLES = (
    "mit license", "the mit license", "the mit license mit", "mit license mit", "isc license", "the isc license", "zlib license", "the zlib license", "bsd 2 clause license", "bsd 3 clause license",
    "the 2 clause bsd license", "the 3 clause bsd license", "simplified bsd license", "new bsd license", "bsd 3 clause new or revised license", "bsd zero clause license", "bsd 1 clause license",
    "mit no attribution", "the unlicense", "unlicense", "postgresql license", "boost software license", "apache license", "apache license version 2 0", "apache license version 2 0 january 2004 http www apache org licenses",
)
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Further short licences and the usual notices at the head of a file.
MORE: dict[str, str] = {
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.

IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.

THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.""",
    "curl": """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def held_texts() -> dict[str, str]:
    """All known texts by name: KNOWN, MORE, what is made out of them, and the terms, without preamble
    and appendix, in the folder licenses."""
    head, tail = KNOWN["BSD-2-Clause"].rsplit("\n\n", 1)
    grant, _, none = KNOWN["MIT"].split("\n\n")
    first = head.rsplit("\n\n", 1)[0]
    made = {"BSD-3-Clause": f"{head}\n\n{BSD_3}\n\n{tail}", "BSD-1-Clause": f"{first}\n\n{tail}", "MIT-0": grant.split(", subject to")[0] + ".\n\n" + none}
    files = sorted(Path(__file__).with_name("licenses").glob("*.txt"))
    return KNOWN | MORE | made | {f.stem: f.read_text() for f in files}


def canonical(text: Column) -> Column:
    """Lower case A-Z, no copyright lines, punctuation as single spaces, one spelling of each word, no
    title before the terms."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), NOTICES, "")
    t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # two spaces between words, so that each has its own on either side
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, OTHER, "  ")), F.lit(" "))
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(_apart(a)), F.lit(_apart(b)))
    return F.regexp_replace(F.trim(F.replace(t, F.lit("  "), F.lit(" "))), _titles(), "")


def _apart(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def _titles() -> str:
    return "^(" + "|".join(sorted(TITLES, key=len, reverse=True)) + ") "


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """digest and license of the known texts; the first by name where several have one digest."""
    rows = spark.createDataFrame([(k, v) for k, v in (held_texts() if known is None else known).items()], "license string, text string")
    return rows.groupBy(F.md5(canonical(F.col("text"))).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest and license (null if unknown) for every row of docs(doc_id, text, ..).

    The digest is of the entire canonical text; null and empty texts have that of the empty text,
    which is no licence. Where several known texts have one digest the first by name is given. known
    defaults to held_texts(), whose size is fixed; a larger one is joined by its digest like any table.
    """
    rows = docs.select("doc_id", F.md5(canonical(F.col("text"))).alias("digest"))
    table = F.broadcast(known_digests(docs.sparkSession)) if known is None else known  # some thirty rows
    return rows.join(table, "digest", "left").select("doc_id", "digest", "license")


def passages(docs: DataFrame, held: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_licenses and licenses (names by comma, in order; null if none) for every row of docs(doc_id, text, ..).

    Whole texts are passages too. held is a fixed table of some known texts, each looked for in
    every document; held_texts() by default.
    """
    held = held_texts() if held is None else held
    spark = docs.sparkSession
    rows = spark.createDataFrame(list(held.items()), "license string, text string")
    words = sorted(tuple(r) for r in rows.select("license", canonical(F.col("text"))).collect())  # a row for each known text
    t = docs.select("doc_id", F.concat(F.lit(" "), canonical(F.col("text")), F.lit(" ")).alias("t"))
    found = F.array(*[F.when(F.contains("t", F.lit(f" {w} ")), F.lit(k)) for k, w in words if w])
    t = t.select("doc_id", F.array_compact(found).alias("l"))
    return t.select("doc_id", F.size("l").cast("long").alias("n_licenses"), F.when(F.size("l") > 0, F.array_join("l", ", ")).alias("licenses"))


def wrapped_files(names: DataFrame) -> DataFrame:
    """A licence file for every row of names(key, name): a known text in turn, with a title, the
    name's copyright line, broken lines, comment signs and capitals by the key."""
    known = list(held_texts().items())
    texts = F.broadcast(names.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(known)], "i int, license string, body string"))  # some thirty rows
    rows = names.withColumn("i", (F.col("key") % len(known)).cast("int")).join(texts, "i")
    title = F.element_at(F.array(F.lit(""), F.lit("The MIT License (MIT)\n\n"), F.lit("ISC License\n"), F.lit("Apache License\nVersion 2.0\n")), (F.col("key") % 4 + 1).cast("int"))
    mark = F.when(F.col("key") % 3 == 0, F.concat(F.lit("Copyright (c) 2020, "), "name")).when(F.col("key") % 3 == 1, F.lit("Copyright Jane Doe")).otherwise(F.concat(F.lit("(c) 1999 "), "name"))
    body = F.regexp_replace("body", r"([^\n]{40,60}?) ", F.when(F.col("key") % 2 == 0, F.lit("$1\n # ")).otherwise(F.lit("$1\n")))
    body = F.when(F.col("key") % 5 == 0, F.upper(body)).otherwise(body)
    return rows.select(F.col("key").alias("doc_id"), F.concat(title, mark, F.lit("\nAll rights reserved.\n\n"), body).alias("text"))


def _sql_canonical(text: str) -> str:
    t = f"regexp_replace(coalesce({text}, ''), '{NOTICES}', '', 'g')"
    t = f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    t = f"' ' || trim(regexp_replace({t}, '{OTHER}', '  ', 'g')) || ' '"
    for a, b in SPELLINGS.items():
        t = f"replace({t}, '{_apart(a)}', '{_apart(b)}')"
    return f"regexp_replace(trim(replace({t}, '  ', ' ')), '{_titles()}', '')"


def sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in held_texts().items())
    return f"""WITH k AS (SELECT md5({_sql_canonical("body")}) AS digest, min(license) AS license FROM (VALUES {values}) t(license, body) GROUP BY 1),
  d AS (SELECT doc_id, md5({_sql_canonical("text")}) AS digest FROM documents)
  SELECT doc_id, d.digest, license FROM d LEFT JOIN k USING (digest)"""


def passages_sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in held_texts().items())
    return f"""WITH k AS (SELECT license, ' ' || {_sql_canonical("body")} || ' ' AS w FROM (VALUES {values}) t(license, body)),
  d AS (SELECT row_number() OVER () AS i, doc_id, ' ' || {_sql_canonical("text")} || ' ' AS t FROM documents)
  SELECT doc_id, count(license) AS n_licenses, string_agg(license, ', ' ORDER BY license) AS licenses
  FROM d LEFT JOIN k ON contains(t, w) GROUP BY i, doc_id"""


def files_sql() -> str:
    """What each file was made from, without any of the rules above."""
    names = ", ".join(f"'{k}'" for k in held_texts())
    return f"SELECT c_custkey AS doc_id, list_extract([{names}], CAST(c_custkey % {len(held_texts())} + 1 AS INT)) AS license FROM customer"
