"""Licence scans by canonical digests (operator 10).

A unit of text is a whole document, one of its paragraphs (runs of lines that aren't blank) or one of its lines. A unit is normalised (case,
punctuation, copyright lines, equivalent spellings), hashed, and joined by equality
to the digests of known licence texts. There is no partial or fuzzy matching: a
unit matches when all of it is a known text. Inside a longer document, a known text of several paragraphs
matches where all of them follow each other; one of them alone, which other licences may share, says nothing.
Of the long licences only digests of their published files are kept.

Cases: null and empty texts have no units; repeated rows give repeated counts; a
null doc_id is kept as it is; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Known licence notices, by SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "This work is licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "This work is licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Complete licence texts, and the header blocks that longer licences ask for.
TEXTS = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_TERMS + "\n\n" + _BSD_DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_TERMS + "\n\n" + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_TERMS + "\n\n" + _BSD_NAMES + "\n\n" + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_TERMS + "\n\n" + _BSD_NAMES + "\n\n" + _BSD_DISCLAIMER),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)
#: SHA-256 of the canonical complete texts of long licences, as published.
DIGESTS = (
    ("Apache-2.0", "24b1148fba3fab26629dbb442fb2e2c6528ccd4dec8b3683ec180689d9c34831"),
    ("Artistic-1.0-Perl", "05c96b8e63213b4f15a737fd0299a0bb13a0f48d798fd9dd0bc233e1d52b483a"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "df66a4bde110f717d64b1a02b0cd37d0e073acaa972cca9ec6bbfb7cd273db98"),
    ("GFDL-1.2", "b40e2ec1ca73eb52792fd5d91539ecc14dac3e18f35807d88914ffacded126ec"),
    ("GFDL-1.3", "6a1f61b487e2a10d2d4ab03efee8131f2607187649d3f7fad06644809a153f78"),
    ("GPL-1.0", "f402a08de837977cc02f0ecd7d0b41559f7fdcd9e6c7bd75f47eba75638c0c38"),
    ("GPL-2.0", "eef2fdcac2df173b049fab1b5ff8a38873af8e73a43af9f8ed6cc7fea23d58cb"),
    ("GPL-3.0", "41d85be030bfff7e3c3a07e62a568c32c18572987b44ae8a074dc74d10451106"),
    ("LGPL-2.0", "d5e1cd1a7f88b88f1bae975a3aa0c2fa48039a9e1a44285b4cfe63a83cf7f3d0"),
    ("LGPL-2.1", "f771e727a00c5247ab8b4e074c9a61e583518f8d7805074d391b18ce584f06d0"),
    ("LGPL-3.0", "9f541b239899814e09b617e6ebf4633f2d9e91a9463fb74125633e1b687eca9e"),
    ("MPL-1.1", "db2c68e9ed485d27ab6db05089216c47e8ba5a12b9fa1e85694e84139a872302"),
    ("MPL-2.0", "10e5c11a1e75b721e76579dcffeb8294317680015851e3986b7738c57c26635c"),
)
#: No published text of these is longer, nor is any without the word "license" outside of "licensed under".
_LONGEST_FILE = 40_000


def blocks(texts=TEXTS) -> list[tuple[str, list[str]]]:
    """(license, paragraphs) of texts with several paragraphs, without those that contain another block of their licence."""
    found = sorted({(name, tuple(text.split("\n\n"))) for name, text in texts if "\n\n" in text}, key=lambda x: (len(x[1]), x))
    out: list[tuple[str, tuple[str, ...]]] = []
    for name, parts in found:
        if not any(n == name and parts[i : i + len(p)] == p for n, p in out for i in range(len(parts) - len(p) + 1)):
            out.append((name, parts))
    return [(name, list(parts)) for name, parts in out]


#: Words that spelling rules read or write, and how many words before or after one of these a rule may take with it.
_TOUCHED = re.compile("licen|v$|v[0-9]|version|under$|non|commercial|copyright|owner|holder|sub|favou?r")
_REACH = 4


def marks(texts=TEXTS) -> list[str]:
    """For each block the longest run of its words that no spelling rule touches: every text with the block has it as it is."""
    out = set()
    for _, parts in blocks(texts):
        runs = []
        for x in parts:
            run: list[str] = []
            for word in [*re.sub("[\\W_]+", " ", x.lower()).split(), "license"]:
                if _TOUCHED.match(word):
                    runs.append(" ".join(run[_REACH:-_REACH]))
                    run = []
                else:
                    run.append(word)
        out.add(max(runs, key=len))
    return sorted(out)


#: Spellings that count as equal, as (pattern over normalised text, canonical form).
SPELLINGS = (
    ("\\blicence", "license"),
    ("\\blicenced\\b", "licensed"),
    ("\\bversion\\b", "v"),
    ("\\bv ?([0-9])", "v $1"),
    ("\\b(distributed|released|made available|published) under\\b", "licensed under"),
    ("\\bthis (work|software|program|file|document) is licensed under\\b", "licensed under"),
    ("\\bunder (the|a|an)\\b", "under"),
    ("\\bnon commercial\\b", "noncommercial"),
    ("\\bcopyright holder\\b", "copyright owner"),
    ("\\bsub license\\b", "sublicense"),
    ("\\bfavour\\b", "favor"),
)

_COPYRIGHT_LINE = "(?im)^[^a-z0-9\\n]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$"


#: Every text that some spelling rule changes contains one of these.
_ANY_SPELLING = "licenc|version|\\bv ?[0-9]|\\bunder\\b|non commercial|copyright holder|sub license|favour"

#: No spelling rule shortens its match by more than this factor: "version" becomes "v".
_SHRINK = 7


def _plain_lines(text: Column) -> Column:
    """The lines of a text in lower case, runs of anything but letters and digits as one space; copyright lines are empty."""
    kept = F.regexp_replace(text, _COPYRIGHT_LINE, "")
    plain = F.regexp_replace(F.lower(kept), "[^\\p{L}\\p{N}\\n]+", " ")
    return F.transform(F.split(plain, "\n", -1), lambda x: F.trim(x))


def _unified(plain: Column) -> Column:
    out = plain
    for pattern, form in SPELLINGS:
        out = F.regexp_replace(out, pattern, form)
    return F.when(plain.rlike(_ANY_SPELLING), out).otherwise(plain)


def canonical(text: Column) -> Column:
    """Normalised case, punctuation, copyright lines and spellings of a whole text."""
    return _unified(F.array_join(F.array_remove(_plain_lines(text), ""), " "))


def known_digests(spark, notices=NOTICES, texts=TEXTS, digests=DIGESTS) -> DataFrame:
    """(digest, license, block, position, length): whole known texts as block -1, and the paragraphs of blocks.

    The lists are parameters of the driver, so their size is bounded.
    """
    rows = [(name, x, -1, 0, 1) for name, x in (*notices, *texts)]
    rows += [(name, x, i, j, len(parts)) for i, (name, parts) in enumerate(blocks(texts)) for j, x in enumerate(parts)]
    stated = spark.createDataFrame(rows, "license string, notice string, block int, position int, length int").withColumn("digest", F.sha2(canonical(F.col("notice")), 256))
    listed = spark.createDataFrame([(name, d, -1, 0, 1) for name, d in digests], "license string, digest string, block int, position int, length int")
    return stated.select("digest", "license", "block", "position", "length").unionByName(listed).groupBy("digest", "block", "position", "length").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, notices=NOTICES, texts=TEXTS, id_col: str = "doc_id", text: str = "text", digests=DIGESTS) -> DataFrame:
    """Rows (id, license, scope, n_units, first_unit): licences that whole units of a document state.

    scope is "document" (first_unit 0), "paragraph" (one, or as many in a row as the known text has) or "line"
    (first_unit counts them from 0). A unit so long that no spelling rule could bring it down to the longest known
    text can't match; it is dropped after the plain normalisation, before the spellings.
    """
    known = known_digests(docs.sparkSession, notices, texts, digests)
    longest = _SHRINK * max([0, *(len(x) for _, x in (*notices, *texts))])
    unit = lambda scope, i, x: F.struct(F.lit(scope).alias("scope"), i.alias("unit"), x.alias("plain"))
    lines = F.transform(F.col("lines"), lambda x, i: unit("line", i, x))
    paragraphs = F.transform(F.split(F.array_join("lines", "\n"), "\n{2,}", -1), lambda x, i: unit("paragraph", i, F.trim(F.translate(x, "\n", " "))))
    whole = F.array(unit("document", F.lit(0), F.array_join(F.array_remove("lines", ""), " ")))

    def scoped(u: Column) -> Column:
        # A paragraph of one line is a line, and one that is all of a document is a document; both are still parts of blocks.
        seen = F.array_contains(F.col("lines"), u["plain"]) | (u["plain"] == whole[0]["plain"])
        return F.struct(F.when(seen, "part").otherwise(u["scope"]).alias("scope"), u["unit"].alias("unit"), u["plain"].alias("plain"))

    def may_match(u: Column) -> Column:
        size = F.length(u["plain"])
        return size.between(1, longest) | ((size <= _SHRINK * _LONGEST_FILE) & (u["scope"] == "document") & u["plain"].contains("licen"))

    # explode_outer: from explode() Spark infers a filter that would normalise every text again.
    fits = F.filter(F.concat(whole, F.filter(F.transform(paragraphs, scoped), lambda u: (u["scope"] != "part") | F.col("marked")), lines), may_match)
    parts = docs.where(F.col(text).isNotNull()).select(F.col(id_col), F.xxhash64(text).alias("_text"), _plain_lines(F.col(text)).alias("lines"))
    # Lines that are paragraphs are read as such, too, only where a block may be.
    joined = F.array_join("lines", " ")
    parts = parts.withColumn("marked", reduce(or_, (joined.contains(m) for m in marks(texts)), F.lit(False)))
    units = parts.select(id_col, "_text", F.explode_outer(fits).alias("u")).select(id_col, "_text", "u.scope", "u.unit", F.sha2(_unified(F.col("u.plain")), 256).alias("digest"))
    in_block = F.col("block") >= 0
    met = units.join(F.broadcast(known), "digest").where(F.when(in_block, F.col("scope").isin("paragraph", "part")).otherwise(F.col("scope") != "part"))
    met = met.select(id_col, "_text", F.when(in_block, "paragraph").otherwise(F.col("scope")).alias("scope"), "license", "block", "length", "position", (F.col("unit") - F.col("position")).alias("start"))
    # Copies of a row meet in one group, each with all of the block's paragraphs or none.
    runs = met.groupBy(id_col, "_text", "scope", "license", "block", "length", "start").agg(F.count(F.lit(1)).alias("c"), F.size(F.collect_set("position")).alias("places"))
    return (
        runs.where("places = length")
        .groupBy(id_col, "license", "scope")
        .agg(F.sum(F.expr("c div length")).alias("n_units"), F.min("start").cast("long").alias("first_unit"))
    )


def oracle_sql(notices=NOTICES, texts=TEXTS, digests=DIGESTS) -> str:
    """DuckDB SQL for scan over documents."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = [(name, x, -1, 0, 1) for name, x in (*notices, *texts)] + [(name, x, i, j, len(parts)) for i, (name, parts) in enumerate(blocks(texts)) for j, x in enumerate(parts)]
    longest = _SHRINK * max(len(x) for _, x, *_ in listed)

    def unified(x: str) -> str:
        out = x
        for pattern, form in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(form.replace('$1', chr(92) + '1'))}, 'g')"
        return f"CASE WHEN regexp_matches({x}, {quoted(_ANY_SPELLING)}) THEN {out} ELSE {x} END"

    plain = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    copyright_line = "'(?i)^[^a-z0-9]*(copyright|\\(c\\)|©|all rights reserved)'"
    known = " UNION ALL ".join(f"SELECT {quoted(name)} AS license, {plain.format(x=quoted(notice))} AS p, {i} AS block, {j} AS position, {n} AS length" for name, notice, i, j, n in listed)
    files = " UNION ALL ".join(f"SELECT {quoted(name)} AS license, {quoted(d)} AS digest, -1 AS block, 0 AS position, 1 AS length" for name, d in digests)
    return f"""WITH stated AS (SELECT license, sha256({unified('p')}) AS digest, block, position, length FROM ({known}) UNION ALL {files}
), known AS (SELECT digest, block, position, length, min(license) AS license FROM stated GROUP BY ALL
), parts AS (
  SELECT doc_id, hash(text) AS h, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, {copyright_line}) THEN '' ELSE {plain.format(x='x')} END) AS lines
  FROM documents WHERE text IS NOT NULL
), whole AS (
  SELECT doc_id, h, lines, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') AS d, string_split_regex(array_to_string(lines, chr(10)), '\\n{{2,}}') AS paragraphs FROM parts
), units AS (
  SELECT doc_id, h, 'line' AS scope, unnest(lines) AS p, unnest(range(len(lines))) AS unit FROM whole
  UNION ALL SELECT doc_id, h, 'document', d, 0 FROM whole
  UNION ALL SELECT doc_id, h, CASE WHEN p = d OR list_contains(lines, p) THEN 'part' ELSE 'paragraph' END, p, unit FROM (SELECT doc_id, h, lines, d, trim(replace(unnest(paragraphs), chr(10), ' ')) AS p, unnest(range(len(paragraphs))) AS unit FROM whole)
), met AS (
  SELECT doc_id, h, CASE WHEN block >= 0 THEN 'paragraph' ELSE scope END AS scope, license, block, length, position, unit - position AS start
  FROM (SELECT doc_id, h, scope, unit, sha256({unified('p')}) AS digest FROM units WHERE length(p) BETWEEN 1 AND {longest} OR scope = 'document' AND length(p) <= {_SHRINK * _LONGEST_FILE} AND contains(p, 'licen')) u JOIN known USING (digest)
  WHERE CASE WHEN block >= 0 THEN scope IN ('paragraph', 'part') ELSE scope <> 'part' END
), runs AS (
  SELECT doc_id, scope, license, length, start, count(*) AS c FROM met GROUP BY doc_id, h, scope, license, block, length, start HAVING count(DISTINCT position) = length
)
SELECT doc_id, license, scope, CAST(sum(c // length) AS BIGINT) AS n_units, min(start) AS first_unit FROM runs GROUP BY doc_id, license, scope"""
