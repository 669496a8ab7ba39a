"""Licence scans by canonical digests, in DataFrame functions only.

A text is made canonical: lower case, copyright lines out, punctuation and white space to
single spaces, equivalent spellings to one. The SHA-256 of the result is joined to the
digests of known licences; entire texts match, not passages. A document is looked up as a
whole, and so is each of its lines, which finds licence notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu(family: str, version: str) -> str:
    """The notice of the GNU licences, with or without their "or later" words."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {family} as published by the Free Software Foundation, {version}.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {family} for more details.
You should have received a copy of the GNU {family} along with this program. If not, see <https://www.gnu.org/licenses/>."""


#: Identifiers that a licence line of their own may name.
IDENTIFIERS = (
    "MIT", "Apache-2.0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0", "MPL-2.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
_GNU_FAMILIES = (("GPL-3.0", "General Public License"), ("LGPL-3.0", "Lesser General Public License"), ("AGPL-3.0", "Affero General Public License"))
#: Known licence texts and notices, by identifier.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", f"MIT License\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n{_MIT}"),
    ("ISC", _ISC),
    ("ISC", f"ISC License\n{_ISC}"),
    ("0BSD", _0BSD),
    ("0BSD", f"BSD Zero Clause License\n{_0BSD}"),
    ("BSD-2-Clause", f"{_CLAUSES}\n{_DISCLAIMER}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_CLAUSES}\n{_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_CLAUSES}\n{_NAMES}\n{_DISCLAIMER}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_CLAUSES}\n{_NAMES}\n{_DISCLAIMER}"),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n{_ZLIB}"),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n{_BOOST}"),
    ("Apache-2.0", _APACHE_HEADER),
    ("MPL-2.0", _MPL_HEADER),
    *((f"{i}-or-later", _gnu(f, "either version 3 of the License, or (at your option) any later version")) for i, f in _GNU_FAMILIES),
    *((f"{i}-only", _gnu(f, "version 3 of the License")) for i, f in _GNU_FAMILIES),
    ("GPL-2.0-or-later", _gnu("General Public License", "either version 2 of the License, or (at your option) any later version")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    *((i, f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS),
)
#: Spellings that count as equal, as words after punctuation is gone.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("sublicence", "sublicense"), ("non infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
    ("favour", "favor"), ("organisation", "organization"), ("per cent", "percent"), ("http", "https"),
)
#: Lines that state a copyright by a sign, a year or "by"; others go on with a licence's sentence.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright\b[^\n]*(?:\(c\)|©|[0-9]{4})|copyright by\b|\(c\)|©)[^\n]*$"
NO_WORD = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """Canonical form with line breaks kept: words of a line are set in two spaces each, so that equal neighbours do not share one."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.concat(F.lit("  "), F.regexp_replace(out, NO_WORD, "  "), F.lit("  "))
    out = F.replace(out, F.lit("\n"), F.lit("  \n  "))
    return out


def spelled(canon: Column) -> Column:
    """One spelling, single spaces, no ends; line breaks count as spaces."""
    out = F.regexp_replace(canon, r"[ \n]+", "  ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(known_digest, known_size, license): one row per canonical text; texts without a word are no licence."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    canon = rows.select(spelled(canonical(F.col("text"))).alias("canon"), "license").where("canon <> ''")
    return canon.groupBy(F.sha2("canon", 256).alias("known_digest")).agg(F.max(F.length("canon")).alias("known_size"), F.min("license").alias("license"))


def known_folder(spark: SparkSession, path: str) -> DataFrame:
    """(license, text) of a folder of licence texts, one file each: its name without the
    ending is the identifier. For whole texts that this module does not hold."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """(doc_id, digest, license, notices): one row per input row.

    digest is that of the entire canonical text; license is the known licence that it is, or
    null; notices are the licences whose whole text is a line of the document, in order and
    joined by commas, or empty. known: (license, text) pairs, or a table of them; of equal
    texts the least identifier counts. Only a list in code is broadcast, a table is joined as
    its size allows. Null and empty texts have the digest of an empty text, which is no
    licence. Texts of any length are read whole; equal rows have equal results, repeated rows
    stay. Only doc_id and text are read; an empty table gives no rows.
    """
    table = known_digests(docs.sparkSession, known)
    longest = table.agg(F.max("known_size")).first()[0] or 0
    table = table if isinstance(known, DataFrame) else F.broadcast(table)
    canon = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.coalesce(F.col("text"), F.lit(""))).alias("canon")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    # A longer line cannot become as short as a notice: spellings at most drop a letter or a space.
    lines = F.filter(F.split("canon", "\n"), lambda line: F.length(F.regexp_replace(line, " +", " ")).between(3, 2 * longest))
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), spelled(F.col("canon")).alias("unit"))),
        F.transform(F.array_distinct(lines), lambda line: F.struct(F.lit(False).alias("whole"), spelled(line).alias("unit"))),
    )
    each = canon.select("row", "doc_id", F.explode(units).alias("u")).select("row", "doc_id", "u.whole", F.sha2("u.unit", 256).alias("unit_digest"))
    found = each.join(table, F.col("unit_digest") == F.col("known_digest"), "left")
    return found.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("unit_digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices"),
    ).drop("row")


def oracle() -> str:
    quote = lambda s: s.replace("'", "''")

    def canon(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '', 'g')"
        return f"replace('  ' || regexp_replace({out}, '{NO_WORD}', '  ', 'g') || '  ', chr(10), '  ' || chr(10) || '  ')"

    def spell(x: str) -> str:
        out = f"regexp_replace({x}, '[ \\n]+', '  ', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"

    values = ", ".join(f"('{i}', '{quote(t)}')" for i, t in KNOWN)
    return f"""
WITH k AS (SELECT sha256({spell(canon('t'))}) AS known_digest, min(l) AS license FROM (VALUES {values}) v(l, t) GROUP BY 1),
d AS (SELECT doc_id, {canon("coalesce(text, '')")} AS c FROM documents),
w AS (SELECT doc_id, sha256({spell('c')}) AS digest FROM d),
n AS (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS line FROM d) JOIN k ON sha256({spell('line')}) = known_digest),
m AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM n GROUP BY doc_id)
SELECT w.doc_id, digest, license, coalesce(notices, '') AS notices FROM w LEFT JOIN k ON digest = known_digest LEFT JOIN m ON m.doc_id = w.doc_id
"""
