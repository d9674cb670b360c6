"""Licence scan by canonical digest: whole texts, normalised, hashed and joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as the same word, as in the matching guidelines of the SPDX project.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("behaviour", "behavior"),
    ("cancelled", "canceled"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("labour", "labor"),
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Licence texts and standard notices, published by their authors for verbatim use.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", f"{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_DISCLAIMER}"),
    ("0BSD", f"{_PERMISSION}.\n{_ISC_DISCLAIMER}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"""{_BSD_HEAD}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
{_BSD_TAIL}"""),
    ("Apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("GPL-3.0-or-later-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("MPL-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("WTFPL", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("SPDX-MIT-line", "SPDX-License-Identifier: MIT"),
    ("SPDX-Apache-2.0-line", "SPDX-License-Identifier: Apache-2.0"),
    ("all-rights-reserved-line", "All rights reserved."),
]

# Usual title lines over these texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", "Modified BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
}
# SHA-256 of the canonical form (see ``canonical``) of long licences, as their authors publish them.
LONG = [
    ("Apache-2.0", "bd5e0c0142059acf575239da46242fa2d1532b45e70c5941b1437dbea5949e35"),
    ("Artistic-1.0", "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"),
    ("CC0-1.0", "51c4bf27767d074bdefc84db7420b4c55e27827dac6d8de3ef0d37b2042fb6fa"),
    ("GFDL-1.3", "774999c74b3221565b6a61d133bab3a6b1e44d284c74d95e126ed45fe7c31283"),
    ("GPL-1.0", "ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746"),
    ("GPL-2.0", "2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee"),
    ("GPL-3.0", "e5ad5888afa995c9de52e4017b0087735bdd20d2c12d540b6c8aac26c7482b06"),
    ("LGPL-2.0", "4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2"),
    ("LGPL-2.1", "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-1.1", "356542917be9959d1853554027ed0edc9b2625ae62badbd183279510113cba79"),
    ("MPL-2.0", "9ed0c230cf11312a5d6bdc0597928037db290a521ff79cadfd488e6606508716"),
]

# A line (or comment line) that names a copyright holder, with a following "All rights reserved." line. "Copyright" must be
# followed by a holder or a year, so that sentences on copyright notices stay. The same patterns hold in Java and in RE2.
_LINE = r"(^|\n)[ \t/*#;.%-]*"
COPYRIGHT_LINES = [
    _LINE + r"(Copyright|copyright|COPYRIGHT)[ \t:,]*(\([cC]\)|©|&copy;|[0-9]|by |<|\[|\{)[^\n]*(\n[ \t/*#;.%-]*[Aa]ll [Rr]ights [Rr]eserved\.?[ \t\r]*)?",
    _LINE + r"(Copyright|copyright)[ \t:,]+\p{Lu}[^\n]*(\n[ \t/*#;.%-]*[Aa]ll [Rr]ights [Rr]eserved\.?[ \t\r]*)?",
    _LINE + r"(©|\([cC]\)[ \t]*(Copyright[ \t]*)?[12][0-9][0-9][0-9])[^\n]*(\n[ \t/*#;.%-]*[Aa]ll [Rr]ights [Rr]eserved\.?[ \t\r]*)?",
]
# What follows "Copyright" in licences' own sentences; joined by a hyphen first, so such lines name no holder.
NOT_HOLDERS = ("Holder", "Owner", "Notice", "License", "Law", "Act", "Statement")
BULLET = r"(^|\n)[ \t/*#;-]*(\(?([0-9]+|[a-z])[.)]|[*-])[ \t]"
WEB = r"https?://(www\.)?"
NOT_WORD = "[^a-z0-9]+"


def canonical(text: Column) -> Column:
    """Lower case; no copyright lines, list marks or punctuation; one spelling of equivalent words; single spaces."""
    out = text
    for word in NOT_HOLDERS:
        out = F.replace(out, F.lit(f"Copyright {word}"), F.lit(f"Copyright-{word}"))
    cleared = out
    for line in COPYRIGHT_LINES:
        cleared = F.regexp_replace(cleared, line, "\n")
    named = F.lower(text).contains("copyright") | text.contains("©") | text.contains("(c)") | text.contains("(C)")
    out = F.when(named, cleared).otherwise(text)  # most texts name no holder, and none of the patterns need run
    out = F.regexp_replace(F.lower(out), BULLET, "\n")
    out = F.when(out.contains("://"), F.regexp_replace(out, WEB, " ")).otherwise(out)
    out = F.concat(F.lit(" "), F.regexp_replace(out, NOT_WORD, "  "), F.lit(" "))  # two spaces: each word has its own on both sides
    for word, same in SPELLINGS:
        out = F.replace(out, F.lit(f" {word.replace(' ', '  ')} "), F.lit(f" {same.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def texts() -> list[tuple[str, str]]:
    """(license_id, text) of the texts known as such, with and without their titles."""
    return KNOWN + [(name, f"{title}\n\n{text}") for name, text in KNOWN for title in TITLES.get(name, [])]


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id): one row for each different canonical text; the smallest id stands for equal texts.

    ``known`` has (license_id, text); by default it is ``texts`` with the digests of LONG. Null texts take no part.
    """
    table = spark.createDataFrame(texts() if known is None else known, "license_id string, license_text string").where("license_text is not null")
    found = table.select(digest(F.col("license_text")).alias("digest"), "license_id")
    if known is None:
        found = found.unionByName(spark.createDataFrame(LONG, "license_id string, digest string"))
    return found.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license_id) for every row; license_id is null for a text that is no known licence.

    Whole texts are compared, never parts. Only the id and the digest are joined. A null or wordless text has a null digest
    and no licence; repeated rows stay; further columns are ignored; the known table may have any size (its join is left to
    Spark, which broadcasts it only when its measured size allows).
    """
    body = canonical(F.col(text_col).cast("string"))
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).select("doc_id", F.when(F.length("body") > 0, F.sha2("body", 256)).alias("digest"))
    return hashed.join(known.select("digest", "license_id"), "digest", "left").select("doc_id", "digest", "license_id")


def oracle() -> str:
    """The same scan in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    body = "text"
    for word in NOT_HOLDERS:
        body = f"replace({body}, 'Copyright {word}', 'Copyright-{word}')"
    for line in COPYRIGHT_LINES:
        body = f"regexp_replace({body}, {quote(line)}, chr(10), 'g')"
    body = f"regexp_replace(lower({body}), {quote(BULLET)}, chr(10), 'g')"
    body = f"regexp_replace({body}, {quote(WEB)}, ' ', 'g')"
    body = f"' ' || regexp_replace({body}, '{NOT_WORD}', '  ', 'g') || ' '"
    for word, same in SPELLINGS:
        body = f"replace({body}, ' {word.replace(' ', '  ')} ', ' {same.replace(' ', '  ')} ')"
    body = f"trim(replace({body}, '  ', ' '))"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in texts())
    long = ", ".join(f"({quote(d)}, {quote(i)})" for i, d in LONG)
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT sha256({body}) AS digest, license_id FROM (VALUES {values}) k(license_id, text) UNION ALL FROM (VALUES {long})) GROUP BY 1),
hashed AS (SELECT doc_id, {body} AS body FROM documents)
SELECT h.doc_id, h.digest, k.license_id
FROM (SELECT doc_id, CASE WHEN length(body) > 0 THEN sha256(body) END AS digest FROM hashed) h LEFT JOIN known k ON h.digest = k.digest"""
