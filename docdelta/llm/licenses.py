"""Licence texts found by the digest of their canonical form.

The canonical form of a text has no copyright lines, case, punctuation or
layout, and one spelling for words with several. The digests of whole texts
are joined to those of known licences, so a text matches if nothing but these
differ. The known texts are a parameter; by default they are the short
licences below and the full texts in ``license_texts``, a file each.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BROADCAST = 100_000

# Equivalent spellings, after the matching guidelines for licence lists.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "sublicence": "sublicense", "licences": "licenses", "https": "http",
}

# The texts of short licences.
PERMISSIVE_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_START = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
MIT_BODY = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
TEXTS = [
    ("MIT", MIT_BODY + PERMISSIVE_END),
    ("MIT", "MIT License\n\nCopyright (c) 2000 A\n\n" + MIT_BODY + PERMISSIVE_END),
    ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2000 A\n\n" + MIT_BODY + PERMISSIVE_END),
    ("BSD-2-Clause", BSD_START + BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_START + BSD_END),
    ("BSD-3-Clause", BSD_START + BSD_THIRD + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_START + BSD_THIRD + BSD_END),
    ("ISC", ISC_START + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_END),
    ("ISC", "ISC License\n\n" + ISC_START + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_END),
    ("0BSD", ISC_START + ".\n\n" + ISC_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]



@cache
def known_texts() -> tuple[tuple[str, str], ...]:
    """(license_id, text) of the short licences and of the files beside this module, named by their ids."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return (*TEXTS, *((f.stem, f.read_text(encoding="utf-8")) for f in files))


# Fixed value: a line that only states a copyright (after a line break, in lower case).
COPYRIGHT = r"\n[ \t#*/;%-]*(?:copyright (?:\(c\)|©|[0-9]{4})|\(c\) [0-9]{4}|© ?[0-9]{4}|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """The canonical form: words parted by two spaces, one space at either end; empty if there is no word."""
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit("")))), COPYRIGHT, "")
    words = F.regexp_replace(F.replace(lines, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", "  ")
    out = F.concat(F.lit("  "), words, F.lit("  "))
    for old, new in EQUIVALENT.items():
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id) of known texts; of licences with equal canonical texts the least id."""
    rows = spark.createDataFrame(list(texts or known_texts()), "license_id string, text string").where(F.length(canonical(F.col("text"))) > 0)
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (null if the whole text is no known licence) of every row.

    Defined cases: null, empty and wordless texts have the digest of the empty
    text and match nothing. Repeated rows give repeated results. Empty table:
    empty result. Extra columns are ignored. Many documents may share a digest.
    Known licences (digest, license_id) get one row a digest, with the least
    id; they are broadcast up to ``MOST_BROADCAST`` rows and joined by shuffle
    beyond.
    """
    table = known(docs.sparkSession) if licenses is None else licenses.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    small = table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    return rows.join(F.broadcast(table) if small else table, "digest", "left").select("doc_id", "digest", "license_id")


def _sql(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"lower(coalesce({text}, ''))"
    out = f"regexp_replace(chr(10) || {out}, {quoted(COPYRIGHT)}, '', 'g')"
    out = f"'  ' || regexp_replace(replace({out}, '&', ' and '), {quoted(r'[^\p{L}\p{N}]+')}, '  ', 'g') || '  '"
    for old, new in EQUIVALENT.items():
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out}, ' ')"


def oracle(texts: list[tuple[str, str]] | None = None) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in texts or known_texts())
    return f"""
WITH texts(license_id, text) AS (VALUES {rows}),
known AS (
  SELECT sha256(c) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_sql('text')} AS c FROM texts) WHERE c <> '' GROUP BY 1
),
scanned AS (SELECT doc_id, sha256({_sql('text')}) AS digest FROM documents)
SELECT doc_id, s.digest, license_id FROM scanned s LEFT JOIN known k ON s.digest = k.digest
"""
