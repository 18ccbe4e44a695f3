"""License scans by canonical digests, in DataFrame functions only.

A text's canonical form has lower case, no punctuation, no copyright lines, one spelling for words that
licence guidelines treat as equal, and single spaces. Its SHA-256 is joined to the digests of known
licence texts. Entire documents are looked up, and every line as an entire text of its own, because
notices mostly stand alone on a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, if_small

#: Spellings that count as equal, applied in this order to text without punctuation.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"),
    ("favour", "favor"), ("labour", "labor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
    ("artefact", "artifact"), ("centre", "center"), ("per cent", "percent"), ("fulfilment", "fulfillment"), ("copyright owner", "copyright holder"),
    ("initialise", "initialize"), ("recognise", "recognize"), ("utilisation", "utilization"), ("https ", "http "),
)
#: What marks a copyright line, at its start.
COPYRIGHT = r"^[^\p{L}\p{N}©]*(copyright\b.*(\d{4}|\(c\)|©)|\(c\)|©|all rights reserved\b).*$"

#: Licence texts and notices by SPDX identifier.
KNOWN = {
    "MIT": (
        """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "SPDX-License-Identifier: ISC",
    ),
    "BSD-2-Clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense",
    ),
}


def canonical_lines(text: Column) -> Column:
    """The lines of a text in lower case, without copyright lines, punctuation and empty lines."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), f"(?m){COPYRIGHT}", ""), r"[^\p{L}\p{N}\n]+", " ")
    return F.filter(F.split(F.regexp_replace(plain, " *\n *", "\n"), "\n"), lambda x: F.trim(x) != "")


def canonical(words: Column) -> Column:
    """One spelling and single spaces."""
    out = F.trim(words)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


Known = dict[str, tuple[str, ...]] | DataFrame
BROADCAST = 20_000  # known digests that are broadcast, some 3 MB; more are shuffled


def license_files(spark: SparkSession, path: str) -> DataFrame:
    """(license, text): every file below ``path`` as a licence, named as the file is, without ``.txt``."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt$", "")
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.url_decode(name).alias("license"), F.col("value").alias("text"))


def known_digests(spark: SparkSession, known: Known | None = None) -> DataFrame:
    """(digest, license) of the known texts, as canonical as what is looked up; of licences with equal texts the first by
    name. ``known`` is KNOWN by default, texts by licence, or a table (license, text) of any size. Texts that are null
    or have no words left, and rows without a licence, tell nothing and are left out."""
    if isinstance(known, DataFrame):
        table = known.select("license", "text").where("license IS NOT NULL")
    else:
        table = spark.createDataFrame([(name, t) for name, texts in (known or KNOWN).items() for t in texts], "license string, text string")
    whole = canonical(F.array_join(canonical_lines(F.col("text")), " "))
    texts = table.select(whole.alias("whole"), "license").where("whole != ''")
    return texts.groupBy(digest(F.col("whole")).alias("digest")).agg(F.min("license").alias("license"))


def find_licenses(docs: DataFrame, known: Known | None = None) -> DataFrame:
    """Add ``digest`` (of the canonical document), ``license`` (the known licence the whole document is,
    or null), ``line_licenses`` (sorted, distinct) and ``n_license_lines`` to ``docs``.

    Null and empty texts have the digest of the empty text and no licence. Repeated rows give equal
    values; an empty table gives no rows; columns of ``docs`` with those names are replaced. Texts of any length are
    read whole, and of licences with one text the first by name is told. ``known`` as for ``known_digests``: a given
    table's digests are broadcast up to BROADCAST of them and shuffled beyond that, with the same result.
    """
    table = known_digests(docs.sparkSession, known)
    if isinstance(known, DataFrame):
        table = cut(table)
        table = if_small(table, table.count(), BROADCAST)
    else:
        table = F.broadcast(table)
    docs = docs.drop("digest", "license", "line_licenses", "n_license_lines")
    lines = canonical_lines(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.posexplode(lines).alias("_at", "_line"))
    rows = rows.select("doc_id", "_hash", "_at", digest(canonical(F.col("_line"))).alias("digest"))
    hits = rows.join(table, "digest").dropDuplicates(["doc_id", "_hash", "_at"])
    per = hits.groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h")).agg(F.sort_array(F.collect_set("license")).alias("line_licenses"), F.count(F.lit(1)).alias("n_license_lines"))
    whole = docs.withColumns({"digest": digest(canonical(F.array_join(lines, " "))), "_hash": F.xxhash64("text")})
    out = whole.join(table, "digest", "left")
    out = out.join(per, out.doc_id.eqNullSafe(per._id) & (out._hash == per._h), "left").drop("_id", "_h", "_hash")
    return out.withColumns({"line_licenses": F.coalesce("line_licenses", F.array().cast("array<string>")), "n_license_lines": F.coalesce("n_license_lines", F.lit(0).cast("long"))})


def licensed_documents(docs: DataFrame, known: Known | None = None) -> DataFrame:
    """What op9 returns."""
    return find_licenses(docs, known).select("doc_id", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"), "n_license_lines")


def _sql_lines(text: str) -> str:
    plain = rf"regexp_replace(regexp_replace(lower({text}), '(?m){COPYRIGHT}', '', 'g'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    return f"list_filter(string_split(regexp_replace({plain}, ' *\\n *', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ') <> '')"


def _sql_canonical(words: str) -> str:
    out = f"trim({words}, ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(name, t.replace("'", "''")) for name, texts in KNOWN.items() for t in texts)
    return f"""
WITH k AS (SELECT sha256({_sql_canonical("array_to_string(" + _sql_lines("text") + ", ' ')")}) AS digest, min(license) AS license
  FROM (VALUES {values}) v(license, text) GROUP BY 1),
d AS (SELECT doc_id, {_sql_lines("coalesce(text, '')")} AS lines FROM documents),
w AS (SELECT doc_id, sha256({_sql_canonical("array_to_string(lines, ' ')")}) AS digest FROM d),
e AS (SELECT doc_id, sha256({_sql_canonical("line")}) AS digest FROM (SELECT doc_id, unnest(lines) AS line FROM d) x),
p AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM e JOIN k ON e.digest = k.digest GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license, coalesce(p.line_licenses, '') AS line_licenses, CAST(coalesce(p.n, 0) AS BIGINT) AS n_license_lines
FROM w LEFT JOIN k ON w.digest = k.digest LEFT JOIN p ON w.doc_id = p.doc_id
"""
