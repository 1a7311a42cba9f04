"""Licence scan: canonical digests of entire texts, joined to known licence digests.

A text is made canonical: lower case, no copyright lines, letters and digits only (the rest separates words), and one of
several equivalent spellings. Its SHA-256 is then looked up among the digests of known licences. The same
lookup covers every line as an entire text of its own, which finds the one-line notices that documents carry, and every paragraph of
several lines (up to an empty line, whatever its line breaks and comment marks), which finds file headers.

Known licences are a table of names and texts: by default short licences and notices, file headers, SPDX tags and the digests of full
texts (``license_texts``), otherwise any table. It is broadcast if it
has at most ``BROADCAST_ROWS`` rows, and joined by a shuffle otherwise.

Cases: a null text counts as empty; a text that is empty in its canonical form has a digest but no licence; of
licences with one canonical text the first name counts; null ids and repeated rows keep a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.llm.common import cut_lineage
from rfmlens.llm.license_texts import DIGESTS, HEADERS, SPDX

BROADCAST_ROWS = 10_000

# The usual texts of short licences and notices.
PERMISSION = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
              "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
              "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
              "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice "
              "shall be included in all copies or substantial portions of the Software.\n\n")
AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
         "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
         "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
         "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies.\n\n"
ISC_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
             "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
             "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
             "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
            "disclaimer in the documentation and/or other materials provided with the distribution.\n\n")
BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
             "this software without specific prior written permission.\n\n")
BSD_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
             "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
             "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
             "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
             "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
             "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
KNOWN = [
    ("MIT", "MIT License\n\n" + PERMISSION + AS_IS),
    ("MIT", PERMISSION + AS_IS),
    ("ISC", "ISC License\n\n" + ISC_GRANT + ISC_NOTICE + ISC_AS_IS),
    ("ISC", ISC_GRANT + ISC_NOTICE + ISC_AS_IS),
    ("0BSD", ISC_GRANT + ".\n\n" + ISC_AS_IS),
    ("BSD-2-Clause", BSD_HEAD + BSD_AS_IS),
    ("BSD-3-Clause", BSD_HEAD + BSD_NAMES + BSD_AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
]
#: Equivalent spellings, in canonical form.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"),
             ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("per cent", "percent"),
             ("copyright owner", "copyright holder"), ("http ", "https ")]
MARKS = re.compile(r"[^\w\n ]+|_+")
COPYRIGHT = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]|by )|\(c\)|©)[^\n]*"

COPYRIGHT_LINE = re.compile(COPYRIGHT)


def canonical_lines(text: str | None) -> list[str]:
    """The canonical form of each line; copyright lines are empty."""
    t = (text or "").lower()
    if "copyright" in t or "(c)" in t or "©" in t:
        t = COPYRIGHT_LINE.sub("\n", t)
    t = "\n".join([" ".join(x.split()) for x in MARKS.sub(" ", t).split("\n")])
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return t.split("\n")


def paragraphs(lines: list[str]) -> Iterator[str]:
    """The paragraphs of more than one line."""
    for filled, part in groupby(lines, bool):
        if filled and len(found := list(part)) > 1:
            yield " ".join(found)


def digests(texts: DataFrame) -> DataFrame:
    """row, doc_id, digest (of the whole text), empty (is its canonical form) and lines (a digest for each line and each longer paragraph) of row, doc_id, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                whole, empty, size, lines = [], [], [0], []
                for t in part.column("text").to_pylist():
                    found = canonical_lines(t)
                    c = " ".join(filter(None, found)).encode("utf-8", "replace")
                    whole.append(sha256(c).digest())
                    empty.append(not c)
                    lines += [sha256(x.encode("utf-8", "replace")).digest() for x in found if x]
                    lines += [sha256(x.encode("utf-8", "replace")).digest() for x in paragraphs(found)]
                    size.append(len(lines))
                yield pa.RecordBatch.from_pydict({
                    "row": part.column("row"), "doc_id": part.column("doc_id"), "digest": pa.array(whole, pa.binary()), "empty": empty,
                    "lines": pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(lines, pa.binary()))})

    return texts.mapInArrow(run, "row long, doc_id long, digest binary, empty boolean, lines array<binary>")


def known_digests(known: DataFrame) -> DataFrame:
    """digest, license: one row for each canonical text that isn't empty."""
    rows = known.where("name is not null").select(F.monotonically_increasing_id().alias("row"), F.col("name").cast("string").alias("name"),
                                                  F.col("text").cast("string").alias("text"))
    rows = cut_lineage(rows, "known")
    found = digests(rows.select("row", F.lit(None).cast("long").alias("doc_id"), "text")).where("not empty")
    return found.join(rows.select("row", "name"), "row").groupBy("digest").agg(F.min("name").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license (of the whole text), notices (names found on lines, sorted, with commas) and n_notices (such lines and paragraphs)."""
    spark = docs.sparkSession
    if known is not None:
        table = known_digests(known)
    else:
        full = spark.createDataFrame([(bytes.fromhex(d), n) for n, d in DIGESTS], "digest binary, license string")
        table = known_digests(spark.createDataFrame([*KNOWN, *HEADERS, *SPDX], "name string, text string")).union(full).groupBy("digest").agg(
            F.min("license").alias("license"))
    table = cut_lineage(table, "licenses")
    hint = F.broadcast if table.count() <= BROADCAST_ROWS else (lambda x: x)
    rows = digests(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    rows = rows.select("row", "doc_id", "digest", F.explode_outer("lines").alias("line"))
    rows = rows.join(hint(table.select(F.col("digest").alias("line"), F.col("license").alias("notice"))), "line", "left")
    rows = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"),
                                   F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count("notice").alias("n_notices"))
    return rows.join(hint(table), "digest", "left").select("doc_id", F.lower(F.hex("digest")).alias("digest"), "license", "notices", "n_notices")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan of every whole text of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    def lines(c: str) -> str:
        t = f"regexp_replace(lower(coalesce({c}, '')), '{COPYRIGHT}', '\n', 'g')"
        t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\n]+', ' ', 'g')"
        t = f"trim(regexp_replace({t}, ' *\n *', '\n', 'g'))"
        for a, b in SPELLINGS:
            t = f"replace({t}, '{a}', '{b}')"
        return t

    whole = "trim(regexp_replace({}, '[ \n]+', ' ', 'g'))".format
    quote = lambda t: "'{}'".format(t.replace("'", "''"))
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in [*KNOWN, *HEADERS, *SPDX])
    full = ", ".join(f"({quote(d)}, {quote(n)})" for n, d in DIGESTS)
    return f"""
WITH k AS (SELECT digest, min(license) AS license FROM (
             SELECT sha256(c) AS digest, n AS license FROM (SELECT {whole(lines('t'))} AS c, n FROM (VALUES {values}) AS v(n, t)) WHERE c <> ''
             UNION ALL SELECT * FROM (VALUES {full}) AS f(digest, license)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, {lines('text')} AS lines FROM documents),
u AS (SELECT r, trim(x) AS x FROM (SELECT r, unnest(string_split(lines, '\n')) AS x FROM d)
      UNION ALL
      SELECT r, replace(p, '\n', ' ') FROM (SELECT r, trim(unnest(string_split_regex(lines, '\n\n+')), '\n') AS p FROM d) WHERE contains(p, '\n')),
l AS (SELECT r, sha256(x) AS digest FROM u WHERE x <> ''),
f AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM l JOIN k USING (digest) GROUP BY r),
w AS (SELECT r, doc_id, sha256({whole('lines')}) AS digest FROM d)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM w LEFT JOIN f USING (r) LEFT JOIN k USING (digest)
"""


OP8_SQL = _sql()
