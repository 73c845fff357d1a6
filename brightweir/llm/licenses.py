"""License scans by canonical digests.

A text is brought into a canonical form: lower case, no copyright lines, equivalent
spellings alike, only letters and digits, single spaces. Its digest is looked up in a
table of digests of known licences by a hash join, so texts are compared as a whole and
in one pass. The same lookup for every line finds one-line notices in longer texts.

All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import text_or_empty

#: The known digests are broadcast up to so many rows; a larger table is joined by shuffle.
BROADCAST_ROWS = 200_000
# Lines that name the holder of the rights, and spellings that count as the same.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\n]*(?:copyright|copr|all rights reserved|\(c\) *[0-9])[^\n]*$"
SPELLINGS = (  # of words between single spaces
    (r"licence", "license"),
    (r" sub licens", " sublicens"),
    (r" copyright (owner|holder)", " copyright holder"),
    (r"(acknowledg|judg)ement", "$1ment"),
    (r"([a-z]{3})is(e|ed|es|er|ers|ing|ation|ations) ", "$1iz$2 "),
    (r"([a-z]{2})our(s|ed|able|ite|) ", "$1or$2 "),
    (r" non (commercial|infringement)", " non$1"),
    (r" https? (www )?", " "),
)
# One-line notices, and short licences as their stewards publish them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0": "Released under CC0 1.0 Universal.",
}
TEXTS = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC": """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "0BSD": """BSD Zero Clause License

Copyright (C) <year> by <author>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "BSD-2-Clause": """Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
}


def canonical(text: Column) -> Column:
    """Canonical form of a text; null counts as empty."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), r"[^\p{L}\p{N}]+", " ")
    out = F.concat(F.lit(" "), words, F.lit(" "))
    for pattern, same in SPELLINGS:
        out = F.regexp_replace(out, pattern, same)
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """``(license_id, text)`` of the notices and licences above."""
    rows = [*NOTICES.items(), *TEXTS.items()]
    return spark.createDataFrame(rows, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, text_digest, license_id, notices)``, one row for each row of ``docs``.

    ``known`` has ``(license_id, text)``. ``license_id`` names the licence that the whole
    text is, ``notices`` those that single lines are: sorted, joined by commas. Both are
    null where there is none; of licences with the same canonical text the smallest id
    counts. A text without a canonical form (null, empty, only copyright lines) is no
    licence. Repeated rows give repeated results; other columns are not looked at.
    """
    forms = known.where("license_id is not null").select("license_id", canonical(text_or_empty()).alias("form")).where("form <> ''")
    table = forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("found"))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    lines = rows.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", digest(F.col("line")).alias("digest"))
    hits = lines.join(table, "digest").select("doc_id", "found").distinct()
    notices = hits.groupBy(F.col("doc_id").alias("of_doc")).agg(F.array_join(F.array_sort(F.collect_set("found")), ",").alias("notices"))
    whole = rows.select("doc_id", digest(F.col("text")).alias("digest")).join(table, "digest", "left")
    return whole.join(notices, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left").select(
        "doc_id", F.col("digest").alias("text_digest"), F.col("found").alias("license_id"), "notices"
    )


def canonical_sql(text: str) -> str:
    """The canonical form in DuckDB SQL."""
    out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
    out = f"(' ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ')"
    for pattern, same in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{same.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


def check_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for rows in (NOTICES, TEXTS) for k, t in rows.items())
    return f"""
WITH known AS (SELECT digest, min(license_id) AS found
               FROM (SELECT license_id, sha256({canonical_sql("text")}) AS digest FROM (VALUES {values}) AS t(license_id, text))
               GROUP BY digest),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS (SELECT DISTINCT doc_id, found
         FROM (SELECT doc_id, sha256({canonical_sql("line")}) AS digest
               FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)) JOIN known USING (digest)),
notices AS (SELECT doc_id, string_agg(found, ',' ORDER BY found) AS notices FROM hits GROUP BY doc_id)
SELECT d.doc_id, d.digest AS text_digest, k.found AS license_id, n.notices
FROM (SELECT doc_id, sha256({canonical_sql("text")}) AS digest FROM docs) d
LEFT JOIN known k USING (digest) LEFT JOIN notices n ON n.doc_id = d.doc_id
"""
