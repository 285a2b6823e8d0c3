"""Licence scan by canonical digest: entire texts are normalised, digested and looked up.

A canonical text is lower-cased (A-Z), without copyright lines, with equivalent spellings unified
(licence/license, `(c)`, quotes, `http`/`https`), punctuation dropped and white space collapsed. The
SHA-256 of an entire canonical text is joined with the digests of known licences. The units are
the whole document and each of its lines, so a notice line inside prose is an entire text too.

Everything is a DataFrame expression. The table of known licences is a fixed list of this module
(or the caller's, broadcast only after its size was checked).

Defined results: null and empty texts have no licence; ties (one digest known under two names) go
to the first name; rows equal in id and text get one result each, the same. Extra columns stay out.
"""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from textscore.operators.joins import lookup_join

# Spellings that count as equal, in the order in which they are applied.
SPELLINGS = (
    (r"licence", "license"), (r"licens(?:ed|ing)", "license"), (r"sub-license", "sublicense"),
    (r"non-commercial", "noncommercial"), (r"https", "http"), (r"\(c\)|©", "copyright"),
    (r"organisation", "organization"), (r"merchantibility", "merchantability"),
    (r"version ", "v"), (r"&", "and"),
)
# The lines that carry a holder or a year and differ from copy to copy.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(?:copyright|©|\(c\))[^\n]*(?:\d{4}|©|\(c\))[^\n]*$"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted")
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.")
# Public licence texts and notices, by identifier.
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a "
     "copy of this software and associated documentation files (the \"Software\"), to deal in the "
     "Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe "
     "above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC + ", provided that the above copyright notice and this permission "
     "notice appear in all copies.\n\n" + _AUTHOR),
    ("0BSD", "Zero-Clause BSD\n\n" + _ISC + ".\n\n" + _AUTHOR),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
)


def _rules():
    return [(COPYRIGHT, " "), *SPELLINGS, (r"[^\p{L}\p{N}\n]+", " ")]


def canonical_lines(text):
    """The canonical form of a text, its line breaks kept."""
    out = F.translate(text, ascii_uppercase, ascii_lowercase)
    for pattern, to in _rules():
        out = F.regexp_replace(out, pattern, to)
    return out


def canonical(text):
    """The canonical form of an entire text."""
    return F.trim(F.regexp_replace(canonical_lines(text), r"[ \n]+", " "))


def known_licenses(spark, known=KNOWN):
    """(digest, license) of the known texts, one row per digest."""
    rows = spark.createDataFrame(list(known), "license string, body string")
    return (rows.groupBy(F.sha2(canonical(F.col("body")), 256).alias("digest"))
            .agg(F.min("license").alias("license")))


def scan(docs, text="text", key="doc_id", known=None):
    """(key, whole_license, licenses, n_license_lines) per row of `docs`.

    `whole_license` is the licence of the entire text or null, `licenses` those of the text and of its
    lines, distinct, sorted and joined by commas.
    """
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known
    body = F.col(f"`{text}`")
    units = docs.select(F.col(f"`{key}`").alias(key), F.xxhash64(body).alias("_copy"),
                        canonical_lines(F.coalesce(body, F.lit(""))).alias("_lines"))
    entire = F.trim(F.regexp_replace(F.col("_lines"), r"[ \n]+", " "))
    lines = F.filter(F.transform(F.split("_lines", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    digests = F.concat(F.array(F.sha2(entire, 256)), F.transform(lines, lambda x: F.sha2(x, 256)))
    found = (lookup_join(units.select(key, "_copy", F.posexplode(digests).alias("at", "digest")),
                         known, "digest", "inner")
             # Rows that are equal in id and text are one document.
             .groupBy(key, "_copy", "at").agg(F.min("license").alias("license"))
             .groupBy(key, "_copy").agg(
                 F.max(F.when(F.col("at") == 0, F.col("license"))).alias("whole_license"),
                 F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
                 F.count_if(F.col("at") > 0).alias("n_license_lines")))
    rows = docs.select(F.col(f"`{key}`").alias(key), F.xxhash64(body).alias("_own"))
    same = rows[key].eqNullSafe(found[key]) & (F.col("_own") == F.col("_copy"))
    return (rows.join(found, same, "left")
            .select(rows[key], "whole_license", F.coalesce("licenses", F.lit("")).alias("licenses"),
                    F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines")))


def _sql_canonical(column):
    out = f"translate({column}, '{ascii_uppercase}', '{ascii_lowercase}')"
    for pattern, to in _rules():
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def oracle(known=KNOWN):
    values = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in known)
    squeeze = lambda c: f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'))"
    return f"""
    WITH known AS (SELECT sha256({squeeze(_sql_canonical('body'))}) AS digest, min(license) AS license
                   FROM (VALUES {values}) AS v(license, body) GROUP BY 1),
    texts AS (SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS c FROM documents),
    lines AS (SELECT doc_id, sha256(trim(line)) AS digest FROM
              (SELECT doc_id, unnest(string_split(c, chr(10))) AS line FROM texts)
              WHERE trim(line) <> ''),
    entire AS (SELECT doc_id, license FROM texts JOIN known ON digest = sha256({squeeze('c')})),
    hits AS (SELECT doc_id, license FROM lines JOIN known USING (digest)),
    names AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
              FROM (SELECT * FROM hits UNION ALL SELECT * FROM entire) GROUP BY 1)
    SELECT d.doc_id, e.license AS whole_license, coalesce(n.licenses, '') AS licenses,
           coalesce(h.n, 0) AS n_license_lines
    FROM documents d LEFT JOIN entire e USING (doc_id) LEFT JOIN names n USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1) h USING (doc_id)"""
