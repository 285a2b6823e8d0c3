"""Line dedup: overlapping windows of three lines, found globally, later occurrences removed.

A line ends after a line break, or after `.`, `!` or `?` and a blank, so that passages pasted into
a paragraph line up as well. The lines of a text always concatenate to it. Each window of `width`
consecutive lines is hashed from its trimmed lines (96 bits). Of all windows with one hash the
first, by (id, text hash, position), stays; every line covered by a later one is removed, overlapping
windows merged. A window counts if its trimmed lines hold `min_chars` characters, one by default: only blank
lines are never a repeat. Texts of fewer than `width` lines have no window.

Windows are hashed in Arrow batches; all else is DataFrame expressions. A hash's first place is a
minimum, combined before the shuffle; the windows of repeated hashes come back by a plain join,
which Spark splits where a hash is hot. Only the covered positions of one text are ever gathered.

Defined results: a null text stays null, an empty one empty, both with 0 lines. Rows of one id
with different texts are told apart by the text's hash; rows equal in id and text are one document
and get the same result. Null ids sort last. A repeat within a text is a later occurrence too.
Extra columns stay, whatever their names; one named like a result column is replaced.
"""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textscore.llm.text import combine, hash_spans, mix, slices, unused, without

BREAK = r"(?<=\n)|(?<=[.!?] )"


def lines_of(text):
    """The lines of a text as an array; they concatenate to the text."""
    # A text that ends in a break gives a last empty part, which is no line.
    return F.filter(F.split(text, BREAK), lambda x: x != "")


def line_windows(texts, width=3, min_chars=1):
    """(text, at, h1, h2) of the windows of some texts (bytes), as arrays."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    offset = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    stop = np.isin(data, np.frombuffer(b".!?", np.uint8))
    ends = data == 10
    ends[1:] |= (data[1:] == 32) & stop[:-1]
    end = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], end[:-1]])
    owner = np.searchsorted(offset, start, side="right") - 1
    real = start < offset[owner + 1] - 1              # else the line break put between two texts
    start, end, owner = start[real], end[real], owner[real]
    body = np.flatnonzero(~np.isin(data, np.frombuffer(b" \t\r\n", np.uint8)))
    first, last = np.searchsorted(body, start), np.searchsorted(body, end) - 1
    blank = last < first
    first, last = np.minimum(first, max(len(body) - 1, 0)), np.maximum(last, 0)
    begin = np.where(blank, start, body[first] if len(body) else 0)
    finish = np.where(blank, start, body[last] + 1 if len(body) else 0)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[finish] - points[begin]
    hashes = hash_spans(data, begin, finish)
    n = len(hashes) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    total = sum(chars[k:k + n] for k in range(width))
    at = np.flatnonzero((owner[:n] == owner[width - 1:]) & (total >= min_chars))
    line = np.arange(len(owner)) - np.searchsorted(owner, owner)
    h = combine(hashes, width)[at]
    other = combine(mix(hashes + np.uint64(0x632BE59BD9B4E019)), width)[at] >> np.uint64(33)
    return owner[at], line[at], h.view(np.int64), other.astype(np.int64)


def windows(docs, text="text", key="doc_id", width=3, min_chars=1):
    """(_id, _copy, h1, h2, at): every window that is long enough."""
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                owner, at, h1, h2 = line_windows(texts, width, min_chars)
                take = pa.array(owner)
                yield pa.RecordBatch.from_pydict({
                    "_id": rows.column("_id").take(take), "_copy": rows.column("_copy").take(take),
                    "h1": pa.array(h1), "h2": pa.array(h2.astype(np.int32)),
                    "at": pa.array(at.astype(np.int32))})

    kind = docs.schema[key].dataType.simpleString()
    body = F.col(f"`{text}`")
    return (docs.select(F.col(f"`{key}`").alias("_id"), F.xxhash64(body).alias("_copy"), body.alias("_text"))
            .mapInArrow(run, f"_id {kind}, _copy long, h1 long, h2 int, at int"))


def covered_lines(docs, text="text", key="doc_id", width=3, min_chars=1):
    """(_id, _copy, covered): the positions of the lines to remove, per text that has any."""
    rows = windows(docs, text, key, width, min_chars)
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"),
                     F.col("_copy").alias("c"), F.col("at").alias("p"))
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("z"))
    later = (rows.join(first.filter(F.col("a") != F.col("z")), ["h1", "h2"])
             .filter(place != F.col("a")))
    lines = F.explode(F.sequence(F.col("at"), F.col("at") + F.lit(width - 1)))
    return (later.select("_id", "_copy", lines.alias("line")).groupBy("_id", "_copy")
            .agg(F.collect_set("line").alias("covered")))


def remove_repeated_lines(docs, text="text", key="doc_id", width=3, min_chars=1):
    """`docs` with the text cleaned in place, and `n_lines`, `n_removed` (long)."""
    docs = without(docs, "n_lines", "n_removed")
    body, columns = F.col(f"`{text}`"), docs.columns
    names = unused(docs, "_id", "_copy", "covered", "_own", "_lines")
    found = covered_lines(docs, text, key, width, min_chars).toDF(*names[:3])
    of_id, copy, covered, own, lines = (F.col(f"`{c}`") for c in names)
    same = F.col(f"`{key}`").eqNullSafe(of_id) & (own == copy)
    joined = docs.withColumn(names[3], F.xxhash64(body)).join(found, same, "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "")
    count = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))
    return (joined.withColumn(names[4], lines_of(body))
            .withColumns({"n_lines": count(lines).cast("long"),
                          "n_removed": count(covered).cast("long"),
                          text: F.when(covered.isNull(), body).otherwise(cleaned)})
            .select(*[F.col(f"`{c}`") for c in columns], "n_lines", "n_removed"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, t.pos AS pos, t.line AS line FROM (
    SELECT doc_id, unnest(list_transform(list_zip(range(len(l)), l),
                                         lambda x: struct_pack(pos := x[1], line := x[2]))) AS t
    FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(1),
                 'g'), chr(1)), lambda x: x <> '') AS l FROM documents)) ),
wide AS (
  SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(13) || chr(10)) AS a,
         lead(trim(line, chr(32) || chr(9) || chr(13) || chr(10)), 1) OVER w AS b,
         lead(trim(line, chr(32) || chr(9) || chr(13) || chr(10)), 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
  FROM wide WHERE c IS NOT NULL AND length(a) + length(b) + length(c) >= 1),
covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest(range(3)) AS k) WHERE nth > 1)
SELECT d.doc_id, coalesce(string_agg(l.line, '' ORDER BY l.pos) FILTER (c.pos IS NULL),
                          CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE '' END) AS text,
       count(l.pos) AS n_lines, count(c.pos) AS n_removed
FROM documents d LEFT JOIN lines l USING (doc_id)
LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos
GROUP BY d.doc_id"""
