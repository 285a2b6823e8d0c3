"""Records of delimited files whose quoted fields may span lines, read by all cores.

Spark splits a file at line breaks, wherever they are. A line break ends a record only outside quotes, and whether a
split begins inside quotes depends on all of the file before it. So the file is read three times, each time split:

1. Each split says how it would end if it began outside quotes, and if it began inside. Splits in the order of
   their file then give the true beginning of each: the last split before it that ends alike both ways decides,
   turned once by every split since that ends the other way round.
2. The pieces of records that cross a split's border, two a split at most, are put together.
3. Each split gives the records that it holds whole.

A quote opens a field only as its first character; inside, two quotes are one, and any other quote ends the quoted
part. The driver holds nine bytes per split.

Defined results: a record ends without its line break, `\\n` or `\\r\\n`, and keeps those inside quotes. Blank lines outside
quotes are no records. A quote that is never closed takes the rest of its file. An empty folder gives no records. The
order of the records is not kept.
"""

import re

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Quotes:
    """How a line, as bytes, ends for each way of beginning: inside quotes (True) or outside."""

    def __init__(self, sep):
        s = re.escape(sep.encode())
        quoted = rb'(?:[^"]++|"")*+'
        field = rb'(?:"' + quoted + rb'"[^' + s + rb']*+|[^"' + s + rb'][^' + s + rb']*+|)'
        self._open = re.compile(rb'(?:' + field + s + rb')*+"' + quoted)
        self._close = re.compile(quoted + rb'"[^' + s + rb']*+(?:' + s + rb')?')
        self._sep = sep.encode()

    def after(self, line, inside):
        if b'"' not in line:
            return inside
        at = 0
        if inside:
            closed = self._close.match(line)
            if not closed:
                return True
            at = closed.end()
            if line[at - 1:at] != self._sep:
                return False
        return self._open.fullmatch(line, at) is not None


def _lines(spark, path):
    """(file, start, split, line): a file's lines in order inside each split; `split` is a hash of the first two."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"))
    return lines.select("file", "start", F.xxhash64("file", "start").alias("split"), "line")


def _by_split(batches):
    """(file, start, split, lines, new) for the consecutive lines of one split in a batch; `new` at its first ones."""
    before = None
    for batch in batches:
        split = np.asarray(batch.column("split"))
        edges = np.concatenate([[0], np.flatnonzero(split[1:] != split[:-1]) + 1, [len(split)]])
        for a, b in zip(edges, edges[1:]):
            if b > a:
                own = int(split[a])
                yield (batch.column("file")[a].as_py(), batch.column("start")[a].as_py(), own,
                       batch.column("line").slice(a, b - a).to_pylist(), own != before)
                before = own


def _endings(lines, sep):
    """(file, start, split, outside, inside): how a split ends if it begins outside or inside quotes."""
    def run(batches):
        quotes, seen = Quotes(sep), {}
        for file, start, split, some, new in _by_split(batches):
            out, inn = seen[split][2:] if not new else (False, True)
            for line in some:
                if b'"' in line:
                    same = out == inn
                    out = quotes.after(line, out)
                    inn = out if same else quotes.after(line, inn)
            seen[split] = (file, start, out, inn)
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([v[0] for v in seen.values()], pa.int64()), "start": pa.array([v[1] for v in seen.values()], pa.int64()),
            "split": pa.array(list(seen), pa.int64()), "outside": pa.array([v[2] for v in seen.values()], pa.bool_()),
            "inside": pa.array([v[3] for v in seen.values()], pa.bool_())})

    return lines.mapInArrow(run, "file long, start long, split long, outside boolean, inside boolean")


def _beginnings(endings):
    """(split, begins): whether each split begins inside quotes."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("outside") == F.col("inside")
    turns = endings.withColumn("turns", F.coalesce(F.sum((~fixed & F.col("outside")).cast("int")).over(before), F.lit(0)))
    known = F.last(F.when(fixed, F.struct("turns", "outside")), ignorenulls=True).over(before)
    turns = turns.withColumn("known", known)
    since = F.col("turns") - F.coalesce("known.turns", F.lit(0))
    return turns.select("split", (F.coalesce("known.outside", F.lit(False)) != (since % 2 == 1)).alias("begins"))


WHOLE, HEAD, TAIL = 0, 1, 2


def _records(lines, sep, encoding, header, begins, whole):
    """(file, start, kind, record): the whole records of the splits, or the pieces that cross their borders."""
    def run(batches):
        quotes, (splits, states) = Quotes(sep), begins.value
        out, held, size = [], [], 0
        own = kind = inside = None
        names = False                                   # whether a file's first record is still to come

        def put(kind, held):
            nonlocal names
            if kind == WHOLE and held in ([b""], [b"\r"]):
                return 0
            if names:
                names = False
            elif whole == (kind == WHOLE):
                out.append((*own, kind, b"\n".join(held).decode(encoding, "replace")))
                return len(out[-1][3])
            return 0

        def batch():
            file, start, kinds, texts = zip(*out) if out else ((), (), (), ())
            return pa.RecordBatch.from_pydict({
                "file": pa.array(file, pa.int64()), "start": pa.array(start, pa.int64()),
                "kind": pa.array(kinds, pa.int32()), "record": pa.array(texts, pa.string())})

        for file, start, split, some, new in _by_split(batches):
            if new:
                if held:
                    size += put(HEAD if kind == HEAD else TAIL, held)
                at = np.searchsorted(splits, split)
                if at == len(splits) or splits[at] != split:
                    raise RuntimeError("the splits of a file changed between two reads of it")
                inside, held, own = bool(states[at]), [], (file, start)
                names = header and start == 0
                kind = HEAD if inside else WHOLE
            for line in some:
                held.append(line)
                inside = quotes.after(line, inside)
                if not inside:
                    size += put(kind, held)
                    held, kind = [], WHOLE
                if size > 1 << 20:
                    yield batch()
                    out, size = [], 0
        if held:
            put(HEAD if kind == HEAD else TAIL, held)
        yield batch()

    return lines.mapInArrow(run, "file long, start long, kind int, record string")


def read_records(spark, path, sep=",", encoding="UTF-8", header=True):
    """(record): the records of delimited files; with `header`, without the first one of each file."""
    lines = _lines(spark, path)
    found = _beginnings(_endings(lines, sep)).toArrow()
    splits = np.asarray(found["split"]).astype(np.int64)
    order = np.argsort(splits)
    begins = spark.sparkContext.broadcast((splits[order], np.asarray(found["begins"])[order]))
    pieces = _records(lines, sep, encoding, header, begins, False)
    # A piece at a split's end opens a record, one at a split's beginning goes on with the last one opened.
    opened = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    crossing = (pieces.withColumn("own", F.sum((F.col("kind") == TAIL).cast("int")).over(opened)).where("own > 0")
                .groupBy("file", "own")
                .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"))
                .select(F.array_join("parts.record", "\n").alias("record")))
    records = _records(lines, sep, encoding, header, begins, True).select("record").unionByName(crossing)
    return records.select(F.regexp_replace("record", r"\r\z", "").alias("record"))
