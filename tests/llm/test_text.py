import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from textscore.llm.text import Words, combine, in_small_batches

ALPHABET = st.text(alphabet="aAbBzZéÉ ß.\n\t\r\x0b\x0c  🙂", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=6))
def test_words_are_those_of_a_bytes_split(texts):
    raw = [t.encode() for t in texts]
    found = Words(raw)
    expected = [t.lower().split() for t in raw]
    assert found.count.tolist() == [len(x) for x in expected]
    flat = [w for x in expected for w in x]
    assert [bytes(found.data[a:b]).lower() for a, b in zip(found.start, found.end)] == flat
    for w, h in zip(flat, found.hash):
        assert all((w == v) == (h == g) for v, g in zip(flat, found.hash))


def test_hashes_do_not_depend_on_the_batch():
    one, two = Words([b"x y z"]), Words([b"long before", b"", b"q x y z"])
    assert one.hash.tolist() == two.hash[-3:].tolist()
    assert combine(one.hash, 3).tolist() == combine(two.hash, 3)[-1:].tolist()
    assert len(combine(one.hash, 4)) == 0


def test_long_words_differ_past_the_table_of_places():
    a, b = b"a" * 9000, b"a" * 8999 + b"b"
    assert len(np.unique(Words([a, b, b"a" * 9001]).hash)) == 3


def test_small_batches_hold_few_bytes_and_end_with_the_operator(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    table = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("t"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes])})

    @in_small_batches
    def largest(df):
        return max(r["bytes"] for r in df.mapInArrow(sizes, "bytes long").collect())

    before = spark.conf.get(limit, None)
    assert largest(table) < 5 << 20
    assert spark.conf.get(limit, None) == before
