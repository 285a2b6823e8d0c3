import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from textscore.llm import queries
from tests.compare import connect, differences
from tests.llm.helpers import odd_docs, prose, words
from tests.llm.test_jaccard_tree import brute as brute_copies
from tests.llm.test_line_dedup import brute as brute_lines

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name]) == ""


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_returns_every_document(spark, name):
    df = queries.QUERIES[name](spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [r["doc_id"] for r in df.select("doc_id").collect()]
    if name == "op5_decontamination":
        assert set(ids) <= {r["doc_id"] for r in documents.select("doc_id").collect()} and ids
    else:
        assert sorted(ids) == sorted(r["doc_id"] for r in documents.select("doc_id").collect())


def test_entry_registers_all():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted toxic, repeated, copied and benchmark text, and clean ones."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage, item = prose(500, 77), " ".join(words(25, 5, 10 ** 6))
    texts = {i: prose(300, 1000 + i) for i in range(60)}
    for i in range(60, 90):
        texts[i] = prose(200, 1000 + i) + " grumblefoot vilething grumblefoot."
    for i in (90, 91, 92):
        texts[i] = prose(300, 1000 + i) + " " + passage + " " + prose(120, 2000 + i)
    base = words(150, 3, 10 ** 6)
    for i in (93, 94, 95):
        texts[i] = " ".join(w if k != i - 93 else "changed" for k, w in enumerate(base))
    texts[96] = prose(200, 3000) + " " + item + " " + prose(100, 3001)
    texts[97], texts[98] = None, ""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    marks = [(i, 1, int(60 <= i < 90)) for i in range(0, 97)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_stages_against_brute_force(spark, corpus):
    folder, texts = corpus
    docs, at = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        at[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i: t for i, t in texts.items() if not 60 <= i < 90}
    assert at["toxicity"] == clean
    cut = {i: v[0] for i, v in brute_lines([(i, t) for i, t in clean.items() if t is not None]).items()} | {97: None}
    assert at["line_dedup"] == cut and len(cut[91]) < len(texts[91])
    groups = brute_copies(sorted(cut.items()))
    kept = {i: t for i, t in cut.items() if groups[i][1] == i}
    assert at["jaccard_join"] == kept and 93 in kept and 94 not in kept
    assert at["decontamination"] == {i: t for i, t in kept.items() if i != 96}
    mixed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in mixed} <= {i for i, t in at["decontamination"].items() if t}
    assert len({r["doc_id"] for r in mixed}) >= 55


def test_rows_of_one_id_are_one_document(spark):
    copy, other = prose(300, 41), prose(300, 42)
    rows = [(1, copy), (2, copy), (2, other), (5, other), (6, prose(300, 43)), (6, prose(300, 44)), (None, copy), (4, ""), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, df, None).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted(
        [(0, copy), (1, copy), (4, ""), (4, ""), *[(i, t) for i, t in rows if i == 6]])


def test_stages_take_odd_and_empty_documents(spark, corpus):
    folder, _ = corpus
    odd = odd_docs(spark)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            rows = out.collect()
            assert len(rows) <= docs.count() or name == "mixing"
            assert name == "mixing" or out.columns == list(corpus_pipeline.COLUMNS)
