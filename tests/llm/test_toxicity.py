import numpy as np

from textscore.llm import toxicity as tx
from tests.llm.helpers import docs, empty, odd_docs, words


def corpus(spark, n=300):
    texts = [" ".join(words(40, i)) + (f" Stinkaboot{i % 5}! vilething " * (1 + i % 3) if i % 4 == 0 else "")
             for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, n, 2)] + [(1, None)],
                                   "doc_id long, toxic int")
    return docs(spark, texts), labels


def test_toxic_documents_are_rejected_and_clean_ones_kept(spark):
    df, labels = corpus(spark)
    rows = tx.verdicts(df, labels).collect()
    assert all(r["rejected"] == (r["doc_id"] % 4 == 0) for r in rows)
    assert all(0 <= r["severity"] <= 3 for r in rows)


def test_starts_of_words_are_features(spark):
    """An unseen ending of a known stem still counts."""
    df, labels = corpus(spark)
    model = tx.fit(df, labels)
    found = tx.score(docs(spark, ["stinkabootzzz stinkabootqq and more", "nothing here"]), model).collect()
    assert found[0]["p_any"] > found[1]["p_any"]


def test_severity_grows_with_the_grade():
    r = np.random.default_rng(2)
    x = r.random((600, 3))
    z = 6 * x[:, 0] - 2
    grades = np.digitize(z + r.logistic(size=600) * 0.3, [0, 1.5, 3])
    w, cuts = tx.fit_ordinal(x, grades, 4)
    assert (np.diff(cuts) > 0).all() and w[0] > 3 * max(abs(w[1]), abs(w[2]))
    guess = tx.expected_grade(x @ w, cuts)
    assert np.corrcoef(guess, grades)[0, 1] > 0.85


def test_gradient_against_differences():
    r = np.random.default_rng(3)
    x, grades = r.random((50, 2)), r.integers(0, 3, 50)
    w, cuts = tx.fit_ordinal(x, grades, 3, l2=0.0, steps=4000)

    def loss(w, cuts):
        p = 1 / (1 + np.exp(-(np.concatenate([[-50], cuts, [50]])[None, :] - (x @ w)[:, None])))
        return -np.log(p[np.arange(50), grades + 1] - p[np.arange(50), grades]).mean()

    best = loss(w, cuts)
    for step in np.eye(4) * 0.02:
        for sign in (1, -1):
            assert loss(w + sign * step[:2], cuts + sign * step[2:]) >= best - 1e-5


def test_odd_rows(spark):
    df, labels = corpus(spark)
    model = tx.fit(df, labels)
    rows = tx.score(odd_docs(spark), model).collect()
    assert len(rows) == 10 and "kept" in rows[0].asDict()
    assert len({r["severity"] for r in rows if r["doc_id"] in (1, 2, 3, 7)}) == 1
    assert tx.score(empty(spark), model).collect() == []
    none = labels.limit(0)
    assert tx.fit(df, none) is None and tx.fit(df, labels.filter("toxic = 1")) is None
    assert not any(r["rejected"] for r in tx.verdicts(df, none).collect())
