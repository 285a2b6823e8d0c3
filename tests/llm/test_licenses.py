from textscore.llm import licenses as li
from tests.llm.helpers import docs, empty, odd_docs, prose

MIT = next(b for n, b in li.KNOWN if n == "MIT")


def found(df, **options):
    return {r["doc_id"]: (r["whole_license"], r["licenses"], r["n_license_lines"]) for r in li.scan(df, **options).collect()}


def test_spelling_case_punctuation_and_copyright_lines_do_not_matter(spark):
    variant = "Copyright (c) 2019 Some Body\n" + MIT.upper().replace("LICENSE", "LICENCE").replace(",", " ,")
    texts = [MIT, variant, MIT + " And one more word.", prose(100, 1) + "\nLicenced under the  apache license, VERSION 2.0!\nend",
             "All rights reserved.\nall  rights RESERVED", None, "", "Copyright 2020 X"]
    rows = found(docs(spark, texts))
    assert rows[0][0] == rows[1][0] == "MIT" and rows[2][0] is None
    assert rows[3] == (None, "Apache-2.0", 1)
    assert rows[4] == (None, "all-rights-reserved", 2)
    assert rows[5] == rows[6] == rows[7] == (None, "", 0)


def test_known_licences_may_be_given(spark):
    known = li.known_licenses(spark, [("B", "some text"), ("A", "Some, Text!"), ("C", "other")])
    assert found(docs(spark, ["SOME TEXT", "x"]), known=known) == {0: ("A", "A", 1), 1: (None, "", 0)}


def test_odd_rows(spark):
    assert li.scan(odd_docs(spark)).count() == 10
    assert li.scan(empty(spark)).collect() == []
    twice = docs(spark, [(1, "All rights reserved."), (1, "All rights reserved."), (None, "All rights reserved.")])
    assert [r["n_license_lines"] for r in li.scan(twice).collect()] == [1, 1, 1]
