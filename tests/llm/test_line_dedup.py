import re

from pyspark.sql import functions as F

from textscore.llm import line_dedup
from tests.llm.helpers import docs, empty, odd_docs, prose


def brute(rows, width=3, least=1):
    """(id, cleaned, lines, removed) of (id, text) rows with distinct ids, in one process."""
    cut = {i: [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", t or "") if x] for i, t in rows}
    seen, gone = {}, {i: set() for i in cut}
    for i in sorted(cut):
        bare = [x.strip(" \t\r\n") for x in cut[i]]
        for at in range(len(bare) - width + 1):
            key = tuple(bare[at:at + width])
            if sum(map(len, key)) < least:
                continue
            if key in seen:
                gone[i] |= set(range(at, at + width))
            seen.setdefault(key, (i, at))
    return {i: ("".join(x for k, x in enumerate(cut[i]) if k not in gone[i]), len(cut[i]), len(gone[i]))
            for i in cut}


def run(df):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"])
            for r in line_dedup.remove_repeated_lines(df).collect()}


def test_against_brute_force(spark):
    shared = prose(420, 9)
    rows = [prose(150, 1), "Lead in words here " + shared + " tail. End of it.", prose(90, 2) + " " + shared,
            "\n".join(["same line here and again", "other line", "third line of it"] * 3), shared, shared + "\n",
            "Short. " * 50, "a\nb\nc", None, "", "no break at all", prose(200, 1)]
    expected = brute(list(enumerate(rows)))
    found = run(docs(spark, rows))
    assert {i: v for i, v in found.items() if rows[i] is not None} == \
        {i: v for i, v in expected.items() if rows[i] is not None}
    assert found[8] == (None, 0, 0) and found[9] == ("", 0, 0)


def test_short_lines_count_and_blank_ones_do_not(spark):
    rows = ["a\nb\nc\nd", "x\na\nb\nc\ny", "\n\n\n\nhead\n", "\n\n\n\nother\n"]
    found = run(docs(spark, rows))
    assert found == brute(list(enumerate(rows)))
    assert found[1] == ("x\ny", 5, 3) and found[3][2] == 0


def test_clashing_names_stay(spark):
    shared = prose(300, 4)
    df = docs(spark, [shared, "Lead. " + shared])
    plain = run(df)
    names = ["_id", "_copy", "covered", "_own", "_lines", "__id", "at", "h1", "line", "_TEXT"]
    wide = df
    for n in names:
        wide = wide.withColumn(n, F.lit("mine"))
    assert run(wide) == plain and plain[1][2] > 0
    assert all(r[n] == "mine" for r in line_dedup.remove_repeated_lines(wide).collect() for n in names)


def test_a_passage_is_cut_from_later_documents_only(spark):
    passage = prose(500, 5)
    found = run(docs(spark, ["First part. " + passage + " Its own end.", "Other words. " + passage + " Another end."]))
    assert found[0][2] == 0
    assert found[1][0].startswith("Other words.") and found[1][0].endswith("Another end.")
    assert len(found[1][0]) < 200


def test_odd_rows(spark):
    rows = line_dedup.remove_repeated_lines(odd_docs(spark)).collect()
    assert len(rows) == 10
    copies = [r for r in rows if r["doc_id"] == 6]
    assert copies[0] == copies[1] and copies[0]["n_removed"] == 0
    assert {"score", "kept"} <= set(rows[0].asDict())
    assert line_dedup.remove_repeated_lines(empty(spark)).collect() == []


def test_repeats_of_a_group_are_found_whatever_its_size(spark):
    rows = [(i, f"Unique {i} start. " + prose(160, 7)) for i in range(60)]
    found = run(docs(spark, rows))
    assert found == brute(rows) and sum(v[2] > 0 for v in found.values()) == 59
