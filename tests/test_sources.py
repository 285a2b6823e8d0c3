import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textscore import schemas
from textscore.sources import readers, work, writers


def write(path, data):
    path.write_bytes(data)
    return str(path)


def test_malformed_lines(spark, rows, tmp_path):
    lines = b'speech_id|speech\n1|x\n2|y|z\n3\n4|"q ""in"" q"\n5|"a|b"\n6|caf\xe9\n7|"two\nlines"\n'
    path = write(tmp_path / "speeches.txt", lines)
    speeches = readers.read_speeches(spark, path)
    expected = [(1, "x"), (3, None), (4, 'q "in" q'), (5, "a|b"), (6, "café"), (7, "two\nlines")]
    assert rows(speeches, "speech_id") == expected
    assert speeches.count() == 6
    assert speeches.select("speech_id").count() == 6
    assert sorted(r[0] for r in speeches.select("speech_id").collect()) == [1, 3, 4, 5, 6, 7]


def test_long_lines_are_an_error_in_the_map(spark, tmp_path):
    head = b"speakerid|speech_id|lastname|firstname|state|district\n"
    good = readers.read_speaker_map(
        spark, write(tmp_path / "a.txt", head + b"1|2|Reed|J|RI|\n3|4|Lee\n5|6|NA|nan|\"\"|NA\n"))
    assert [tuple(r) for r in good.collect()] == [
        (1, 2, "Reed", "J", "RI", None), (3, 4, "Lee", None, None, None), (5, 6, None, None, None, None)]
    bad = readers.read_speaker_map(spark, write(tmp_path / "b.txt", head + b"1|2|Reed|J|RI|1.0|x\n"))
    with pytest.raises(Exception, match="too many fields"):
        bad.collect()


def test_dumps_are_read_by_header_name(spark, rows, tmp_path):
    head = b"speakerid|speech_id|lastname|firstname|chamber|state|gender|party|district|nonvoting\n"
    wide = readers.read_speaker_map(spark, write(tmp_path / "wide.txt", head + b"1|2|Reed|J|S|RI|M|D||voting\n"))
    assert rows(wide) == [(1, 2, "Reed", "J", "RI", None)]
    turned = readers.read_speaker_map(spark, write(
        tmp_path / "turned.txt", b"district|state|firstname|lastname|speech_id|speakerid\n4|RI|J|Reed|2|1\n"))
    assert rows(turned) == [(1, 2, "Reed", "J", "RI", 4.0)]
    with pytest.raises(ValueError, match="missing columns: speech"):
        readers.read_speeches(spark, write(tmp_path / "none.txt", b"speech_id|text\n1|x\n"))


def test_faults_of_a_dump_are_counted(spark, rows, tmp_path):
    path = write(tmp_path / "speeches.txt", b"speech|extra|speech_id\nx|1|1\ny|2|2|3\nz|3|four\nw|4|NA\n")
    assert rows(readers.read_speeches(spark, path), "speech") == [(None, "w"), (1, "x"), (None, "z")]
    assert rows(readers.dump_faults(spark, path, schemas.SPEECHES)) == [(4, 1, 1)]


def test_scores_by_header(spark, rows, tmp_path):
    data = b'extra,gen.vote.pct,cycle,seat,lname,distcyc,dwdime,gwinner\n1,51.5,2016,federal:house,"O""Neil, T",2016_TX_1,NA,W\n'
    scores = readers.read_scores(spark, write(tmp_path / "s.csv", data))
    assert scores.columns == schemas.SCORES.names
    assert rows(scores) == [(2016, "federal:house", 'O"Neil, T', "2016_TX_1", None, 51.5, "W")]


def test_texts(spark, rows, tmp_path):
    write(tmp_path / "ad.one.txt", b"hello\r\nA\xffB\rC")
    write(tmp_path / "two.txt", "kept � mark".encode())
    write(tmp_path / "other.csv", b"no")
    assert rows(readers.read_texts(spark, str(tmp_path)), "vidfile") == [
        ("ad.one", "hello\nAB\nC"), ("two", "kept � mark")]


def test_no_texts(spark, tmp_path):
    empty = readers.read_texts(spark, str(tmp_path / "absent"))
    assert empty.columns == ["vidfile", "ad_text"] and empty.isEmpty()
    (tmp_path / "folder").mkdir()
    assert readers.read_texts(spark, str(tmp_path / "folder")).isEmpty()


def test_optional_and_required(spark, tmp_path):
    path = str(tmp_path / "t")
    assert readers.read_optional(spark, path) is None
    with pytest.raises(AnalysisException):
        readers.read_table(spark, path)
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert readers.read_or_build(spark, path, build).count() == 3
    assert readers.read_or_build(spark, path, build).count() == 3 and calls == [1]


def test_writers(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 'x, "y"\nz')], "id int, tokens array<string>, t string")
    writers.export_csv(df, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"), "id int, tokens string, t string")
    assert rows(back) == [(1, "a b", 'x, "y"\nz')]
    assert writers.write_if_rows(df, str(tmp_path / "d")) and not writers.write_if_rows(df.where("id > 1"), str(tmp_path / "e"))
    assert readers.read_optional(spark, str(tmp_path / "e")) is None


def test_words(spark, rows, tmp_path):
    path = write(tmp_path / "w.txt", b"the\n\n of \n")
    assert rows(readers.read_words(spark, path), "word") == [("of",), ("the",)]


def test_an_empty_result_leaves_no_older_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.write_if_rows(spark.range(3), path) and readers.read_table(spark, path).count() == 3
    assert not writers.write_if_rows(spark.range(0), path)
    assert readers.read_optional(spark, path) is None


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work.work_dir(Session())


def test_a_run_removes_its_working_tables(spark):
    with work.working(spark) as folder:
        df = work.materialise(spark.range(5), "x")
        assert work.work_dir(spark) == folder and df.count() == 5
    assert work.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(AnalysisException):
        spark.read.parquet(folder)


def test_work_dir_is_the_session_s(spark):
    assert work.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = work.materialise(spark.range(5).withColumn("a", F.array("id")), "x")
    assert df.count() == 5 and df.inputFiles()[0].split("file:")[-1].lstrip("/").startswith(
        work.work_dir(spark).lstrip("/"))
