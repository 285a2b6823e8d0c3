"""Raw inputs as DataFrames with an explicit schema."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textscore import schemas
from textscore.sources.records import read_records

CORRUPT = "_corrupt_record"

# The words the delimited files use for a missing value.
NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def blank_null_words(df, columns, words=NULL_WORDS):
    """NULL for every listed spelling of a missing value."""
    return df.withColumns({
        c: F.when(~F.col(f"`{c}`").isin(*words), F.col(f"`{c}`")) for c in columns})


def read_csv(spark, path, schema, sep=",", encoding="UTF-8", multi_line=True):
    """A delimited file with a header and doubled quotes.

    Quoted fields may span lines; the file is split all the same, see `records`. Files known to have no such
    fields are read once instead of three times with `multi_line=False`.
    """
    return _csv(spark, path, schema, sep, encoding, multi_line)


def _csv(spark, path, schema, sep, encoding, multi_line, **options):
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", **options}
    if not multi_line:
        return spark.read.schema(schema).options(header=True, encoding=encoding, columnPruning=False, **options).csv(path)
    fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv("record", fields, options).alias("parsed")
    return read_records(spark, path, sep, encoding).select(parsed).select("parsed.*")


def _header(spark, path, sep=",", encoding="UTF-8"):
    return spark.read.options(header=True, sep=sep, encoding=encoding, escape='"').csv(path).columns


def read_scores(spark, path, multi_line=True):
    """The score table. The header is matched by name, so a wider file in any column order
    gives the columns of the contract; only those are parsed to their types."""
    full = schemas.SCORES.__class__()
    for name in _header(spark, path):
        full = full.add(name, "string")
    text = _csv(spark, path, full, ",", "UTF-8", multi_line)
    wanted = [f for f in schemas.SCORES if f.name in text.columns]
    text = blank_null_words(text, [f.name for f in wanted])
    return text.select(*[
        F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def _dump(spark, path, schema, sep, encoding, multi_line):
    """A dump's lines by its own header: all columns as text, the raw line, and whether it is too long."""
    header = _header(spark, path, sep, encoding)
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    # The position of a column is the header's; only the names asked for are used.
    names = [h if h in schema.names else f"_other{k}" for k, h in enumerate(header)]
    full = schema.__class__()
    for name in names:
        full = full.add(name, "string")
    lines = _csv(spark, path, full.add(CORRUPT, "string"), sep, encoding, multi_line, columnNameOfCorruptRecord=CORRUPT)
    unquoted = F.regexp_replace(F.col(CORRUPT), '"(?:[^"]|"")*"', "")
    extra = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit(""))) > len(header) - 1
    # Always true. Spark refuses a query that needs nothing but the corrupt text, as a count would.
    lines = lines.where(F.length(F.concat_ws("", F.col(f"`{names[0]}`"))) >= 0)
    return lines, F.coalesce(extra, F.lit(False))


def read_delimited(spark, path, schema, too_long="error", sep="|", encoding="ISO-8859-1",
                   multi_line=True, null_words=NULL_WORDS):
    """A delimited dump in which a line may have the wrong number of fields.

    Columns are matched by the header's names, so the file may have more of them, in any order; a
    missing one is an error. A line with too few fields is kept, the rest NULL. One with too many
    is an error, or is left out with `too_long="skip"`. Texts that spell a missing value are NULL, as
    are numbers that cannot be read; `dump_faults` counts both.
    """
    lines, extra = _dump(spark, path, schema, sep, encoding, multi_line)
    if too_long == "skip":
        kept = lines.where(~extra)
    elif too_long == "error":
        message = F.concat(F.lit("too many fields: "), F.col(CORRUPT))
        kept = lines.where(F.when(extra, F.raise_error(message).cast("boolean")).otherwise(True))
    else:
        raise ValueError("too_long: error or skip")
    named = blank_null_words(kept.select(*schema.names), schema.names, null_words)
    return named.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def dump_faults(spark, path, schema, sep="|", encoding="ISO-8859-1", multi_line=True,
                null_words=NULL_WORDS):
    """One row: `lines`, `skipped_lines` (too many fields) and `unreadable_<column>` of the kept lines."""
    lines, extra = _dump(spark, path, schema, sep, encoding, multi_line)
    named = blank_null_words(lines.withColumn("_extra", extra), schema.names, null_words)
    typed = [f for f in schema if f.dataType.typeName() != "string"]
    bad = [F.count_if(~F.col("_extra") & F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
           .alias(f"unreadable_{f.name}") for f in typed]
    return named.agg(F.count("*").alias("lines"), F.count_if("_extra").alias("skipped_lines"), *bad)


def read_speaker_map(spark, path, **options):
    return read_delimited(spark, path, schemas.SPEAKER_MAP, "error", **options)


def read_speeches(spark, path, **options):
    return read_delimited(spark, path, schemas.SPEECHES, "skip", **options)


def read_texts(spark, folder, id_column="vidfile", text_column="ad_text", pattern="*.txt"):
    """One row per text file: its name without the last suffix, and its text.

    Bytes that are no UTF-8 are dropped and line ends made `\\n`. An empty or missing folder
    gives an empty table.
    """
    schema = (schemas.AD_TEXT.__class__().add(id_column, "string").add(text_column, "string"))
    try:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
                 .select("content", F.col("_metadata.file_name").alias("name")))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    # A replacement mark the file holds itself is set aside while the invalid bytes go.
    aside, mark = F.lit("﷐"), F.lit("�")
    raw = F.replace(F.col("content").cast("string"), mark, aside)
    valid = F.replace(F.replace(F.make_valid_utf8(raw), mark, F.lit("")), aside, mark)
    return files.select(
        F.regexp_replace("name", r"(?<=.)\.[^.]*$", "").alias(id_column),
        F.regexp_replace(valid, "\r\n?", "\n").alias(text_column))


def read_table(spark, path):
    """A hand-off between stages, or any Parquet input."""
    return spark.read.parquet(path)


def read_optional(spark, path):
    """The table at `path`, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_or_build(spark, path, build):
    """The table at `path`; if absent, `build()` is written there first."""
    found = read_optional(spark, path)
    if found is None:
        build().write.parquet(path)
        found = spark.read.parquet(path)
    return found


def read_words(spark, path):
    """(word), one per line that is not blank: a stopword table of any length."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")
