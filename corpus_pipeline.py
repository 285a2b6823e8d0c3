"""The corpus pipeline: documents in, a budgeted mix of clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet under
`spark.checkpoint.dir` and read again as the next stage's documents.
"""

from pyspark.sql import functions as F

from textscore.llm import decontaminate, jaccard_tree, line_dedup, mixing, toxicity
from textscore.llm.text import read
from textscore.sources.work import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model does not reject."""
    judged = toxicity.verdicts(docs, read(spark, sf_dir, "labels"))
    return judged.filter(~F.col("rejected")).select(*COLUMNS)


def drop_repeated_lines(spark, docs, sf_dir):
    """All documents, without the lines that earlier ones hold; `n_chars` follows the text."""
    cleaned = line_dedup.remove_repeated_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark, docs, sf_dir):
    """The document with the smallest id of each group of near copies.

    An id is one document: rows of one id go or stay together, whatever their texts, and a group that one of
    them is in holds them all. Rows with a null id and texts without words stay.
    """
    found = jaccard_tree.near_duplicates(docs).filter(F.col("doc_id") != F.col("component_id"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without benchmark passages."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark, docs, sf_dir):
    """The order in which the kept documents are read: (doc_id, source, epoch, block, n_tokens, start)."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines),
          ("jaccard_join", drop_near_copies), ("decontamination", drop_contaminated),
          ("mixing", mix_sources)]

# A fitted model decides in the first stage, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
