"""Hand-offs, exports and models."""

from pyspark.sql import functions as F

from textscore.plans.search import Model
from textscore.sources.work import remove


def write_table(df, path):
    df.write.mode("overwrite").parquet(path)


def write_if_rows(df, path):
    """Write only a table that has rows; tells whether it did. Without rows no table stays at `path`."""
    write_table(df, path)
    if df.sparkSession.read.schema(df.schema).parquet(path).isEmpty():
        remove(df.sparkSession, path)
        return False
    return True


def export_csv(df, path):
    """CSV with a header; arrays become one space-joined text."""
    columns = [F.array_join(f.name, " ").alias(f.name) if f.dataType.typeName() == "array"
               else F.col(f"`{f.name}`") for f in df.schema]
    (df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def save_model(model, path):
    """Terms with idf and weight as one table, the parameters as another."""
    write_table(model.terms, f"{path}/terms")
    write_table(model.params, f"{path}/params")


def load_model(spark, path):
    return Model(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/params"))
