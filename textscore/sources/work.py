"""Working tables in the folder the cluster shares.

A table that is read more than once, or whose rows depend on the physical partitioning,
is written once as Parquet. That cuts the lineage and outlives a lost executor. The tables
of a run under `working` lie in a folder of their own, which is removed at its end.
"""

import contextlib
import tempfile
import uuid

SETTING = "spark.checkpoint.dir"
_runs = []


def shared_dir(spark):
    """`spark.checkpoint.dir` of the session.

    Where it is unset, one machine has a folder made for it; a cluster has no folder that all
    its machines see unless it is named, so there it is an error.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SETTING} is unset: name a folder that all executors share (or use --work)")
        folder = tempfile.mkdtemp(prefix="textscore-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_dir(spark):
    """Where working tables go: the folder of the run, or the shared one outside of any."""
    return _runs[-1] if _runs else shared_dir(spark)


def remove(spark, path):
    """Delete a folder in whatever store it lies; tells whether there was one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def working(spark):
    """A run: its working tables are deleted at the end, so results must be written before."""
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        remove(spark, folder)


def spread(df, *keys):
    """Deal rows over all cores by `keys`, if the input has too few splits to use them.

    Small inputs and files Spark cannot split come as one task; large ones pass unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def materialise(df, name, schema=None):
    """Write `df` to a fresh shared folder and read it back, its schema unchanged.

    Another `schema` of the same layout may name user types in place of the structs that hold them.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
