"""Where intermediate tables are cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES, ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, else one of our own.

    The second case is for local sessions such as tests, where all tasks run on this machine; any other session must
    name one.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return _own_folder


def tasks_for(rows: int, each: int = 50_000) -> int:
    """How many tasks suit a table of so many rows."""
    return max(6, -(-rows // each))


def written(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """The rows of ``df``, computed once and read back from a table in the shared folder.

    Python workers get ARROW_BATCH at a time meanwhile.  A lost executor costs at most a reread.  Files go when the session ends.  ``tasks``: for a table known to be
    small, how many tasks at most make it, so that what follows reads few files.
    """
    df = df.coalesce(tasks) if tasks else df
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    usual = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, ARROW_BATCH)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_BYTES, usual)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def collected(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a small table on the driver, by way of Arrow, so that no row becomes a Python object."""
    table = df.toArrow()
    return {name: table.column(name).to_numpy() for name in table.column_names}
