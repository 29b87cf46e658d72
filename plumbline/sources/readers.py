"""Sources of items, predictions and results.  All take any path that Spark reads."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "id string, modality string, property string, condition string, representation string, label string, source string"


def label(value: Column) -> Column:
    """1 or 0 from "1", "1.0" and the like; null from anything else."""
    return value.try_cast("double").try_cast("int")


def jsonl_items(spark: SparkSession, path: str, condition: str | None = None, schema: str = ITEM) -> DataFrame:
    """Items of JSON lines; a missing condition is ``matched``.  Blank lines are skipped."""
    rows = spark.read.schema(schema).json(path).withColumn("condition", F.coalesce("condition", F.lit("matched"))).withColumn("label", label(F.col("label")))
    return rows.where(F.col("condition") == condition) if condition else rows


def csv_rows(spark: SparkSession, path: str, schema: str | None = None, line_feeds: bool = False) -> DataFrame:
    """A CSV with a header; all columns are strings unless a schema is given.  Empty fields are null.

    line_feeds: fields may hold line feeds; a file is then read by one task.
    """
    reader = spark.read.option("header", True).option("emptyValue", None).option("escape", '"').option("multiLine", line_feeds)
    return (reader.schema(schema) if schema else reader).csv(path)


def tsv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """These columns of tab-separated files, gzipped or not, each with a header that starts with #; short rows give nulls.

    A gzipped file can't be split, so its rows are dealt out again after reading.
    """
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    # one row a file
    header = lines.where(F.startswith("value", F.lit("#"))).groupBy("file").agg(F.split(F.regexp_replace(F.first("value"), "^#", ""), "\t").alias("h"))
    rows = lines.where(~F.startswith("value", F.lit("#"))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    split = rows.select("file", F.split("value", "\t").alias("f")).join(header, "file")
    return split.select(*[F.nullif(F.get("f", F.array_position("h", c).cast("int") - 1), F.lit("")).alias(c) for c in columns])


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header and sequence of each record; records may span any number of lines."""
    # a record begins with > at the beginning of a line; only a file's first one keeps it
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", r"^\s*>", "")).where(F.trim("value") != "")
    parts = F.split("value", "\n", 2)
    return records.select(F.trim(F.get(parts, 0)).alias("header"), F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"\s", "").alias("sequence"))


def fasta_proteins(spark: SparkSession, path: str) -> DataFrame:
    """acc, gene and sequence, from headers like ``db|acc|name ... GN=gene``."""
    h = F.col("header")
    return fasta(spark, path).select(F.coalesce(F.get(F.split(h, r"\|"), 1), h).alias("acc"), F.nullif(F.regexp_extract(h, r"GN=(\S+)", 1), F.lit("")).alias("gene"), "sequence")


def fasta_targets(spark: SparkSession, path: str) -> DataFrame:
    """id, target and sequence, from headers with TARGET=number."""
    h = F.col("header")
    return fasta(spark, path).select(F.get(F.split(h, r"\s+"), 0).alias("id"), F.regexp_extract(h, r"TARGET=(-?\d+\.?\d*)", 1).try_cast("double").alias("target"), "sequence")


def sequence_column(df: DataFrame, names: list[str], name: str = "sequence") -> DataFrame:
    """df with the first of these columns that it has and that isn't null."""
    return df.withColumn(name, F.coalesce(*[F.col(n) for n in names if n in df.columns]))


def json_results(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """One row per JSON file, with the name of its folder as ``model``; dry runs are left out."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(pattern).withColumn("model", F.get(F.reverse(F.split(F.input_file_name(), "/")), 1))
    return rows.where(~F.contains("model", F.lit("dry")))


def layer_profiles(spark: SparkSession, path: str) -> DataFrame:
    """series, layer and value, from ``### series`` headings followed by lines of two numbers.

    A heading holds until the next one of its file.  Files are small reports, one window partition each.
    """
    lines = spark.read.text(path).withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()})
    w = Window.partitionBy("file").orderBy("at")
    named = lines.withColumn("series", F.last(F.nullif(F.regexp_extract("value", r"^###\s+(.+?)\s*$", 1), F.lit("")), ignorenulls=True).over(w))
    pattern = r"^\s*(\d+)\s+(-?\d+\.?\d*)\s*$"
    return named.where(F.col("value").rlike(pattern)).select("series", F.regexp_extract("value", pattern, 1).cast("int").alias("layer"), F.regexp_extract("value", pattern, 2).cast("double").alias("value"))


def images(spark: SparkSession, pattern: str) -> DataFrame:
    """path and base64 content."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.base64("content").alias("content"))


def jdbc_rows(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a database whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def npz_rows(spark: SparkSession, pattern: str, columns: str) -> DataFrame:
    """path, i, and the i-th row of each named array of compressed array files; see ``npz_contents``."""
    return npz_contents(spark.read.format("binaryFile").load(pattern), columns)


def npz_contents(files: DataFrame, columns: str) -> DataFrame:
    """path, i, and the i-th row of each named array, numbers or lists of them, of files given as path and content.

    columns: a schema of the arrays wanted, such as ``X array<float>, y int``; their first dimensions are equal.  A file is
    read whole by one task.
    """
    names = [f.split()[0] for f in columns.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    arrays = {n: list(held[n]) for n in names}
                yield pd.DataFrame({"path": path, "i": range(len(arrays[names[0]])), **arrays})

    return files.select("path", "content").mapInPandas(rows, f"path string, i long, {columns}")
