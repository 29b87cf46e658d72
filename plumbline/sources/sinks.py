"""Sinks: exports, upserts, leaderboards, checks of submissions and dataset cards."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.relational import upsert


def write_rows(df: DataFrame, path: str, form: str = "json", columns: list[str] | None = None, mode: str = "error") -> None:
    """JSON lines, CSV with a header, or Parquet; only these columns, if given."""
    out = df.select(*columns) if columns else df
    writer = out.write.mode(mode)
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def export_parquet(df: DataFrame, path: str, by: str) -> DataFrame:
    """Writes df, partitioned by a column, and returns the number of rows of each value."""
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(by).agg(F.count("*").alias("n"))


def merge_scorecards(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of the same model and task."""
    return upsert(old, new, ["model", "task"])


def still_to_do(wanted: DataFrame, done: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """The wanted rows whose key hasn't been done at least so often."""
    enough = done.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return wanted.join(enough, keys, "left_anti")


def leaderboard_markdown(scores: DataFrame, models: list[str], score: str = "auroc") -> DataFrame:
    """place, line: a Markdown table of tasks by models, one row per line; the head has places 0 and 1."""
    wide = scores.groupBy("task").pivot("model", models).agg(F.first(score))
    cells = [F.when(F.col(m).isNotNull(), F.format_string("%.3f", m)).otherwise("-") for m in models]
    body = wide.select(F.col("task").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", "task", *cells), F.lit(" |")).alias("line"))
    head = [("0", "| task | " + " | ".join(models) + " |"), ("1", "|" + "---|" * (len(models) + 1))]
    return scores.sparkSession.createDataFrame(head, "place string, line string").unionByName(body)


def violations(df: DataFrame, rules: Mapping[str, tuple[str, Column]], key: str = "id") -> DataFrame:
    """key, rule, severity: a row for every rule that a row breaks.  rules: name to severity and what must hold."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, (s, ok) in rules.items()])
    return df.select(key, F.explode(F.array_compact(broken)).alias("v")).select(key, "v.*")


def dataset_card(df: DataFrame, name: str, description: str) -> str:
    """A JSON card: fields with their types, the number of rows, and a digest of all rows, in any order."""
    every = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    part = F.conv(F.substring(every, 1, 15), 16, 10).cast("decimal(20,0)")
    n, total = df.agg(F.count("*"), F.sum(part)).first()
    fields = [{"name": f.name, "dataType": f.dataType.simpleString()} for f in df.schema.fields]
    return json.dumps({"@type": "Dataset", "name": name, "description": description, "rows": n, "digest": str(total or 0), "field": fields}, sort_keys=True)


def npz_files(df: DataFrame, arrays: dict[str, str], rows: int = 10_000) -> DataFrame:
    """path and content of compressed array files: each holds the columns of up to so many rows, as arrays of these types.

    The frame is what a sink writes, or a reader of contents takes; no column of it may be null.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                held = io.BytesIO()
                np.savez_compressed(held, **{c: np.array(part[c].tolist(), kind) for c, kind in arrays.items()})
                yield pd.DataFrame({"path": [f"{uuid.uuid4().hex}.npz"], "content": [held.getvalue()]})

    return df.select(*arrays).mapInPandas(pack, "path string, content binary")
