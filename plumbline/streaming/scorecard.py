"""Scores of a stream of events, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.relational import first_seen, upsert
from plumbline.sources.staging import scratch


def windowed_rates(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows, mean and sum by window and key; events later than ``late`` may be left out."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width), key)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), key, "n", "total")
    )


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a streaming aggregation over all that is there now, and returns the table of its last complete result."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    stream.writeStream.foreachBatch(keep).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(path)
    return every.join(F.broadcast(every.agg(F.max("batch").alias("batch"))), "batch", "left_semi").select(*stream.columns)


def keep_scorecard(stream: DataFrame, path: str, checkpoint: str, keys: list[str], newest: str | None = None):
    """A query that, batch by batch, replaces rows of the Parquet table at path by newer ones of the same keys.

    Of rows of one batch with the same keys, that of the largest ``newest`` is kept, if it is named.  The table has a row
    for each key, so it is small enough to write anew.
    Each batch writes a new version beside the last, so a batch that is run again changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = first_seen(batch.withColumn("_age", F.struct(F.col(newest).isNull(), F.unix_micros(F.col(newest).cast("timestamp")) * -1)), keys, ["_age"]).select(*batch.columns) if newest else batch.dropDuplicates(keys)
        if number:
            fresh = upsert(spark.read.parquet(f"{path}/version={number - 1}"), fresh, keys)
        fresh.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
