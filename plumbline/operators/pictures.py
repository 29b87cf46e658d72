"""Statistics of pictures, and pictures of vectors, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import pixels

STATISTICS = "status string, width int, height int, mean array<double>, deviation array<double>, quartiles array<double>, histogram array<bigint>, patches array<double>"


def pixel_statistics(df: DataFrame, content: str = "content", bins: int = 8, grid: int = 2) -> DataFrame:
    """df with what its pictures' colours are: status, width, height, mean, deviation, quartiles, histogram, patches.

    status is ``ok``, or what is wrong with the data, and then the others are null.  ``df`` may be Spark's binaryFile table,
    or any other one with the bytes of PNG files.
    """

    def one(data: bytes | None) -> dict:
        try:
            picture = pixels.decoded(bytes(data or b""))
        except ValueError as e:
            return {"status": str(e)}
        return {"status": "ok", "height": picture.shape[0], "width": picture.shape[1], **pixels.statistics(picture, bins, grid)}

    @F.pandas_udf(STATISTICS)
    def found(contents: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in STATISTICS.split(", ")]
        rows = pd.DataFrame([one(c) for c in contents], columns=names)
        return rows.astype({"width": "Int32", "height": "Int32"}).astype({n: object for n in names[3:]}).where(rows.notna(), None)

    return df.withColumn("_s", found(F.col(content))).select(*df.columns, "_s.*")


def drawn(df: DataFrame, samples: str, width: int, channels: int = 3) -> DataFrame:
    """df with content: the PNG of an array of samples from 0 to 255, by rows, then pixels; null where they fill no rows."""

    def png(values) -> bytes | None:
        if values is None or not len(values) or len(values) % (width * channels):
            return None
        return pixels.encoded(np.asarray(values, np.uint8).reshape(-1, width, channels), (0, 1, 2, 3, 4))

    @F.pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(png)

    return df.withColumn("content", made(F.col(samples)))
