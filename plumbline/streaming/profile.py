"""A running profile of a stream: per column, counts and power sums by event-time window.

The state of a window is one row per column, whatever the rate; late data within
the watermark is merged, later data is dropped by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import col, kinds, without_nan


def windowed_stats(stream: DataFrame, time_col: str, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """(window, column_name, n_rows, missing_count, mean, std, min, max) of the numeric columns."""
    stream = without_nan(stream.withWatermark(time_col, watermark))
    names = [c for c, k in kinds(stream).items() if k == "numeric"]
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("double").alias("v")) for c in names]))
    grouped = stream.select(col(time_col).alias("at"), cells).groupBy(F.window("at", window), "column_name")
    return grouped.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").isNull()).alias("missing_count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
