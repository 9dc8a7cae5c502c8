"""Applying stored steps to a stream of cases, and counting outcomes in time windows.

Step parameters are ordinary tables, so `Sequence.apply` works on a stream as it does on a table (a
join of the stream with a static side). Windowed counts take late rows up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(df: DataFrame, ts: str, hit: str, value: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, n, n_hit and the mean value of each window; with `late`, a watermark (for streams)."""
    own = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    own = own.withWatermark("_ts", late) if late else own
    g = own.groupBy(F.window("_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(hit)).alias("n_hit"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("start"), "n", "n_hit", "mean")


def sessions(df: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """key, start, n of runs of rows with no gap longer than `gap`."""
    own = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    own = own.withWatermark("_ts", late) if late else own
    g = own.groupBy(key, F.session_window("_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), "n")
