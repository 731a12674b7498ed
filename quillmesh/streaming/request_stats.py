"""Request counts and response times per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_stats(
    requests: DataFrame,
    ts: str = "ts",
    response_time: str = "response_time",
    window: str = "1 hour",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Queries and mean response time per window, for streams and tables alike.

    On a stream, rows later than ``lateness`` are dropped with their window.
    """
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp"))
    if requests.isStreaming:
        timed = timed.withWatermark(ts, lateness)
    return (
        timed.groupBy(F.window(ts, window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            F.avg(response_time).alias("avg_response_time"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "query_count",
            "avg_response_time",
        )
    )
