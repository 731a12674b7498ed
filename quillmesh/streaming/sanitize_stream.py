"""Sanitising a text stream with a threshold fed back from batch to batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.aggregation import privacy_threshold
from quillmesh.operators.privacy import RISK_THRESHOLD, sanitize
from quillmesh.session import spread

STATE = "batch_id long, threshold double"


def read_threshold(spark: SparkSession, path: str, batch_id: int) -> float:
    """Threshold left by the batch before, or the default for the first one.

    A replayed batch reads the same folder again, so it sees what it saw first.
    """
    try:
        row = spark.read.schema(STATE).parquet(f"{path}/b={batch_id - 1}").first()
    except AnalysisException:
        return RISK_THRESHOLD
    return RISK_THRESHOLD if row is None else row["threshold"]


def batch_sanitizer(
    out_path: str,
    state_path: str,
    col: str,
    query: str | None = None,
    key: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: writes one folder per batch and its threshold.

    The folder name is the batch number and is overwritten on replay, which makes
    a retried batch harmless. The figures are taken from the written rows, so the
    text is processed once. With ``key`` a batch of few splits is spread by it.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        limit = read_threshold(spark, state_path, batch_id)
        target = f"{out_path}/batch_id={batch_id}"
        rows = spread(batch, key) if key else batch
        cleaned = sanitize(rows, col, query, limit).drop(col)
        cleaned.withColumn("used_threshold", F.lit(limit)).write.mode("overwrite").parquet(target)
        figures = privacy_threshold(spark.read.parquet(target))
        state = figures.select(F.lit(batch_id).cast("long").alias("batch_id"), "threshold")
        state.coalesce(1).write.mode("overwrite").parquet(f"{state_path}/b={batch_id}")

    return run


def sanitize_stream(
    source: DataFrame,
    col: str,
    out_path: str,
    state_path: str,
    checkpoint: str,
    query: str | None = None,
    key: str | None = None,
):
    """Start the stream; returns the streaming query."""
    return (
        source.writeStream.foreachBatch(batch_sanitizer(out_path, state_path, col, query, key))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
