"""Streaming queries: each opens a file stream on a table and reads its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmesh.plans.common import query, stream_query
from quillmesh.plans.privacy import sanitized_columns, sql_sanitized
from quillmesh.session import ensure_checkpoint_dir
from quillmesh.streaming.request_stats import request_stats
from quillmesh.streaming.sanitize_stream import sanitize_stream

_SQL_HOURS = """hr AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS query_count, round(avg(value), 6) AS avg_response_time FROM events GROUP BY ALL)"""
_STAMP = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _shown(df):
    stamp = "yyyy-MM-dd HH:mm:ss"
    return df.select(
        F.date_format("window_start", stamp).alias("window_start"),
        F.date_format("window_end", stamp).alias("window_end"),
        "query_count",
        F.round("avg_response_time", 6).alias("avg_response_time"),
    )


def _sql_hours(where: str = "") -> str:
    return f"""WITH {_SQL_HOURS} SELECT {_STAMP.format(c='s')} AS window_start, {_STAMP.format(c='s + INTERVAL 1 HOUR')} AS window_end, query_count, avg_response_time FROM hr {where}"""


@query("stream_request_stats_table", _sql_hours())
def request_table(read):
    """The same aggregation over the finished table."""
    return _shown(request_stats(read("events"), response_time="value"))


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _source(spark, sf_dir, table):
    """File stream over one table: a folder of files, or a single file of ``sf_dir``.

    A stream takes folders only, so a single file is picked by name from its folder.
    """
    name = f"{table}.parquet"
    rows = spark.read.parquet(f"{sf_dir}/{name}")
    stream = spark.readStream.schema(rows.schema)
    files = rows.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}"):
        return stream.option("pathGlobFilter", name).parquet(sf_dir)
    return stream.parquet(f"{sf_dir}/{name}")


@stream_query(
    "stream_request_stats",
    _sql_hours("WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"),
)
def request_stream(spark, sf_dir):
    """Windows closed by the watermark; the last ones stay open."""
    folder = _folder(spark)
    stats = request_stats(_source(spark, sf_dir, "events"), response_time="value")
    run = (
        stats.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return _shown(spark.read.parquet(f"{folder}/out"))


@stream_query(
    "stream_sanitize", f"WITH {sql_sanitized('documents', 'doc_id')} SELECT * FROM sanitized"
)
def sanitize_documents(spark, sf_dir):
    """All files are one batch, which runs at the default threshold."""
    folder = _folder(spark)
    docs = _source(spark, sf_dir, "documents").select("doc_id", "text")
    paths = [f"{folder}/{name}" for name in ("out", "thresholds", "state")]
    sanitize_stream(docs, "text", *paths, key="doc_id").awaitTermination()
    return sanitized_columns(spark.read.parquet(f"{folder}/out"), "doc_id")
