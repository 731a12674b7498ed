from pyspark.sql import functions as F

from quillmesh.plans import streams
from quillmesh.streaming.request_stats import request_stats
from quillmesh.streaming.sanitize_stream import sanitize_stream


def test_threshold_passes_from_batch_to_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    text = "Fine start. Call 555 123 4567 for the secret now. Tail words here."
    schema = "id long, text string"
    for i, t in enumerate([text, "nothing private", text]):
        spark.createDataFrame([(i, t)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    paths = [str(tmp_path / p) for p in ("out", "state", "ckpt")]
    sanitize_stream(stream, "text", *paths).awaitTermination()
    rows = sorted(spark.read.parquet(paths[0]).collect(), key=lambda r: r.batch_id)
    assert [r.batch_id for r in rows] == [0, 1, 2]
    assert rows[0].used_threshold == 0.45
    for before, after in zip(rows, rows[1:]):
        assert after.used_threshold == max(0.25, min(0.85, before.pii_density))


def test_request_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 3.0), ("2024-01-01 01:30:00", 5.0), ("2024-01-01 05:00:00", 7.0)]
    df = spark.createDataFrame(rows, "ts string, response_time double").withColumn("ts", F.to_timestamp("ts"))
    table = {str(r.window_start): (r.query_count, r.avg_response_time) for r in request_stats(df).collect()}
    assert table["2024-01-01 00:00:00"] == (2, 2.0) and len(table) == 3
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    run = (
        request_stats(spark.readStream.schema(df.schema).parquet(src))
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.query_count for r in closed) == [1, 2]


def test_tables_of_many_files(spark, tmp_path):
    """A table may be a single file or a folder of files, whatever their names."""
    docs = [(i, "Fine start. Call 555 123 4567 now.", "en") for i in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [("2024-01-01 00:10:00", 1.0), ("2024-01-01 05:00:00", 7.0)]
    frame = spark.createDataFrame(rows, "ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    frame.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.doc_id for r in streams.sanitize_documents(spark, str(tmp_path)).collect()) == list(range(6))
    assert [r.query_count for r in streams.request_stream(spark, str(tmp_path)).collect()] == [1]
