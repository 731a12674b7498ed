"""Session helpers: local builder for tests and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. A cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillmesh")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking ``spark.checkpoint.dir`` from the session.

    Only a ``local`` master gets a temporary folder; on a cluster a missing
    setting is an error, since a machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="quillmesh-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the checkpoint folder.

    For long loops: a checkpoint keeps the constraints of its plan, which join with those
    of the rounds before until planning takes longer than the work.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/quillmesh-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of numbers that a task sorts or counts.
TASK_ROWS = 1 << 19


@contextmanager
def tasks_by_rows(spark: SparkSession, rows: int) -> Iterator[int]:
    """Within, shuffles have a partition per ``TASK_ROWS`` rows, or the session's number if
    that is more.

    AQE sizes tasks by compressed bytes, and rows of numbers take some sixty times those
    when they are sorted. For jobs that run within, not for plans that are returned.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    wanted = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield parts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Scans of more splits than this are never dealt anew.
SPREAD_SPLITS = 4


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of a few splits one partition per core.

    Row-wise text work on one unsplittable file would keep a single core busy. Only
    scans of at most ``SPREAD_SPLITS`` splits, half a gigabyte by default, are dealt
    anew; larger tables pass through whatever the number of cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits > SPREAD_SPLITS or splits >= cores:
        return df
    return df.repartition(cores, key)
