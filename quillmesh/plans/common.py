"""Registry of runnable queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.session import spread

# Tables whose queries do heavy work per row, with a key to spread them by.
HEAVY = {
    "documents": "doc_id",
    "conversations": "conv_id",
    "pages": "page_id",
    "lineitem": "l_orderkey",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def query(name: str, sql: str | None = None):
    """Register ``fn(read)`` where ``read(table)`` loads a parquet table."""

    def register(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def read(table: str) -> DataFrame:
                df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
                return spread(df, HEAVY[table]) if table in HEAVY else df

            return fn(read)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        add(name, run, sql)
        return fn

    return register


def stream_query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` for queries that open a stream on a table."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        add(name, fn, sql)
        return fn

    return register
