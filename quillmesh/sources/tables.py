"""Delimited tables, series files, client assignments and run records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_LIST = 1 << 16
RUN = "option map<string,string>, metrics map<string,array<double>>"


def read_table(
    spark: SparkSession, path: str, sep: str, schema: str, header: bool = False
) -> DataFrame:
    """Delimited text of any separator, also of several characters or gzipped."""
    return spark.read.csv(
        path,
        sep=sep,
        schema=schema,
        header=header,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )


def parse_delimited(df: DataFrame, col: str, sep: str, schema: str) -> DataFrame:
    """Columns of a delimited text column."""
    fields = T.StructType.fromDDL(schema).fields
    parts = F.split(F.col(col), f"\\Q{sep}\\E", -1)
    return df.select(parts.alias("_p")).select(
        *[
            F.trim(F.get("_p", F.lit(i))).cast(f.dataType).alias(f.name)
            for i, f in enumerate(fields)
        ]
    )


def parse_ucr(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """Series rows: the first number less one is the label, the rest the values."""
    numbers = F.split(F.trim(F.col(col)), r"\s+").cast("array<double>")
    return df.select(*keep, numbers.alias("_n")).select(
        *keep,
        (F.get("_n", F.lit(0)).cast("long") - 1).alias("label"),
        F.slice("_n", F.lit(2), F.size("_n") - 1).alias("values"),
    )


def read_ucr(spark: SparkSession, path: str) -> DataFrame:
    return parse_ucr(spark.read.text(path), "value")


def assignment_lists(assign: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``client_id, part, data``: sorted row lists of bounded length.

    A client may hold a third of all rows, so its list is cut by id ranges.
    """
    part = F.floor(F.col(row_id) / ROWS_PER_LIST)
    return (
        assign.groupBy("client_id", part.alias("part"))
        .agg(F.sort_array(F.collect_list(row_id)).alias("data"))
    )


def write_assignment(
    assign: DataFrame, path: str, row_id: str = "row_id", fmt: str = "parquet"
) -> None:
    """Parquet partitioned by client, or JSON lines of row lists."""
    if fmt == "parquet":
        assign.write.mode("overwrite").partitionBy("client_id").parquet(path)
    elif fmt == "json":
        assignment_lists(assign, row_id).write.mode("overwrite").json(path)
    else:
        raise ValueError("fmt must be parquet or json")


def read_assignment(
    spark: SparkSession,
    path: str,
    row_id: str = "row_id",
    fmt: str = "parquet",
    clients: Sequence[int] | None = None,
) -> DataFrame:
    """``row_id, client_id``; asking for some clients prunes partitions."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        lists = spark.read.schema("client_id long, part long, data array<long>").json(path)
        df = explode_assignment(lists, row_id)
    if clients is not None:
        df = df.filter(F.col("client_id").isin(list(clients)))
    return df


def explode_assignment(lists: DataFrame, row_id: str = "row_id") -> DataFrame:
    return lists.select(F.explode("data").alias(row_id), "client_id")


def parse_runs(df: DataFrame, col: str, name: str, headers: Sequence[str] = ()) -> DataFrame:
    """``run_id, option, metrics`` from JSON text, kept by name prefix."""
    out = df
    if headers:
        keep = F.lit(False)
        for h in headers:
            keep = keep | F.startswith(F.col(name), F.lit(h))
        out = df.filter(keep)
    return out.select(F.col(name).alias("run_id"), F.from_json(col, RUN).alias("_r")).select(
        "run_id", "_r.option", "_r.metrics"
    )


def read_runs(spark: SparkSession, path: str, headers: Sequence[str] = ()) -> DataFrame:
    """Run records, one JSON file per run, named by file."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), "value"
    )
    return parse_runs(raw, "value", "file", headers)


def run_metrics(runs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Long form ``run_id, name, round, value`` of run records."""
    rows = runs.select("run_id", F.explode("metrics").alias("name", "_v"))
    if names is not None:
        rows = rows.filter(F.col("name").isin(list(names)))
    return rows.select("run_id", "name", F.posexplode("_v").alias("round", "value"))


def option(key: str) -> Column:
    return F.element_at("option", F.lit(key))
