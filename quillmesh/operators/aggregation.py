"""Combining per-client parameters, metrics and privacy figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.privacy import THRESHOLD_BOUNDS

CELL = ["layer", "idx"]


def client_shares(volumes: DataFrame) -> DataFrame:
    """``client_id, p, n_clients``: share of each client in all data."""
    total = volumes.agg(F.sum("n")).scalar()
    count = volumes.agg(F.count(F.lit(1))).scalar()
    return volumes.select(
        "client_id", (F.col("n") / total).alias("p"), count.alias("n_clients")
    )


def aggregate_params(
    params: DataFrame,
    mode: str = "uniform",
    volumes: DataFrame | None = None,
    old: DataFrame | None = None,
) -> DataFrame:
    """Merge ``params(client_id, layer, idx, value)`` into one model.

    ``uniform``: plain mean. ``weighted_scale``: N/K * sum(p * w).
    ``weighted_com``: (1 - sum p) * old + sum(p * w). ``weighted``: shares are
    scaled to one. ``volumes(client_id, n)`` lists all clients, also those that
    sent nothing; partial sums are taken before the shuffle.
    """
    if mode == "uniform":
        return params.groupBy(*CELL).agg(F.avg("value").alias("value"))
    if volumes is None:
        raise ValueError(f"mode {mode} needs volumes")
    joined = params.join(client_shares(volumes), "client_id")
    sums = joined.groupBy(*CELL).agg(
        F.sum(F.col("p") * F.col("value")).alias("_pv"),
        F.sum("p").alias("_p"),
        F.count(F.lit(1)).alias("_k"),
        F.max("n_clients").alias("_n"),
    )
    if mode == "weighted_scale":
        return sums.select(*CELL, (F.col("_pv") * F.col("_n") / F.col("_k")).alias("value"))
    if mode == "weighted":
        return sums.select(*CELL, (F.col("_pv") / F.col("_p")).alias("value"))
    if mode != "weighted_com":
        raise ValueError(f"unknown mode {mode}")
    if old is None:
        raise ValueError("weighted_com needs the old parameters")
    base = old.select(*CELL, F.col("value").alias("_old"))
    return sums.join(base, CELL).select(
        *CELL, ((1 - F.col("_p")) * F.col("_old") + F.col("_pv")).alias("value")
    )


def drop_nan_clients(params: DataFrame, check: bool = True) -> DataFrame:
    """Leave out every client that sent a NaN; an error if all of them did."""
    flags = params.groupBy("client_id").agg(F.bool_or(F.isnan("value")).alias("bad"))
    if check:
        # Raised when the result is computed, so that planning reads nothing.
        all_bad = flags.agg(F.bool_and("bad")).scalar()
        stop = F.raise_error(F.lit("every client holds a NaN parameter")).cast("boolean")
        flags = flags.withColumn("bad", F.when(all_bad, stop).otherwise(F.col("bad")))
    return params.join(flags.filter("bad"), "client_id", "left_anti")


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / b,
}


def param_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Element-wise add, sub, mul or div of two models."""
    other = b.select(*CELL, F.col("value").alias("_b"))
    return a.join(other, CELL).select(
        *CELL, _OPS[op](F.col("value"), F.col("_b")).alias("value")
    )


def param_map(a: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Element-wise function of one model, for example a scale."""
    return a.withColumn("value", fn(F.col("value")))


def param_sum(params: DataFrame) -> DataFrame:
    """Sum over all clients."""
    return params.groupBy(*CELL).agg(F.sum("value").alias("value"))


def param_norm(a: DataFrame, p: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    return a.groupBy(*by).agg(
        F.pow(F.sum(F.pow(F.abs("value"), F.lit(p))), F.lit(1.0 / p)).alias("norm")
    )


def param_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return param_op(a, b, "mul").agg(F.sum("value").alias("dot"))


def param_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select(*CELL, F.col("value").alias("_b"))
    va, vb = F.col("value"), F.col("_b")
    return a.join(other, CELL).agg(
        (F.sum(va * vb) / (F.sqrt(F.sum(va * va)) * F.sqrt(F.sum(vb * vb)))).alias("cosine")
    )


def param_count(a: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return a.groupBy(*by).agg(F.count("value").alias("n_params"))


def proximal(params: DataFrame, origin: DataFrame, mu: float) -> DataFrame:
    """``0.5 * mu * sum((w - w0)^2)`` per client."""
    base = origin.select(*CELL, F.col("value").alias("_o"))
    gap = F.col("value") - F.col("_o")
    return (
        params.join(base, CELL)
        .groupBy("client_id")
        .agg((F.lit(0.5 * mu) * F.sum(gap * gap)).alias("distance"))
    )


def privacy_threshold(
    df: DataFrame,
    low: float = THRESHOLD_BOUNDS[0],
    high: float = THRESHOLD_BOUNDS[1],
    weight: str = "anonymized_characters",
) -> DataFrame:
    """Weighted privacy figures and the next threshold, one row.

    Only the density drives the threshold; a zero weight sum gives zeros.
    """
    w = F.sum(weight)

    def mean(c: str) -> Column:
        value = F.sum(F.col(c) * F.col(weight)) / w
        return F.when(w > 0, value).otherwise(F.lit(0.0)).alias(c)

    means = df.agg(mean("pii_density"), mean("removal_ratio"), mean("average_risk"))
    return means.withColumn(
        "threshold", F.greatest(F.lit(low), F.least(F.lit(high), F.col("pii_density")))
    )


def rollup_metrics(df: DataFrame) -> DataFrame:
    """Per round and metric: volume-weighted mean, plain mean, spread, client list.

    ``df(round, metric, client_id, value, n)``.
    """
    return df.groupBy("round", "metric").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("weighted_mean"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("client_id", "value"))),
            lambda s: s["value"],
        ).alias("values"),
    )


def valid_mean(
    df: DataFrame, score: str, valid: str, keys: Sequence[str] = ("metric",)
) -> DataFrame:
    """Mean over the rows that were counted, with that count."""
    return df.groupBy(*keys).agg(
        F.avg(F.when(F.col(valid), F.col(score))).alias("mean"),
        F.count_if(F.col(valid)).alias("n_valid"),
    )


def category_averages(
    df: DataFrame, category: str, metrics: Sequence[str]
) -> DataFrame:
    """Mean of every metric per category and over all rows (category null).

    All means come from one pass over the data and are unpivoted afterwards.
    """
    per = df.groupBy(category).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(m).alias(f"_s_{m}") for m in metrics],
        *[F.count(m).alias(f"_c_{m}") for m in metrics],
    )
    total = per.agg(
        F.sum("_n").alias("_n"),
        *[F.sum(f"_s_{m}").alias(f"_s_{m}") for m in metrics],
        *[F.sum(f"_c_{m}").alias(f"_c_{m}") for m in metrics],
    ).withColumn(category, F.lit(None).cast(dict(df.dtypes)[category]))
    both = per.unionByName(total)
    means = both.select(
        category,
        F.col("_n").alias("n"),
        *[(F.col(f"_s_{m}") / F.col(f"_c_{m}")).alias(m) for m in metrics],
    )
    return means.unpivot([category, "n"], list(metrics), "metric", "mean")


def chat_stats(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Message counts, privacy totals and mean response time over non-zero values.

    ``df(role, privacy_applied, pii_detected, sentences_removed, response_time)``.
    """
    reply = F.col("role") == "assistant"

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(reply, F.col(c))), F.lit(0)).cast("long")

    timed = reply & (F.col("response_time") != 0)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(reply).alias("assistant_messages"),
        total("pii_detected").alias("total_pii_detected"),
        total("sentences_removed").alias("total_sentences_removed"),
        F.coalesce(F.avg(F.when(timed, F.col("response_time"))), F.lit(0.0)).alias(
            "avg_response_time"
        ),
        F.count_if(reply & F.col("privacy_applied")).alias("privacy_applied_count"),
    )


def merge_privacy(question: DataFrame, answer: DataFrame, key: str) -> DataFrame:
    """Entities of question and answer in one list, and the mean of the densities."""
    a = answer.select(
        key, F.col("pii").alias("_pii"), F.col("pii_density").alias("_density")
    )
    return question.join(a, key).select(
        key,
        F.concat("pii", "_pii").alias("pii"),
        ((F.col("pii_density") + F.col("_density")) / 2).alias("pii_density"),
    )
