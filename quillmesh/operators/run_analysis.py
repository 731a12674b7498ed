"""Filtering, grouping and tabulating experiment runs.

Runs are long tables: ``run(run_id, option map<string,string>)`` and
``metric(run_id, round, value)`` with dense integer rounds from 0.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.running import WIDTH, overlapped, running
from quillmesh.session import cut_lineage

_COMPARE = re.compile(r"^\s*(<=|>=|==|=|<|>)?\s*(.*?)\s*$")


def option_condition(value: Column, condition) -> Column:
    """Condition on one option: a list, ``"<0.1"`` style text, or a number."""
    if isinstance(condition, (list, tuple, set)):
        texts = [c for c in condition if isinstance(c, str)]
        numbers = [float(c) for c in condition if not isinstance(c, str)]
        test = F.lit(False)
        if texts:
            test = test | value.isin(texts)
        if numbers:
            test = test | F.coalesce(value.try_cast("double").isin(numbers), F.lit(False))
        return test
    if not isinstance(condition, str):
        return value.try_cast("double") == float(condition)
    op, operand = _COMPARE.match(condition).groups()
    try:
        left, right = value.try_cast("double"), F.lit(float(operand))
    except ValueError:
        left, right = value, F.lit(operand)
    return {
        "<": left < right,
        "<=": left <= right,
        ">": left > right,
        ">=": left >= right,
    }.get(op, left == right)


def filter_runs(runs: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Runs whose options meet all conditions; an absent option fails."""
    out = runs
    for key, cond in conditions.items():
        value = F.element_at("option", F.lit(key))
        out = out.filter(value.isNotNull() & option_condition(value, cond))
    return out


def round_axis(runs: DataFrame) -> DataFrame:
    """``run_id, pos, round``: 0 and every multiple of ``eval_interval``."""
    n = F.element_at("option", F.lit("num_rounds")).cast("int")
    every = F.element_at("option", F.lit("eval_interval")).cast("int")
    later = F.when(
        (every > 0) & (n >= every), F.sequence(every, n, every)
    ).otherwise(F.array().cast("array<int>"))
    axis = F.concat(F.array(F.lit(0)), later)
    return runs.select("run_id", F.posexplode(axis).alias("pos", "round"))


def run_stats(metric: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Min, max, population variance and deviation, mean and final value."""
    return metric.groupBy(*keys).agg(
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.var_pop("value").alias("variance"),
        F.stddev_pop("value").alias("std_value"),
        F.avg("value").alias("mean_value"),
        F.max_by("value", "round").alias("final_value"),
    )


def _best_first(y: str, flag: str) -> Column:
    """Sort key whose minimum is the best value, the first round on ties."""
    if flag not in ("min", "max"):
        raise ValueError("flag must be min or max")
    value = F.col(y) if flag == "min" else -F.col(y)
    return F.struct(value, F.col("round"))


def optimal_x_by_y(
    metric: DataFrame,
    x: str,
    y: str,
    flag: str = "min",
    keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Value of ``x`` in the round where ``y`` is best, the first on ties."""
    key = _best_first(y, flag)
    return metric.groupBy(*keys).agg(
        F.min_by(x, key).alias("x"), F.min_by("round", key).alias("round")
    )


def group_key(ignore: Sequence[str] = ("seed", "gpu")) -> Column:
    """Text that is equal for runs that differ in the ignored options only."""
    kept = F.map_filter("option", lambda k, v: ~k.isin(list(ignore)))
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(kept)),
            lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))),
        ),
        ",",
    )


def group_runs(
    metric: DataFrame, runs: DataFrame, ignore: Sequence[str] = ("seed", "gpu")
) -> DataFrame:
    """Mean curve with its band per group of runs."""
    keyed = runs.select("run_id", group_key(ignore).alias("group_key"))
    return (
        metric.join(keyed, "run_id")
        .groupBy("group_key", "round")
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.avg("value").alias("mean"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
    )


def group_optimal(
    metric: DataFrame,
    runs: DataFrame,
    flag: str = "min",
    x: str = "value",
    y: str = "value",
    ignore: Sequence[str] = ("seed", "gpu"),
) -> DataFrame:
    """Best value per run, then its mean and spread per group, also as text.

    With ``x`` other than ``y`` it is the value of ``x`` in the best round of ``y``.
    """
    best = optimal_x_by_y(metric, x, y, flag)
    keyed = runs.select("run_id", group_key(ignore).alias("group_key"))
    stats = (
        best.join(keyed, "run_id")
        .groupBy("group_key")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    )
    return stats.withColumn(
        "text", F.format_string("%.4f ± %.4f", F.col("mean"), F.col("std"))
    )


def run_table(
    metric: DataFrame,
    plan: Sequence[Mapping[str, str]],
    sort: str | None = None,
    keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """One row per run and one column per planned statistic, in one aggregation.

    A plan entry has ``stat`` (min, max, var, std, mean, final, optimal), ``x``,
    and for ``optimal`` also ``y`` and ``flag``; ``name`` sets the column name.
    """
    makers = {
        "min": F.min,
        "max": F.max,
        "var": F.var_pop,
        "std": F.stddev_pop,
        "mean": F.avg,
        "final": lambda c: F.max_by(c, "round"),
    }
    cols = []
    for entry in plan:
        stat, x = entry["stat"], entry["x"]
        name = entry.get("name", f"{stat}-{x}")
        if stat == "optimal":
            best = _best_first(entry["y"], entry.get("flag", "min"))
            cols.append(F.min_by(x, best).alias(name))
        else:
            cols.append(makers[stat](x).alias(name))
    out = metric.groupBy(*keys).agg(*cols)
    return out.orderBy(sort, *keys) if sort else out


def early_stop(
    metric: DataFrame, patience: int, direction: int = -1, width: int = WIDTH
) -> DataFrame:
    """``run_id, stop_round`` for runs that stop before their end.

    A run stops at a NaN, or once ``patience`` rounds in a row brought nothing
    better than the best so far.
    """
    score = F.when(~F.isnan("value"), F.lit(direction) * F.col("value"))
    before = running(
        metric, ["run_id"], "round", {"_best": ("max", score)}, False, width
    )
    better = F.col("_best").isNull() | (score > F.col("_best"))
    marked = before.withColumn("_up", F.when(score.isNotNull() & better, F.col("round")))
    # The second pass reads its input twice.
    marked = cut_lineage(marked.select("run_id", "round", "value", "_up"))
    last = running(marked, ["run_id"], "round", {"_last": ("max", F.col("_up"))}, True, width)
    stop = F.isnan("value") | (F.col("round") - F.col("_last") >= patience)
    return last.filter(stop).groupBy("run_id").agg(F.min("round").alias("stop_round"))


def best_config(
    metric: DataFrame, runs: DataFrame, flag: str = "min", order: str = "run_id"
) -> DataFrame:
    """The run with the best value, its options, the value and its round."""
    best = optimal_x_by_y(metric, "value", "value", flag)
    by = F.asc("x") if flag == "min" else F.desc("x")
    return (
        best.orderBy(by, F.asc(order))
        .limit(1)
        .join(runs, "run_id")
        .select("run_id", "option", F.col("x").alias("value"), "round")
    )


def smooth(
    metric: DataFrame,
    n: int = 20,
    keys: Sequence[str] = ("run_id",),
    width: int = WIDTH,
) -> DataFrame:
    """Median (lower), mean and maximum of the last ``n`` values, global mean so far."""
    total = running(
        metric,
        keys,
        "round",
        {"_sum": ("sum", F.col("value")), "_cnt": ("count", F.col("value"))},
        True,
        width,
    )
    blocks = overlapped(total, "round", n - 1, width)
    frame = Window.partitionBy(*keys, "_blk").orderBy("round").rowsBetween(1 - n, 0)
    sorted_last = F.sort_array(F.collect_list("value").over(frame))
    out = (
        blocks.withColumn("_s", sorted_last)
        .withColumn("mean", F.avg("value").over(frame))
        .filter("_own")
    )
    return out.select(
        *keys,
        "round",
        "value",
        F.get("_s", F.floor((F.size("_s") - 1) / 2).cast("int")).alias("median"),
        "mean",
        F.get("_s", F.size("_s") - 1).alias("max"),
        (F.col("_sum") / F.col("_cnt")).alias("global_mean"),
    )


def last_dist(metric: DataFrame) -> DataFrame:
    """Last value of the per-client metrics, named ``*_dist``; others stay whole."""
    dist = F.contains(F.col("name"), F.lit("_dist"))
    last = (
        metric.filter(dist)
        .groupBy("run_id", "name")
        .agg(F.max("round").alias("round"), F.max_by("value", "round").alias("value"))
    )
    return metric.filter(~dist).select("run_id", "name", "round", "value").unionByName(last)
