"""Feature preparation for tables, ratings, series and token streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.positions import hash_positions, prefix_weights, same_key_join
from quillmesh.functions.running import overlapped
from quillmesh.functions.text import ws_tokens


def minmax(df: DataFrame, cols: Sequence[str], as_int: bool = False) -> DataFrame:
    """Scale to [0, 1] by the global range; ``as_int`` truncates values first."""

    def value(c: str) -> Column:
        return F.col(c).cast("long") if as_int else F.col(c)

    stats = df.agg(
        F.struct(
            *[F.min(value(c)).alias(f"lo_{c}") for c in cols],
            *[F.max(value(c)).alias(f"hi_{c}") for c in cols],
        )
    ).scalar()
    out = df.withColumn("_stats", stats)
    for c in cols:
        lo, hi = F.col(f"_stats.lo_{c}"), F.col(f"_stats.hi_{c}")
        out = out.withColumn(c, F.when(hi > lo, (value(c) - lo) / (hi - lo)))
    return out.drop("_stats")


def binarize(df: DataFrame, col: str, true_value, out: str = "label") -> DataFrame:
    return df.withColumn(out, F.when(F.col(col) == true_value, 1).otherwise(0))


def one_hot(df: DataFrame, cols: Sequence[str], *others: DataFrame) -> DataFrame:
    """0/1 arrays over the sorted values of each column.

    Values of ``others`` join the dictionary, as for a train and a test table. The
    dictionary is as long as the array put on every row.
    """
    out = df
    for c in cols:
        values = df.select(c)
        for o in others:
            values = values.unionByName(o.select(c))
        known = values.agg(F.sort_array(F.collect_set(c))).scalar()
        out = (
            out.withColumn("_known", known)
            .withColumn(
                f"{c}_onehot",
                F.zip_with(
                    "_known",
                    F.array_repeat(F.col(c), F.size("_known")),
                    lambda v, x: F.when(v == x, 1).otherwise(0),
                ),
            )
            .drop("_known")
        )
    return out


def recode(df: DataFrame, rules: Sequence[tuple[str, Column, object]]) -> DataFrame:
    """Set a column to a value where a condition holds: ``(col, condition, value)``."""
    out = df
    for col, cond, value in rules:
        out = out.withColumn(col, F.when(cond, F.lit(value)).otherwise(F.col(col)))
    return out


def reindex(
    df: DataFrame, col: str, mapping: DataFrame | None = None, out: str | None = None
) -> DataFrame:
    """Replace ids by 0..n-1, or by a given ``(col, index)`` mapping."""
    if mapping is None:
        ids = df.select(col).distinct()
        mapping = hash_positions(ids, col, pos="index", total=None)
    joined = same_key_join(df, mapping.select(col, "index"), col)
    if out:
        return joined.withColumnRenamed("index", out)
    return joined.drop(col).withColumnRenamed("index", col).select(*df.columns)


def normalize_series(
    df: DataFrame, mode: int, value: str = "value", sensor: str = "sensor"
) -> DataFrame:
    """0: as is, 1: by the global maximum, 2: by the largest magnitude per sensor."""
    if mode == 0:
        return df
    if mode == 1:
        top = df.agg(F.max(value)).scalar()
        return df.withColumn(value, F.col(value) / top)
    if mode == 2:
        tops = df.groupBy(sensor).agg(F.max(F.abs(value)).alias("_top"))
        return df.join(tops, sensor).withColumn(value, F.col(value) / F.col("_top")).drop("_top")
    raise ValueError("mode must be 0, 1 or 2")


def series_windows(
    df: DataFrame,
    window: int = 24,
    horizon: int = 12,
    train: float = 0.8,
    width: int = 8192,
) -> DataFrame:
    """``sensor, t, x, y, part`` from a dense series ``(t, sensor, value)``.

    ``x`` holds ``window`` values of which the last lies ``horizon`` steps before
    ``t``. Train targets stop at ``int(train * n)``, test targets start there.
    """
    back = window + horizon - 1
    n = df.agg(F.max("t") + 1).scalar()
    blocks = overlapped(df, "t", back, width)
    frame = Window.partitionBy("sensor", "_blk").orderBy("t").rowsBetween(-back, -horizon)
    out = (
        blocks.withColumn("x", F.collect_list("value").over(frame))
        .filter(F.col("_own") & (F.size("x") == window))
        .withColumn("_n", n)
    )
    part = F.when(F.col("t") < F.floor(F.col("_n") * F.lit(float(train))), "train")
    return out.select(
        "sensor", "t", "x", F.col("value").alias("y"), part.otherwise("test").alias("part")
    )


def lm_sequences(
    df: DataFrame,
    row_id: str,
    col: str,
    seq_len: int = 5,
    stride: int = 1,
    block: int = 4096,
) -> DataFrame:
    """``start, x, y`` token windows over the concatenation of all texts by id.

    Texts are cut at fixed global token positions, so each block is rebuilt from
    the few texts that touch it, together with the next ``seq_len`` tokens; the
    tokens travel once and not once per window.
    """
    need = seq_len + 1
    tokens = df.select(row_id, ws_tokens(col).alias("_t"))
    sized = tokens.withColumn("_n", F.size("_t"))
    placed = prefix_weights(sized, row_id, F.col("_n"), "_start", "_total").filter("_n > 0")
    first = F.greatest(F.floor((F.col("_start") - need) / block), F.lit(0))
    last = F.floor((F.col("_start") + F.col("_n") - 1) / block)
    spread = placed.withColumn("_blk", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("_blk") * block - F.col("_start"), F.lit(0))
    hi = F.least(F.col("_blk") * block + block + seq_len - F.col("_start"), F.col("_n"))
    pieces = spread.filter(hi > lo).select(
        "_blk",
        "_total",
        (F.col("_start") + lo).alias("_at"),
        F.slice("_t", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_p"),
    )
    blocks = pieces.groupBy("_blk", "_total").agg(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_at", "_p"))), lambda s: s["_p"]
            )
        ).alias("_b")
    )
    base = F.col("_blk") * block
    begin = F.ceil(base / stride) * stride
    end = F.least(base + block, F.col("_total") - seq_len - 1) - 1
    starts = F.when(end >= begin, F.sequence(begin, end, F.lit(stride).cast("long")))
    return (
        blocks.withColumn("start", F.explode(starts))
        .withColumn("_s", F.slice("_b", (F.col("start") - base + 1).cast("int"), F.lit(need)))
        .select(
            "start",
            F.slice("_s", 1, seq_len).alias("x"),
            F.slice("_s", 2, seq_len).alias("y"),
        )
    )
