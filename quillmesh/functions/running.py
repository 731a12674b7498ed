"""Running aggregates and bounded frames over series of any length.

A series is cut into blocks of ``width`` positions. Running aggregates combine a
window inside each block with a window over the block totals; bounded frames get
the rows they need from the preceding block. No series is ever one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.positions import group_key

WIDTH = 1 << 16
_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    width: int = WIDTH,
) -> DataFrame:
    """Add running aggregates ``{out: (sum|max|min|count, value)}`` by ``pos``.

    ``pos`` is an integer. Exclusive aggregates leave out the current row.
    """
    tagged = df.withColumn("_blk", F.floor(F.col(pos) / width))
    tagged = tagged.withColumn("_key", group_key(keys))
    for i, (_, value) in enumerate(values.values()):
        tagged = tagged.withColumn(f"_v{i}", value)
    totals = tagged.groupBy("_key", "_blk").agg(
        *[_AGG[fn](f"_v{i}").alias(f"_t{i}") for i, (fn, _) in enumerate(values.values())]
    )
    before = Window.partitionBy("_key").orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Block counts are added up, all other totals combine with their own function.
    up = {"count": F.sum}
    offsets = totals.select(
        "_key",
        "_blk",
        *[
            up.get(fn, _AGG[fn])(f"_t{i}").over(before).alias(f"_o{i}")
            for i, (fn, _) in enumerate(values.values())
        ],
    )
    end = 0 if inclusive else -1
    local = (
        Window.partitionBy("_key", "_blk")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    for i, (fn, _) in enumerate(values.values()):
        tagged = tagged.withColumn(f"_l{i}", _AGG[fn](f"_v{i}").over(local))
    joined = tagged.join(offsets, ["_key", "_blk"], "left")
    outs = []
    for i, (name, (fn, _)) in enumerate(values.items()):
        a, b = F.col(f"_o{i}"), F.col(f"_l{i}")
        if fn == "max":
            merged = F.greatest(a, b)
        elif fn == "min":
            merged = F.least(a, b)
        else:
            merged = F.coalesce(a + b, a, b)
        outs.append(merged.alias(name))
    return joined.select(*df.columns, *outs)


def overlapped(
    df: DataFrame, pos: str, back: int, width: int = WIDTH
) -> DataFrame:
    """Copy the last ``back`` positions of every block to the next one.

    Adds ``_blk`` (the block to window in) and ``_own`` (false for copies, which
    only serve as history and must be filtered out after the window).
    """
    if back > width:
        raise ValueError("history longer than a block")
    blk = F.floor(F.col(pos) / width)
    late = F.pmod(F.col(pos), F.lit(width)) >= width - back
    blocks = F.when(late, F.array(blk, blk + 1)).otherwise(F.array(blk))
    return (
        df.withColumn("_home", blk)
        .withColumn("_blk", F.explode(blocks))
        .withColumn("_own", F.col("_blk") == F.col("_home"))
        .drop("_home")
    )
