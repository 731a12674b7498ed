"""Row positions (0-based) inside groups of any size.

``row_number() over (partition by key)`` puts a whole key in one task, and
without a key it puts the whole table there. All functions here cut a group into
ordered buckets, number rows inside each bucket, and add the running total of
the preceding buckets, which is a window over the small table of bucket counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import cut_lineage

HASH_PREFIX = 3


def seeded_hash(seed: int | str, *cols: str | Column) -> Column:
    """Hex digest of ``seed:col:col...``; uniform, and the same in any SQL engine."""
    parts = [F.lit(str(seed))]
    parts += [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_uniform(seed: int | str, *cols: str | Column) -> Column:
    """Uniform draw in (0, 1) from the first 32 bits of the seeded digest."""
    bits = F.conv(F.substring(seeded_hash(seed, *cols), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(4294967296.0)


def bucket_positions(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    pos: str = "pos",
    total: str | None = "n",
) -> DataFrame:
    """Number rows given a bucket expression that agrees with ``order``.

    The bucket must be a pure function of the row, so that a recomputed task
    yields the same numbers.
    """
    tagged = df.withColumn("_bucket", bucket).withColumn("_key", group_key(keys))
    counts = tagged.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy("_key")
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn("_all", F.sum("_c").over(group))
    local = Window.partitionBy("_key", "_bucket").orderBy(*order)
    numbered = tagged.withColumn("_rn", F.row_number().over(local))
    out = [(F.col("_off") + F.col("_rn") - 1).cast("long").alias(pos)]
    if total:
        out.append(F.col("_all").cast("long").alias(total))
    # Every row has its offset; an inner join would add a filter that computes the
    # bucket once more.
    joined = numbered.join(offsets.drop("_c"), ["_key", "_bucket"], "left")
    return joined.select(*[F.col(c) for c in df.columns], *out)


def same_key_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on one column under which null equals null; the left column stays."""
    other = right.withColumnRenamed(key, "_same")
    return left.join(other, left[key].eqNullSafe(other["_same"]), how).drop("_same")


def group_key(keys: Sequence[str]) -> Column:
    """The keys as one struct, whose equality also holds for null fields.

    Joining on it keeps the partitioning of a window over the same column, which
    a null-safe comparison of the single keys would not.
    """
    return F.struct(*keys) if keys else F.lit(0)


def hash_positions(
    df: DataFrame,
    row_id: str,
    keys: Sequence[str] = (),
    seed: int | str = 0,
    pos: str = "pos",
    total: str | None = "n",
    prefix: int = HASH_PREFIX,
) -> DataFrame:
    """Positions in a seeded pseudo-random order; ``row_id`` must be unique.

    ``prefix`` hex digits give ``16**prefix`` buckets per key.
    """
    # 60 bits as a number: a quarter of the digest's size to shuffle and sort.
    h = F.conv(F.substring(seeded_hash(seed, row_id), 1, 15), 16, 10).cast("long")
    placed = df.withColumn("_hash", h)
    bucket = F.shiftright(F.col("_hash"), 60 - 4 * prefix)
    order = [F.col("_hash").asc(), F.col(row_id).asc()]
    return bucket_positions(placed, keys, bucket, order, pos, total).drop("_hash")


def id_positions(
    df: DataFrame,
    row_id: str,
    keys: Sequence[str] = (),
    pos: str = "pos",
    total: str | None = "n",
) -> DataFrame:
    """Positions by a unique id; dense and sparse ids make buckets of like size."""
    return sorted_positions(df, [row_id], keys, pos, total)


def sorted_positions(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    pos: str = "pos",
    total: str | None = "n",
) -> DataFrame:
    """Positions by any sortable columns; ``keys + order`` must identify a row.

    Spark's range partitioner samples the composite key, so equal keys or equal
    leading order values are still spread. Its cut points differ from run to
    run, hence the partition number is stored by a reliable checkpoint.
    """
    cols = [*keys, *order]
    ranged = df.repartitionByRange(*[F.col(c) for c in cols])
    stored = cut_lineage(ranged.withColumn("_pid", F.spark_partition_id()))
    out = bucket_positions(
        stored, keys, F.col("_pid"), [F.col(c).asc() for c in order], pos, total
    )
    return out.drop("_pid")


def prefix_weights(
    df: DataFrame,
    row_id: str,
    weight: Column,
    start: str = "start",
    total: str = "total",
) -> DataFrame:
    """Running sum of ``weight`` over all preceding rows in id order.

    Rows are cut by ranges of the id into partitions of like size, which are stored
    with their number, as the cut points differ from run to run.
    """
    ranged = df.withColumn("_w", weight.cast("long")).repartitionByRange(F.col(row_id))
    tagged = cut_lineage(ranged.withColumn("_bucket", F.spark_partition_id()))
    sums = tagged.groupBy("_bucket").agg(F.sum("_w").alias("_bw"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_bucket").alias("_b2"),
        F.coalesce(F.sum("_bw").over(upto), F.lit(0)).alias("_off"),
        F.sum("_bw").over(Window.partitionBy()).alias(total),
    )
    local = (
        Window.partitionBy("_bucket")
        .orderBy(row_id)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    run = tagged.withColumn("_in", F.coalesce(F.sum("_w").over(local), F.lit(0)))
    return run.join(offsets, F.col("_bucket") == F.col("_b2")).select(
        *df.columns, (F.col("_off") + F.col("_in")).alias(start), F.col(total)
    )
