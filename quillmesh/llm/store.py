"""Stored intermediates, membership filters and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut_lineage, ensure_checkpoint_dir

#: Bits of a membership filter (8 MB). Fixed: with more members it lets more through.
FILTER_BITS = 1 << 26


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write to the checkpoint folder as Parquet, which all executors share, and read;
    ``by``: last columns of which each value has a folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/quillmesh-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def membership(df: DataFrame, *keys: Column, bits: int = FILTER_BITS) -> np.ndarray:
    """Bit array in which two bits are set for every key (bigint), by its lower halves.

    It only spares rows an exchange: whoever uses it must bear false positives. Its
    size is fixed; rows are combined per word before they reach the driver.
    """
    each = df.select(F.explode(F.array(*keys)).alias("k"))
    low, next_ = F.expr(f"k & {bits - 1}L"), F.expr(f"shiftrightunsigned(k, {bits.bit_length() - 1}) & {bits - 1}L")
    each = each.select(F.explode(F.array(low, next_)).alias("k"))
    words = each.groupBy(F.shiftright("k", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(k & 63 AS int))")).alias("b")
    )
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()  # at most bits / 64 rows
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def is_member(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For unsigned 64-bit keys."""
    bits = len(words) * 64
    out = np.ones(len(keys), bool)
    for k in (keys & np.uint64(bits - 1), (keys >> np.uint64(bits.bit_length() - 1)) & np.uint64(bits - 1)):
        out &= (words[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1) == 1
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node of ``edges`` (a, b).

    Large-star and small-star rounds in turn until nothing changes; each round is two
    aggregations and two joins over the edges, checkpointed. Large components are never
    gathered: a round only looks at minima.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, mark = cut_lineage(now), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(small_least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = cut_lineage(small)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
