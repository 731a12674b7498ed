"""Splitting rows across clients and into train/held-out parts.

Rows are placed by their position in a seeded hash order (see
``functions.positions``), so no split sorts a whole table or a whole label in one
task, and the same seed gives the same split on any cluster. Every function
returns the input columns plus ``client_id`` or ``part``; pass narrow frames.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions.positions import (
    hash_positions,
    hash_uniform,
    id_positions,
    same_key_join,
    seeded_hash,
    sorted_positions,
)
from quillmesh.session import cut_lineage, tasks_by_rows, written

#: Nodes up to which their ids are shared with all tasks.
NODES = 1 << 23


def hash_normal(seed: int | str, *cols: str | Column) -> Column:
    """Standard normal draw (Box-Muller) fixed by the seed and the columns."""
    h = seeded_hash(seed, *cols)
    scale = F.lit(4294967296.0)
    u1 = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / scale
    u2 = (F.conv(F.substring(h, 9, 8), 16, 10).cast("double") + 0.5) / scale
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.lit(math.pi) * u2)


def even_part(pos: Column, total: Column, parts: Column | int) -> Column:
    """Part of a position when ``total`` rows are cut evenly, first parts larger."""
    parts = F.lit(parts) if isinstance(parts, int) else parts
    base = F.floor(total / parts)
    rem = total - base * parts
    head = rem * (base + 1)
    return (
        F.when(pos < head, F.floor(pos / (base + 1)))
        .otherwise(rem + F.floor((pos - head) / F.greatest(base, F.lit(1))))
        .cast("long")
    )


def part_of(pos: Column, cuts: Column) -> Column:
    """Number of ascending cut points at or below a position."""
    return F.size(F.filter(cuts, lambda c: c <= pos)).cast("long")


def client_sizes(
    spark: SparkSession,
    n: int,
    total: int | Column,
    imbalance: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """``client_id, size``: equal sizes, or log-normal ones, that sum to ``total``.

    Log-normal draws are scaled to the total and rounded by largest remainder.
    """
    total = F.lit(total) if isinstance(total, int) else total
    clients = spark.range(n).select(F.col("id").alias("client_id"), total.alias("_n"))
    if imbalance == 0:
        size = F.floor(F.col("_n") / n) + (F.col("client_id") < F.col("_n") % n).cast("long")
        return clients.select("client_id", size.alias("size"))
    sigma = max(0.1, imbalance)
    drawn = clients.withColumn("_w", F.exp(F.lit(sigma) * hash_normal(seed, "client_id")))
    whole = Window.partitionBy("_n")
    ideal = drawn.withColumn("_s", F.col("_w") / F.sum("_w").over(whole) * F.col("_n"))
    floors = ideal.withColumn("_f", F.floor("_s"))
    order = whole.orderBy(F.desc(F.col("_s") - F.col("_f")), F.asc("client_id"))
    missing = F.col("_n") - F.sum("_f").over(whole)
    extra = (F.row_number().over(order) <= missing).cast("long")
    return floors.select("client_id", (F.col("_f") + extra).alias("size"))


def _cut_points(sizes: DataFrame) -> Column:
    """Running totals of a client table as one array (one entry per client)."""
    listed = sizes.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("client_id", "size"))),
            lambda s: s["size"],
        ).alias("s")
    )
    cuts = listed.select(
        F.transform(
            F.col("s"),
            lambda x, i: F.aggregate(
                F.slice("s", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, v: a + v
            ),
        )
    )
    return cuts.scalar()


def split_iid(
    df: DataFrame,
    row_id: str,
    n: int,
    imbalance: float = 0.0,
    seed: int = 0,
    within: str | None = None,
) -> DataFrame:
    """Random split into ``n`` clients of equal or log-normal size."""
    keys = [within] if within else []
    placed = hash_positions(df, row_id, keys, seed, "_pos", "_n")
    if imbalance == 0:
        client = even_part(F.col("_pos"), F.col("_n"), n)
    elif within:
        raise ValueError("an imbalanced split cannot be nested")
    else:
        total = df.agg(F.count(F.lit(1))).scalar()
        sizes = client_sizes(df.sparkSession, n, total, imbalance, seed)
        placed = placed.withColumn("_cuts", _cut_points(sizes))
        client = part_of(F.col("_pos"), F.col("_cuts"))
    return placed.select(*df.columns, client.alias("client_id"))


def dirichlet_shares(
    counts: DataFrame,
    label: str,
    n: int,
    alpha: float,
    seed: int = 0,
    sizes: DataFrame | None = None,
    rounds: int = 3,
    error: float = 0.001,
) -> DataFrame:
    """``client_id, label, weight``: rows of a label that a client should get.

    Every client draws its label mix from Dir(alpha * p). Alternate scaling of
    labels and clients then pulls the sums towards the label counts and the
    client sizes, which replaces a search for draws that happen to fit. Labels are
    met exactly. After every ``rounds`` scalings the sums of the clients are compared
    with their sizes; scaling ends when none is further off than ``error`` of its size,
    or when the worst has come less than a tenth closer, as it does where draws are so
    skewed that no scaling meets the sizes.
    """
    spark = counts.sparkSession
    total = counts.agg(F.sum("count")).scalar()
    grid = counts.select(
        label,
        F.col("count").cast("double").alias("_c"),
        (F.col("count") / total).alias("_p"),
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
        ).alias("client_id"),
    )

    @F.pandas_udf("double")
    def log_gamma(client: pd.Series, name: pd.Series, shape: pd.Series) -> pd.Series:
        out = np.empty(len(client))
        for i, (c, v, a) in enumerate(zip(client, name, shape)):
            rng = np.random.default_rng([seed, int(c), zlib.crc32(v.encode())])
            # ln G(a) = ln G(a + 1) + ln(U) / a stays finite for a tiny shape.
            out[i] = np.log(rng.gamma(a + 1.0)) + np.log(rng.random()) / a
        return pd.Series(out)

    by_client, by_label = Window.partitionBy("client_id"), Window.partitionBy(label)
    drawn = grid.withColumn(
        "_g", log_gamma("client_id", F.coalesce(F.col(label).cast("string"), F.lit("\0")), F.col("_p") * alpha)
    )
    weight = F.exp(F.col("_g") - F.max("_g").over(by_client))
    shares = drawn.withColumn("_w", weight)
    if sizes is None:
        sizes = client_sizes(spark, n, total)
    out, last = shares.join(sizes, "client_id"), float("inf")
    while True:
        for _ in range(rounds):
            scale = F.col("size") / F.sum("_w").over(by_client)
            out = out.withColumn("_w", F.coalesce(F.col("_w") * scale, F.lit(0.0)))
            norm = F.sum("_w").over(by_label)
            # A label that nobody drew is shared by client size.
            out = out.withColumn(
                "_w",
                F.when(norm > 0, F.col("_w") / norm * F.col("_c")).otherwise(
                    F.col("size") / F.sum("size").over(by_label) * F.col("_c")
                ),
            )
        out = cut_lineage(out)
        held = out.groupBy("client_id").agg(F.sum("_w").alias("w"), F.first("size").alias("size"))
        off = held.agg(F.max(F.abs(F.col("w") - F.col("size")) / F.greatest("size", F.lit(1)))).first()[0] or 0.0
        if off <= error or off > 0.9 * last:
            break
        last = off
    return out.select("client_id", label, F.col("_w").alias("weight"), "_c")


def split_dirichlet(
    df: DataFrame,
    row_id: str,
    label: str,
    n: int,
    alpha: float,
    imbalance: float = 0.0,
    seed: int = 0,
    rounds: int = 3,
) -> DataFrame:
    """Label-skewed split: the rows of a label are cut by the clients' shares.

    Clients get exactly the sizes of ``client_sizes``: what the shares give a client
    beyond its size, in pseudo-random order of its rows, goes to those that got less.
    """
    if n == 1:
        return df.withColumn("client_id", F.lit(0).cast("long"))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    sizes = client_sizes(df.sparkSession, n, total, imbalance, seed)
    shares = dirichlet_shares(counts, label, n, alpha, seed, sizes, rounds)
    own = Window.partitionBy(label)
    run = own.orderBy("client_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum("weight").over(run) / F.sum("weight").over(own)
    # All but the last client end at the floor of their cumulative share.
    end = F.when(F.col("client_id") < n - 1, F.floor(cum * F.col("_c"))).otherwise(F.col("_c")).cast("long")
    ends = cut_lineage(shares.select("client_id", label, end.alias("_cut")))
    cuts = (
        ends.filter(F.col("client_id") < n - 1)
        .groupBy(label)
        .agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
    )
    placed = hash_positions(df, row_id, [label], seed, "_pos", None)
    client = part_of(F.col("_pos"), F.col("_cuts"))
    first = same_key_join(placed, cuts, label).select(*df.columns, client.alias("client_id"))

    got = F.col("_cut") - F.lag("_cut", 1, 0).over(own.orderBy("client_id"))
    held = ends.select("client_id", got.alias("got")).groupBy("client_id").agg(F.sum("got").alias("got"))
    goal = {r[0]: r[1] for r in sizes.collect()}  # n rows
    have = {r[0]: r[1] for r in held.collect()}  # n rows
    limit = [goal.get(c, 0) for c in range(n)]
    spare = [have.get(c, 0) - limit[c] for c in range(n)]
    before = np.concatenate([[0], np.cumsum(np.maximum(spare, 0))])[:n].tolist()
    filled = np.cumsum(np.maximum(-np.array(spare), 0)).tolist()
    beyond = hash_positions(first, row_id, ["client_id"], f"{seed}:spare", "_at", None)
    over = F.col("_at") - F.get(F.lit(limit), "client_id")
    moved = part_of(F.get(F.lit(before), "client_id") + over, F.lit(filled))
    return beyond.select(*df.columns, F.when(over >= 0, moved).otherwise(F.col("client_id")).alias("client_id"))


def label_owners(labels: DataFrame, label: str, n: int, diversity: float) -> DataFrame:
    """``label, owners``: the clients of each label, dealt out in turn.

    A client takes ``max(int(diversity * K), 1)`` labels, continuing where the
    one before stopped, so that label usage differs by one at most.
    """
    indexed = sorted_positions(labels.select(label).distinct(), [label], pos="_k", total="_kinds")
    per_client = F.greatest(F.floor(F.lit(float(diversity)) * F.col("_kinds")), F.lit(1))
    # Client i holds slots i*num .. i*num+num-1 modulo K; n is configuration sized.
    everyone = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    owners = F.filter(
        everyone,
        lambda i: F.pmod(F.col("_k") - i * per_client, F.col("_kinds")) < per_client,
    )
    return indexed.select(label, owners.alias("owners"))


def split_diversity(
    df: DataFrame, row_id: str, label: str, n: int, diversity: float, seed: int = 0
) -> DataFrame:
    """Each client owns a share of the labels; owners split a label evenly.

    ``client_id`` is null for labels that no client owns, which can only happen
    when there are fewer slots than labels.
    """
    owners = label_owners(df, label, n, diversity)
    placed = hash_positions(df, row_id, [label], seed, "_pos", "_n")
    turn = even_part(F.col("_pos"), F.col("_n"), F.size("owners"))
    client = F.when(F.size("owners") > 0, F.get("owners", turn.cast("int")))
    return same_key_join(placed, owners, label).select(*df.columns, client.alias("client_id"))


def perturb(
    df: DataFrame,
    row_id: str,
    cols: Sequence[str],
    n: int,
    sigma: float = 0.1,
    scale: float = 0.1,
    imbalance: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """Random split plus a fixed Gaussian shift per client and noise per row."""
    out = split_iid(df, row_id, n, imbalance, seed)
    for c in cols:
        mean = F.lit(sigma) * hash_normal(seed, F.lit("mean"), F.lit(c), "client_id")
        noise = F.lit(scale) * hash_normal(seed, F.lit("row"), F.lit(c), row_id)
        out = out.withColumn(c, F.col(c) + mean + noise)
    return out


def split_by_id(
    df: DataFrame, key: str, n: int = -1, priority: str = "random", seed: int = 0
) -> DataFrame:
    """One client per owner; with ``n >= 0`` only the n owners chosen by size."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    if n < 0:
        owners = hash_positions(sizes.select(key), key, seed=seed, pos="client_id", total=None)
        return same_key_join(df, owners, key)
    orders = {
        "max": [F.desc("_c"), F.asc(key)],
        "min": [F.asc("_c"), F.asc(key)],
        "random": [seeded_hash(seed, key).asc(), F.asc(key)],
    }
    if priority not in orders:
        raise ValueError("priority must be max, min or random")
    chosen = sizes.orderBy(*orders[priority]).limit(n)
    rank = F.row_number().over(Window.orderBy(*orders[priority])) - 1
    ids = chosen.select(key, rank.cast("long").alias("client_id"))
    return same_key_join(df, ids, key)


def split_grouped(df: DataFrame, key: str, target: int = 7) -> DataFrame:
    """Neighbouring owners share a client: ``max(1, ceil(owners / target))`` each."""
    owners = sorted_positions(df.select(key).distinct(), [key], pos="_k", total="_kinds")
    size = F.greatest(F.lit(1), F.ceil(F.col("_kinds") / target))
    ids = owners.select(key, F.floor(F.col("_k") / size).cast("long").alias("client_id"))
    return same_key_join(df, ids, key)


def vertical_sizes(total: int, parties: int, imbalance: float = 0.0) -> list[int]:
    """Columns per party: one integer partition, picked by spread."""
    parties = min(parties, total)
    shapes: list[tuple[int, ...]] = [()]
    for slot in range(parties):
        left = parties - slot
        grown = []
        for s in shapes:
            rest, low = total - sum(s), s[-1] if s else 1
            if left == 1:
                grown.append((*s, rest))
            else:
                grown += [(*s, v) for v in range(low, rest // left + 1)]
        shapes = grown
    shapes.sort(key=lambda s: float(np.std(s)))
    return list(shapes[int(imbalance * (len(shapes) - 1))])


def split_vertical(
    df: DataFrame,
    row_id: str,
    cols: Sequence[str],
    parties: int,
    imbalance: float = 0.0,
    label: str | None = None,
) -> list[DataFrame]:
    """One projection per party; only the first holds the label."""
    out, at = [], 0
    for party, size in enumerate(vertical_sizes(len(cols), parties, imbalance)):
        held = list(cols[at : at + size])
        at += size
        extra = [label] if label and party == 0 else []
        out.append(df.select(row_id, *held, *extra))
    return out


def split_hier(
    df: DataFrame,
    first: Callable[[DataFrame], DataFrame],
    second: Callable[..., DataFrame],
) -> DataFrame:
    """Two-level split: ``edge_id`` by the first, ``client_id`` inside each edge."""
    edges = first(df).withColumnRenamed("client_id", "edge_id")
    return second(edges, within="edge_id")


def _held(total: Column, p: float) -> Column:
    return F.floor(total * F.lit(float(p)))


def _parts(pos: Column, total: Column, p: float, local_test: bool) -> Column:
    """Train rows first, then validation, then test."""
    held = _held(total, p)
    test = F.floor(held * F.lit(0.5)) if local_test else F.lit(0)
    return (
        F.when(pos < total - held, F.lit("train"))
        .when(pos < total - test, F.lit("val"))
        .otherwise(F.lit("test"))
    )


def holdout(
    df: DataFrame,
    row_id: str,
    p: float,
    local_test: bool = False,
    within: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """Random hold-out of ``int(n * p)`` rows, per client with ``within``."""
    placed = hash_positions(df, row_id, [within] if within else [], seed, "_pos", "_n")
    part = _parts(F.col("_pos"), F.col("_n"), p, local_test)
    return placed.withColumn("part", part).drop("_pos", "_n")


def holdout_ordered(
    df: DataFrame,
    p: float,
    row_id: str | None = None,
    order: Sequence[str] = (),
    within: Sequence[str] = (),
    local_test: bool = False,
) -> DataFrame:
    """Hold out the last rows, by an integer id or by sort columns."""
    if row_id:
        placed = id_positions(df, row_id, within, "_pos", "_n")
    else:
        placed = sorted_positions(df, order, within, "_pos", "_n")
    part = _parts(F.col("_pos"), F.col("_n"), p, local_test)
    return placed.withColumn("part", part).drop("_pos", "_n")


def split_ratings(
    df: DataFrame, user: str, order: Sequence[str], low: int, high: int, p: float = 0.8
) -> DataFrame:
    """First 80 % of each user's rows are train, after a strict size filter.

    The filter comes first, so no user reaches the window with ``high`` rows.
    """
    kept = (
        df.groupBy(user)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > low) & (F.col("_n") < high))
    )
    w = Window.partitionBy(user).orderBy(*order)
    placed = df.join(kept, user).withColumn("_pos", F.row_number().over(w) - 1)
    train = F.col("_pos") < F.floor(F.col("_n") * F.lit(float(p)))
    return placed.select(
        *df.columns, F.when(train, F.lit("train")).otherwise(F.lit("test")).alias("part")
    )


def split_random(df: DataFrame, row_id: str, p: float = 0.8, seed: int = 0) -> DataFrame:
    """Random split with ``int(n * p)`` train rows."""
    placed = hash_positions(df, row_id, seed=seed, pos="_pos", total="_n")
    train = F.col("_pos") < F.floor(F.col("_n") * F.lit(float(p)))
    return placed.select(
        *df.columns, F.when(train, F.lit("train")).otherwise(F.lit("test")).alias("part")
    )


def split_nodes(
    nodes: DataFrame, node: str, val: float, test: float, seed: int = 0
) -> DataFrame:
    """Random node split with ``int(n * val)`` and ``int(n * test)`` nodes."""
    placed = hash_positions(nodes, node, seed=seed, pos="_pos", total="_n")
    n_val, n_test = _held(F.col("_n"), val), _held(F.col("_n"), test)
    part = (
        F.when(F.col("_pos") < n_val, F.lit("val"))
        .when(F.col("_pos") < n_val + n_test, F.lit("test"))
        .otherwise(F.lit("train"))
    )
    return placed.select(*nodes.columns, part.alias("part"))


def split_graphs(graphs: DataFrame, graph_id: str, rate: float, seed: int = 0) -> DataFrame:
    """Whole graphs: ``int(rate * n)`` go to the test part."""
    return split_nodes(graphs, graph_id, 0.0, rate, seed)


def _order_hash(seed: int, row_id: str | Column) -> Column:
    """What ``hash_positions`` orders by, as hex digits."""
    return F.substring(seeded_hash(seed, row_id), 1, 15)


def _ends(rows: DataFrame, seed: int, row_id: str, firsts: Sequence[tuple[Column, int]]) -> list[Column]:
    """Per (group, count) a condition that holds for the group's first ``count`` rows in the
    order of ``hash_positions``.

    Only the row behind them is looked for, so no row is dealt or sorted: rows are counted
    by the first digits of their hash, then those that share the row's digits are ordered.
    """
    h, digits = _order_hash(seed, row_id), 4
    sums = [F.count_if(group).alias(f"_g{i}") for i, (group, _) in enumerate(firsts)]
    counts = rows.groupBy(F.substring(h, 1, digits).alias("_b")).agg(*sums).toPandas().sort_values("_b")
    out = []
    for i, (group, count) in enumerate(firsts):
        upto = counts[f"_g{i}"].to_numpy().cumsum()
        if not len(upto) or count >= upto[-1]:
            out.append(F.lit(True))
            continue
        at = int(np.searchsorted(upto, count, side="right"))
        skip = count - (int(upto[at - 1]) if at else 0)
        same = rows.filter(group & (F.substring(h, 1, digits) == counts["_b"].iloc[at]))
        row = same.select(h.alias("_h"), F.col(row_id).alias("_i")).orderBy("_h", "_i").offset(skip).limit(1).first()
        out.append((h < row["_h"]) | ((h == row["_h"]) & (F.col(row_id) < F.lit(row["_i"]))))
    return out


def _node_lookup(indexed: DataFrame, n: int) -> Callable[[DataFrame], DataFrame]:
    """``src`` and ``dst`` in place of the node numbers ``_a`` and ``_b``.

    Up to ``NODES`` whole numbers are shared with all tasks; beyond, and for other nodes,
    rows are joined twice.
    """
    spark = indexed.sparkSession
    kind = indexed.schema["node"].dataType.simpleString()
    if n <= NODES and kind in ("bigint", "int") and indexed.filter("node is null").isEmpty():
        table = indexed.select("_k", "node").toArrow()
        names = np.zeros(n, np.int64 if kind == "bigint" else np.int32)
        names[table.column("_k").to_numpy()] = table.column("node").to_numpy()
        shared = spark.sparkContext.broadcast(names)

        def name(number: pd.Series) -> pd.Series:
            return pd.Series(shared.value[number.to_numpy()])

        # Else the filter that follows would make the names a second time.
        node = F.pandas_udf(name, kind).asNondeterministic()
        return lambda c: c.withColumns({"src": node("_a"), "dst": node("_b")}).drop("_a", "_b")
    left = indexed.select(F.col("_k").alias("_a"), F.col("node").alias("src"))
    right = indexed.select(F.col("_k").alias("_b"), F.col("node").alias("dst"))
    return lambda c: c.join(left, "_a").join(right, "_b").drop("_a", "_b")


def split_links(
    edges: DataFrame,
    val: float,
    test: float,
    neg: float = 1.0,
    seed: int = 0,
    draws: int = 4,
    undirected: bool = False,
) -> DataFrame:
    """Random link split with negatives: ``src, dst, edge_label, part``.

    Each part gets exactly ``int(neg * positives)`` pairs of different nodes that are no
    edge, in neither direction if ``undirected``; it is an error if the graph has too few.
    Every edge proposes ``draws`` random pairs, twice as many as long as a part is short.
    Parts take the first ones in hash order, found by counting; the others are not dealt.
    Where pairs are scarce all of them are listed, as many rows as there are edges and
    negatives, but for a small factor.
    """
    spark = edges.sparkSession
    named_id = F.concat_ws("-", "src", "dst")
    pairs = written(edges.select("src", "dst").distinct())
    total = pairs.count()
    # Sizes of the parts in the order in which positions deal them out.
    sizes = {"val": math.floor(total * float(val)), "test": math.floor(total * float(test))}
    upto = [sizes["val"], sizes["val"] + sizes["test"]]
    sizes["train"] = total - upto[1]
    split = pairs.withColumn("_id", named_id)
    ends = _ends(split, seed, "_id", [(F.lit(True), k) for k in upto])
    part = F.when(ends[0], F.lit("val")).when(ends[1], F.lit("test")).otherwise(F.lit("train"))
    split = split.withColumn("part", part)
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    indexed = written(hash_positions(nodes, "node", seed=seed, pos="_k", total="_N"))
    taken = pairs.filter("src <> dst")
    if undirected:
        taken = taken.unionByName(taken.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    n = indexed.count()
    free = n * (n - 1) - taken.count()
    want = {name: int(neg * size) for name, size in sizes.items() if size}
    if sum(want.values()) * (2 if undirected else 1) > free:
        raise ValueError("the graph has too few pairs without an edge")
    lookup = _node_lookup(indexed, n)

    def fresh(candidates: DataFrame, bound: float = 1.0) -> DataFrame:
        """Candidates that are new pairs without an edge, each once; of those only the
        ones that come in the first ``bound`` of the order by hash."""
        named = lookup(candidates).filter("src <> dst")
        if undirected:
            low, high = F.least("src", "dst"), F.greatest("src", "dst")
            named = named.withColumns({"src": low, "dst": high})
        if bound < 1:
            named = named.filter(_order_hash(seed, named_id) < f"{int(bound * 16**15):015x}")
        # Dealt before they are counted, as next to no pair comes twice within a task.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = named.repartition(parts, "src", "dst")
        once = dealt.groupBy("src", "dst").agg(F.min(F.struct("_draw", "_id", "part")).alias("_first"))
        once = once.select("src", "dst", "_first.part").join(taken, ["src", "dst"], "left_anti")
        return once.withColumn("_id", named_id)

    def pick(side: str) -> Column:
        u = hash_uniform(seed, F.lit(side), "_id", "_draw")
        return F.floor(u * F.lit(n)).cast("long")

    if sum(want.values()) > free / 4 or free < n * n / 2:
        every = indexed.select(
            F.col("_k").alias("_a"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_b"),
            F.lit(0).alias("_draw"),
            F.lit("").alias("_id"),
            F.lit("").alias("part"),
        )
        placed = hash_positions(cut_lineage(fresh(every).drop("part")), "_id", (), seed, "_pos", None)
        # Parts take their shares of the one order, one behind the other.
        part, at = F.lit(None).cast("string"), 0
        for name, count in sorted(want.items()):
            part = F.when((F.col("_pos") >= at) & (F.col("_pos") < at + count), F.lit(name)).otherwise(part)
            at += count
        negative = placed.withColumn("part", part).filter("part is not null")
    else:
        # A part takes the first of its candidates by hash, so the rest need not be dealt.
        bound = 1.2 * neg / draws + 0.01
        while True:
            drawn = split.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(
                "part", "_id", "_draw", pick("a").alias("_a"), pick("b").alias("_b")
            )
            with tasks_by_rows(spark, math.ceil(total * draws * min(bound, 1.0))):
                found = written(fresh(drawn, bound).drop("_id")).withColumn("_id", named_id)
            got = {r["part"]: r["count"] for r in found.groupBy("part").count().collect()}
            if all(got.get(name, 0) >= count for name, count in want.items()):
                break
            draws, bound = (draws, 2 * bound) if bound < 1 else (2 * draws, bound)
        own = list(want.items())
        ends = _ends(found, seed, "_id", [(F.col("part") == name, count) for name, count in own])
        first = F.lit(False)
        for (name, _), end in zip(own, ends):
            first = first | ((F.col("part") == name) & end)
        negative = found.filter(first)
    return split.select("src", "dst", F.lit(1).alias("edge_label"), "part").unionByName(
        negative.select("src", "dst", F.lit(0).alias("edge_label"), "part")
    )


def partition_profile(df: DataFrame, label: str, client: str = "client_id") -> DataFrame:
    """Label histogram per client with the client's size and its rank by size."""
    counts = df.groupBy(client, label).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(client).agg(F.sum("n").alias("size"))
    order = Window.orderBy(F.desc("size"), F.asc(client))
    ranked = sizes.withColumn("size_rank", F.row_number().over(order).cast("long"))
    return counts.join(ranked, client)


def sample_clients(
    clients: DataFrame,
    how: str = "full",
    p: float = 1.0,
    seed: int = 0,
    volume: str = "volume",
    n_all: int | None = None,
) -> DataFrame:
    """Clients of one round: all, uniform, or by data volume with replacement.

    The number drawn is ``max(min(int(n_all * p), available), 1)``. Client tables
    are configuration sized.
    """
    if how == "full":
        return clients.select("client_id")
    available = clients.count()
    m = max(min(int((n_all or available) * p), available), 1)
    if how == "uniform":
        order = [seeded_hash(seed, "client_id").asc(), F.asc("client_id")]
        return clients.orderBy(*order).limit(m).select("client_id")
    if how != "volume":
        raise ValueError("how must be full, uniform or volume")
    listed = clients.agg(
        F.sort_array(F.collect_list(F.struct("client_id", volume))).alias("c")
    ).select(
        F.transform(
            F.col("c"),
            lambda s, i: F.struct(
                s["client_id"].alias("client_id"),
                F.aggregate(
                    F.slice("c", F.lit(1), i + 1),
                    F.lit(0).cast("double"),
                    lambda a, v: a + v[volume],
                ).alias("upto"),
            ),
        )
    )
    spark = clients.sparkSession
    drawn = spark.range(m).select(
        F.col("id").alias("draw"), hash_uniform(seed, "id").alias("u"), listed.scalar().alias("c")
    )
    total = F.get("c", F.size("c") - 1)["upto"]
    hit = F.get(F.filter("c", lambda s: s["upto"] > F.col("u") * total), F.lit(0))
    return drawn.select("draw", hit["client_id"].alias("client_id"))
