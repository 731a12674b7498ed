import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions.positions import id_positions, prefix_weights, sorted_positions
from quillmesh.functions.running import running
from quillmesh.operators import graph, partitioning


def rows(spark, n=1000):
    """Label 0 holds a third of all rows, some labels are null."""
    label = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 7 + 1)
    return spark.range(n).select("id", label.alias("label"))


def test_equal_sizes(spark):
    got = [r.size for r in partitioning.client_sizes(spark, 3, 10).orderBy("client_id").collect()]
    assert got == [4, 3, 3]


@pytest.mark.parametrize("imbalance", [0.0, 0.8])
def test_iid_is_complete(spark, imbalance):
    out = partitioning.split_iid(rows(spark), "id", 7, imbalance, seed=5).collect()
    assert sorted(r.id for r in out) == list(range(1000))
    sizes = collections.Counter(r.client_id for r in out)
    want = {
        r.client_id: r.size
        for r in partitioning.client_sizes(spark, 7, 1000, imbalance, 5).collect()
    }
    assert dict(sizes) == {k: v for k, v in want.items() if v} and sum(want.values()) == 1000


def test_split_does_not_depend_on_layout(spark):
    a = partitioning.split_iid(rows(spark), "id", 5, seed=1)
    b = partitioning.split_iid(rows(spark).repartition(13, "label"), "id", 5, seed=1)
    key = lambda d: {(r.id, r.client_id) for r in d.collect()}
    assert key(a) == key(b)


def test_dirichlet(spark):
    df = rows(spark, 6000).filter("label is not null")
    out = partitioning.split_dirichlet(df, "id", "label", 6, 0.5, seed=2)
    got = out.collect()
    assert len(got) == len({r.id for r in got}) == df.count()
    assert {r.client_id for r in got} <= set(range(6))
    sizes = collections.Counter(r.client_id for r in got)
    assert sorted(sizes.values()) == sorted(len(got) // 6 + (c < len(got) % 6) for c in range(6))

    def spread(alpha):
        part = partitioning.split_dirichlet(df, "id", "label", 6, alpha, seed=2)
        tab = collections.Counter((r.client_id, r.label) for r in part.collect())
        tot = collections.Counter(r.client_id for r in part.collect())
        return np.std([tab[c, v] / tot[c] for c in tot for v in range(1, 8)])

    assert spread(0.5) > 1.5 * spread(1000.0)


def test_dirichlet_meets_sizes_and_labels(spark):
    df = rows(spark, 3000)
    for alpha, imbalance in ((0.01, 0.0), (0.5, 0.8), (50.0, 0.0)):
        out = partitioning.split_dirichlet(df, "id", "label", 7, alpha, imbalance, seed=4).collect()
        want = {r[0]: r[1] for r in partitioning.client_sizes(spark, 7, 3000, imbalance, 4).collect() if r[1]}
        assert collections.Counter(r.client_id for r in out) == want
        assert sorted((r.id, str(r.label)) for r in out) == sorted((r.id, str(r.label)) for r in df.collect())
    again = partitioning.split_dirichlet(df.repartition(9), "id", "label", 7, alpha, imbalance, seed=4).collect()
    assert {(r.id, r.client_id) for r in again} == {(r.id, r.client_id) for r in out}


def test_dirichlet_shares_end_at_their_error(spark):
    counts = spark.createDataFrame([("a", 700), ("b", 200), (None, 100)], "label string, count long")
    out = partitioning.dirichlet_shares(counts, "label", 5, 2.0, 1).collect()
    for key, want in (("label", {"a": 700, "b": 200, None: 100}), ("client_id", dict.fromkeys(range(5), 200))):
        sums = collections.defaultdict(float)
        for r in out:
            sums[r[key]] += r.weight
        assert all(abs(sums[k] - n) <= 0.001 * n for k, n in want.items()) and len(sums) == len(want)


def test_diversity(spark):
    df = rows(spark).filter("label is not null")
    out = partitioning.split_diversity(df, "id", "label", 4, 0.5).collect()
    owned = collections.defaultdict(set)
    for r in out:
        owned[r.client_id].add(r.label)
    assert len(out) == df.count() and all(len(v) <= 4 for v in owned.values())


def test_by_id_and_grouped(spark):
    sizes = {"a": 93, "b": 137, "c": 195, "d": 136, "e": 439}
    data = [(k,) for k, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(data, "owner string")
    got = collections.Counter(r.client_id for r in partitioning.split_by_id(df, "owner").collect())
    assert sorted(got.values()) == [93, 136, 137, 195, 439] and sum(got.values()) == 1000
    top = partitioning.split_by_id(df, "owner", 2, "max").groupBy("client_id").count().collect()
    assert {r.client_id: r["count"] for r in top} == {0: 439, 1: 195}
    grouped = partitioning.split_grouped(df, "owner", 2).select("owner", "client_id").distinct()
    assert {r.owner: r.client_id for r in grouped.collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1}


def test_vertical():
    assert partitioning.vertical_sizes(6, 3, 0.0) == [2, 2, 2]
    assert partitioning.vertical_sizes(6, 3, 1.0) == [1, 1, 4]
    assert partitioning.vertical_sizes(2, 5) == [1, 1]


@pytest.mark.parametrize("p", [0.0, 0.2, 1.0])
def test_holdout(spark, p):
    out = partitioning.holdout(rows(spark), "id", p, local_test=True, within="label").collect()
    assert len(out) == 1000
    by = collections.defaultdict(collections.Counter)
    for r in out:
        by[r.label][r.part] += 1
    for c in by.values():
        n = sum(c.values())
        held = int(n * p)
        assert c["train"] == n - held and c["test"] == int(held * 0.5)


def test_ordered_positions(spark):
    df = rows(spark).withColumn("ts", F.col("id") % 10)
    got = sorted_positions(df, ["ts", "id"], ["label"]).collect()
    want = collections.defaultdict(list)
    for r in got:
        want[r.label].append((r.ts, r.id))
    for r in got:
        assert sorted(want[r.label])[r.pos] == (r.ts, r.id) and r.n == len(want[r.label])
    ids = {r.id: r.pos for r in id_positions(df, "id").collect()}
    assert ids == {i: i for i in range(1000)}


def test_sparse_ids(spark):
    rng = np.random.default_rng(5)
    own = sorted(int(x) for x in rng.integers(-(1 << 62), 1 << 62, 3000))
    df = spark.createDataFrame([(x,) for x in own], "id long").repartition(4)
    placed = id_positions(df, "id", total=None)
    assert {r.id: r.pos for r in placed.collect()} == {x: k for k, x in enumerate(own)}
    summed = prefix_weights(df, "id", F.lit(2))
    assert {r.id: (r.start, r.total) for r in summed.collect()} == {x: (2 * k, 6000) for k, x in enumerate(own)}


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(spark, inclusive):
    df = rows(spark, 300).withColumn("v", (F.col("id") * 7919 % 101).cast("double"))
    out = running(
        df, ["label"], "id",
        {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "c": ("count", F.col("v"))},
        inclusive, width=16,
    ).collect()
    groups = collections.defaultdict(list)
    for r in out:
        groups[r.label].append(r)
    assert len(out) == 300
    for g in groups.values():
        g.sort(key=lambda r: r.id)
        for i, r in enumerate(g):
            seen = [x.v for x in g[: i + inclusive]]
            assert (r.s or 0) == sum(seen) and r.c == len(seen)
            assert r.m == (max(seen) if seen else None)


def test_hier(spark):
    out = partitioning.split_hier(
        rows(spark).select("id"),
        lambda d: partitioning.split_iid(d, "id", 4, seed=1),
        lambda d, within: partitioning.split_iid(d, "id", 5, seed=2, within=within),
    ).collect()
    sizes = collections.Counter((r.edge_id, r.client_id) for r in out)
    assert len(sizes) == 20 and set(sizes.values()) == {50}


def test_links(spark):
    edges = spark.range(40).select((F.col("id") % 8).alias("src"), (F.col("id") % 5 + 10).alias("dst")).distinct()
    out = partitioning.split_links(edges, 0.1, 0.2).collect()
    pos = {(r.src, r.dst) for r in out if r.edge_label == 1}
    neg = {(r.src, r.dst) for r in out if r.edge_label == 0}
    assert len(pos) == 40 and not pos & neg and all(a != b for a, b in neg)


def test_communities(spark):
    pairs = [(a + o, b + o) for o in (0, 10, 20) for a in range(5) for b in range(a)]
    edges = spark.createDataFrame([*pairs, (4, 10)], "src long, dst long")
    got = graph.propagate_labels(edges, 4).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.community].add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(o, o + 5)) for o in (0, 10, 20)]
    placed = graph.split_communities(edges, 2, 4).collect()
    assert sorted(collections.Counter(r.client_id for r in placed).values()) == [5, 10]
    more = graph.split_communities(edges, 5, 4).collect()
    assert len({r.client_id for r in more}) == 5 and len(more) == 15


def test_packing_equals_greedy(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 9, 40)
    members = [(n, int(c)) for c, s in enumerate(sizes) for n in range(int(sizes[:c].sum()), int(sizes[: c + 1].sum()))]
    df = spark.createDataFrame(members, "node long, community long")
    got = {r.community: r.client_id for r in graph.pack_communities(df, 6).collect()}
    load = [0] * 6
    for c in sorted(range(40), key=lambda c: (sizes[c], c)):
        client = int(np.argmin(load))
        assert got[c] == client
        load[client] += int(sizes[c])


def test_sampling(spark):
    clients = spark.createDataFrame([(i, float(i + 1)) for i in range(10)], "client_id long, volume double")
    assert partitioning.sample_clients(clients).count() == 10
    picked = partitioning.sample_clients(clients, "uniform", 0.35).collect()
    assert len(picked) == len({r.client_id for r in picked}) == 3
    drawn = partitioning.sample_clients(clients, "volume", 1.0, n_all=10).collect()
    assert len(drawn) == 10 and all(0 <= r.client_id < 10 for r in drawn)
    assert partitioning.sample_clients(clients, "uniform", 0.01).count() == 1


def test_label_rounds_have_tasks_by_rows(spark, monkeypatch):
    """F7, F8: AQE put many rows of votes in one task, as they compress so well."""
    from quillmesh import session

    seen, write = [], session.written
    monkeypatch.setattr(graph, "written", lambda df: seen.append(spark.conf.get("spark.sql.shuffle.partitions")) or write(df))
    monkeypatch.setattr(session, "TASK_ROWS", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    edges = spark.createDataFrame([(i, i + 1) for i in range(2 * int(before) + 3)], "src long, dst long")
    graph.propagate_labels(edges, 2)
    assert seen[0] == before and {int(x) for x in seen[1:]} == {2 * int(before) + 3}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_links_deal_only_what_parts_take(spark, monkeypatch):
    """all drawn pairs were dealt four times, with nodes by join."""
    import hashlib

    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b) + 500) for a, b in rng.integers(0, 500, (600, 2))})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    sizes, write = [], partitioning.written

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(partitioning, "written", counted)
    out = partitioning.split_links(edges, 0.1, 0.2)
    got = {(r.src, r.dst, r.edge_label, r.part) for r in out.collect()}
    assert len(pairs) <= sizes[-1] < 2 * len(pairs)
    monkeypatch.setattr(partitioning, "NODES", 0)
    joined = partitioning.split_links(edges, 0.1, 0.2)
    assert got == {(r.src, r.dst, r.edge_label, r.part) for r in joined.collect()}

    def digest(*parts):
        return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()

    ids = sorted((digest(0, f"{a}-{b}")[:15], f"{a}-{b}", a, b) for a, b in pairs)
    n, val, test = len(ids), len(ids) // 10, len(ids) // 5
    part = {x[1]: "val" if i < val else "test" if i < val + test else "train" for i, x in enumerate(ids)}
    nodes = [x[1] for x in sorted((digest(0, v)[:15], v) for v in {v for p in pairs for v in p})]
    first = {}
    for _, key, _, _ in ids:
        for d in range(4):
            a, b = (nodes[int((int(digest(0, s, key, d)[:8], 16) + 0.5) / 2**32 * len(nodes))] for s in "ab")
            if a != b and (a, b) not in set(pairs):
                first[a, b] = min(first.get((a, b), (d, key, part[key])), (d, key, part[key]))
    want = {(a, b, 1, part[f"{a}-{b}"]) for a, b in pairs}
    for name, count in (("val", val), ("test", test), ("train", n - val - test)):
        own = sorted((digest(0, f"{a}-{b}")[:15], f"{a}-{b}", a, b) for (a, b), x in first.items() if x[2] == name)
        want |= {(a, b, 0, name) for _, _, a, b in own[:count]}
    assert got == want
