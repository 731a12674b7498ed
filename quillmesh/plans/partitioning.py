"""Federated split, hold-out and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import graph, modularity, partitioning
from quillmesh.plans.common import query
from quillmesh.session import tasks_by_rows, written


def sql_pos(src: str, key: str, part: str = "", seed: int = 0) -> str:
    over = f"PARTITION BY {part}" if part else ""
    return f"""(SELECT *, row_number() OVER ({over} ORDER BY md5('{seed}:' || {key}), {key}) - 1 AS pos, count(*) OVER ({over}) AS n FROM {src})"""


def sql_even(parts: str, pos: str = "pos", n: str = "n") -> str:
    return f"""CASE WHEN {pos} < ({n} % {parts}) * ({n} // {parts} + 1) THEN {pos} // ({n} // {parts} + 1)
ELSE {n} % {parts} + ({pos} - ({n} % {parts}) * ({n} // {parts} + 1)) // greatest({n} // {parts}, 1) END"""


def sql_normal(expr: str) -> str:
    """Box-Muller over the first 16 hex digits of an md5 expression."""
    u = "((('0x' || substr({h}, {i}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    u1, u2 = u.format(h=expr, i=1), u.format(h=expr, i=9)
    return f"(sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}))"


def sql_sizes(n: int, total: str, sigma: float, seed: int = 0) -> str:
    """CTEs ending in ``sizes(client_id, size, upto)``."""
    return f"""cl AS (SELECT i::BIGINT AS client_id, ({total})::BIGINT AS n, exp({sigma}::DOUBLE * {sql_normal(f"md5('{seed}:' || i)")}) AS w FROM range({n}) t(i)),
fl AS (SELECT *, w / sum(w) OVER () * n AS s FROM cl),
fr AS (SELECT *, floor(s)::BIGINT AS f, row_number() OVER (ORDER BY s - floor(s) DESC, client_id) AS r FROM fl),
sizes AS (SELECT client_id, size, sum(size) OVER (ORDER BY client_id) AS upto FROM (SELECT client_id, f + CASE WHEN r <= n - sum(f) OVER () THEN 1 ELSE 0 END AS size FROM fr))"""


@query(
    "split_client_sizes_equal",
    "WITH c AS (SELECT count(*) AS n FROM documents) SELECT i::BIGINT AS client_id, n // 7 + CASE WHEN i < n % 7 THEN 1 ELSE 0 END AS size FROM c, range(7) t(i)",
)
def sizes_equal(read):
    docs = read("documents")
    total = docs.agg(F.count(F.lit(1))).scalar()
    return partitioning.client_sizes(docs.sparkSession, 7, total)


@query(
    "split_client_sizes_lognormal",
    f"WITH {sql_sizes(20, 'SELECT count(*) FROM orders', 0.5)} SELECT client_id, size::BIGINT AS size FROM sizes",
)
def sizes_lognormal(read):
    orders = read("orders")
    total = orders.agg(F.count(F.lit(1))).scalar()
    return partitioning.client_sizes(orders.sparkSession, 20, total, 0.5)


@query(
    "split_iid",
    f"SELECT doc_id, {sql_even('10')} AS client_id FROM {sql_pos('documents', 'doc_id', seed=42)}",
)
def split_iid(read):
    return partitioning.split_iid(read("documents").select("doc_id"), "doc_id", 10, seed=42)


@query(
    "split_iid_imbalanced",
    f"""WITH {sql_sizes(20, 'SELECT count(*) FROM orders', 0.5, 3)}
SELECT o_orderkey, count(upto)::BIGINT AS client_id FROM {sql_pos("(SELECT o_orderkey FROM orders)", "o_orderkey", seed=3)} p LEFT JOIN sizes ON upto <= pos GROUP BY o_orderkey""",
)
def split_iid_imbalanced(read):
    rows = read("orders").select("o_orderkey")
    return partitioning.split_iid(rows, "o_orderkey", 20, 0.5, 3)


@query("split_dirichlet")
def split_dirichlet(read):
    rows = read("orders").select("o_orderkey", "o_orderpriority")
    return partitioning.split_dirichlet(rows, "o_orderkey", "o_orderpriority", 10, 0.5, seed=1)


@query(
    "split_dirichlet_totals",
    "SELECT o_orderpriority, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids, 0::BIGINT AS n_unassigned FROM orders GROUP BY ALL",
)
def split_dirichlet_totals(read):
    """Every row of every label lands on exactly one client."""
    rows = split_dirichlet(read)
    return rows.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("o_orderkey").alias("n_ids"),
        F.count_if(F.col("client_id").isNull() | ~F.col("client_id").between(0, 9)).alias("n_unassigned"),
    )


@query(
    "split_dirichlet_sizes",
    "SELECT i AS client_id, n // 10 + (i < n % 10)::BIGINT AS n_rows FROM range(10) r(i), (SELECT count(*) AS n FROM orders)",
)
def split_dirichlet_sizes(read):
    """Clients get their sizes exactly, whatever their label mix."""
    return split_dirichlet(read).groupBy("client_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "split_diversity",
    f"""WITH lab AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS kk FROM (SELECT DISTINCT source FROM documents)),
own AS (SELECT source, k, i, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS turn, count(*) OVER (PARTITION BY source) AS t FROM lab, range(8) r(i)
  WHERE ((k - i * greatest(floor(0.3::DOUBLE * kk), 1)::BIGINT) % kk + kk) % kk < greatest(floor(0.3::DOUBLE * kk), 1)),
p AS (SELECT p.*, t FROM {sql_pos("(SELECT doc_id, source FROM documents)", "doc_id", "source")} p LEFT JOIN (SELECT DISTINCT source, t FROM own) USING (source))
SELECT p.doc_id, p.source, own.i::BIGINT AS client_id FROM p LEFT JOIN own ON own.source = p.source AND own.turn = {sql_even("own.t")}""",
)
def split_diversity(read):
    rows = read("documents").select("doc_id", "source")
    return partitioning.split_diversity(rows, "doc_id", "source", 8, 0.3)


@query(
    "split_diversity_full",
    f"SELECT doc_id, lang, {sql_even('6')} AS client_id FROM {sql_pos('(SELECT doc_id, lang FROM documents)', 'doc_id', 'lang')}",
)
def split_diversity_full(read):
    rows = read("documents").select("doc_id", "lang")
    return partitioning.split_diversity(rows, "doc_id", "lang", 6, 1.0)


@query(
    "split_perturb",
    f"""WITH p AS (SELECT c_custkey, c_acctbal, {sql_even('5')} AS client_id FROM {sql_pos('customer', 'c_custkey')})
SELECT c_custkey, client_id, round(c_acctbal + 0.1::DOUBLE * {sql_normal("md5('0:mean:c_acctbal:' || client_id)")} + 0.1::DOUBLE * {sql_normal("md5('0:row:c_acctbal:' || c_custkey)")}, 6) AS c_acctbal FROM p""",
)
def perturb(read):
    rows = read("customer").select("c_custkey", "c_acctbal")
    out = partitioning.perturb(rows, "c_custkey", ["c_acctbal"], 5)
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query(
    "split_by_id_all",
    f"SELECT doc_id, source, pos AS client_id FROM documents JOIN {sql_pos('(SELECT DISTINCT source FROM documents)', 'source')} USING (source)",
)
def split_by_id(read):
    return partitioning.split_by_id(read("documents").select("doc_id", "source"), "source")


def _sql_by_size(order: str) -> str:
    return f"""WITH c AS (SELECT source, row_number() OVER (ORDER BY {order}) - 1 AS client_id FROM (SELECT source, count(*) AS c FROM documents GROUP BY ALL))
SELECT doc_id, source, client_id FROM documents JOIN c USING (source) WHERE client_id < 5"""


@query("split_by_id_max", _sql_by_size("c DESC, source"))
def split_by_id_max(read):
    rows = read("documents").select("doc_id", "source")
    return partitioning.split_by_id(rows, "source", 5, "max")


@query("split_by_id_min", _sql_by_size("c, source"))
def split_by_id_min(read):
    rows = read("documents").select("doc_id", "source")
    return partitioning.split_by_id(rows, "source", 5, "min")


@query("split_by_id_random", _sql_by_size("md5('0:' || source), source"))
def split_by_id_random(read):
    rows = read("documents").select("doc_id", "source")
    return partitioning.split_by_id(rows, "source", 5, "random")


@query(
    "split_grouped",
    """WITH k AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, k // greatest(1, ceil(n / 7.0))::BIGINT AS client_id FROM documents JOIN k USING (source)""",
)
def split_grouped(read):
    return partitioning.split_grouped(read("documents").select("doc_id", "source"), "source", 7)


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "split_vertical",
    """SELECT l_orderkey, l_linenumber, 0 AS party, ROUND(l_quantity, 6) AS total, l_returnflag AS label FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 1, round(l_extendedprice + l_discount + l_tax, 6), NULL FROM lineitem""",
)
def split_vertical(read):
    rows = read("lineitem").withColumn("row", F.struct("l_orderkey", "l_linenumber"))
    parties = partitioning.split_vertical(rows, "row", _FEATURES, 2, 1.0, "l_returnflag")
    out = None
    for party, held in enumerate(parties):
        total = F.lit(0.0)
        for c in _FEATURES:
            if c in held.columns:
                total = total + F.col(c)
        label = F.col("l_returnflag") if "l_returnflag" in held.columns else F.lit(None)
        part = held.select(
            "row.*",
            F.lit(party).alias("party"),
            F.round(total, 6).alias("total"),
            label.cast("string").alias("label"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "split_hierarchical",
    f"""WITH e AS (SELECT o_orderkey, {sql_even('5')} AS edge_id FROM {sql_pos('orders', 'o_orderkey', seed=1)})
SELECT o_orderkey, edge_id, {sql_even('4')} AS client_id FROM {sql_pos('e', 'o_orderkey', 'edge_id', 2)}""",
)
def split_hier(read):
    return partitioning.split_hier(
        read("orders").select("o_orderkey"),
        lambda d: partitioning.split_iid(d, "o_orderkey", 5, seed=1),
        lambda d, within: partitioning.split_iid(d, "o_orderkey", 4, seed=2, within=within),
    )


_PART = """CASE WHEN pos < n - floor(n * {p}::DOUBLE)::BIGINT THEN 'train' WHEN pos < n - {t} THEN 'val' ELSE 'test' END"""


@query(
    "holdout_global",
    f"SELECT o_orderkey, {_PART.format(p=0.2, t='0')} AS part FROM {sql_pos('orders', 'o_orderkey')}",
)
def holdout_global(read):
    return partitioning.holdout(read("orders").select("o_orderkey"), "o_orderkey", 0.2)


@query(
    "holdout_per_client",
    f"SELECT doc_id, source, {_PART.format(p=0.3, t='floor(floor(n * 0.3::DOUBLE) * 0.5::DOUBLE)::BIGINT')} AS part FROM {sql_pos('(SELECT doc_id, source FROM documents)', 'doc_id', 'source')}",
)
def holdout_per_client(read):
    rows = read("documents").select("doc_id", "source")
    return partitioning.holdout(rows, "doc_id", 0.3, True, "source")


@query(
    "holdout_ordered_ts",
    f"""SELECT event_id, event_type, {_PART.format(p=0.2, t='0')} AS part FROM (SELECT *,
row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)""",
)
def holdout_ordered_ts(read):
    rows = read("events").select("event_id", "event_type", "ts")
    out = partitioning.holdout_ordered(rows, 0.2, order=["ts", "event_id"], within=["event_type"])
    return out.drop("ts")


@query(
    "holdout_ordered_id",
    f"SELECT o_orderkey, {_PART.format(p=0.2, t='0')} AS part FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)",
)
def holdout_ordered_id(read):
    return partitioning.holdout_ordered(read("orders").select("o_orderkey"), 0.2, "o_orderkey")


@query(
    "split_ratings",
    """SELECT event_id, user_id, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM (
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n > 10 AND n < 200""",
)
def split_ratings(read):
    rows = read("events").select("event_id", "user_id")
    return partitioning.split_ratings(rows, "user_id", ["event_id"], 10, 200)


@query(
    "split_random",
    f"SELECT l_orderkey, l_linenumber, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM {sql_pos('''(SELECT l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber AS k FROM lineitem)''', 'k')}",
)
def split_random(read):
    rows = read("lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k")
    )
    return partitioning.split_random(rows, "k").drop("k")


@query(
    "split_nodes",
    f"SELECT p_partkey, CASE WHEN pos < floor(n * 0.1::DOUBLE) THEN 'val' WHEN pos < floor(n * 0.1::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM {sql_pos('part', 'p_partkey')}",
)
def split_nodes(read):
    return partitioning.split_nodes(read("part").select("p_partkey"), "p_partkey", 0.1, 0.2)


@query(
    "split_graphs",
    f"SELECT conv_id, CASE WHEN pos < floor(n * 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM {sql_pos('(SELECT DISTINCT conv_id FROM conversations)', 'conv_id')}",
)
def split_graphs(read):
    graphs = read("conversations").select("conv_id").distinct()
    return partitioning.split_graphs(graphs, "conv_id", 0.25)


# Suppliers and parts share one node space: parts are shifted.
SQL_EDGES = "ed AS (SELECT DISTINCT l_suppkey AS src, 1000000000 + l_partkey AS dst FROM lineitem)"


def edges(read):
    return (
        read("lineitem")
        .select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000000).alias("dst"))
        .distinct()
    )


def stored_edges(read):
    """``edges``, made distinct in tasks of a bounded number of line items."""
    items = read("lineitem")
    with tasks_by_rows(items.sparkSession, items.count()):
        return written(edges(read))


_U = "(floor(((('0x' || substr(md5('0:{s}:' || id || ':' || d), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) * nn)::BIGINT)"


@query(
    "split_links",
    f"""WITH {SQL_EDGES}, k AS (SELECT *, src || '-' || dst AS id FROM ed),
sp AS (SELECT src, dst, id, CASE WHEN pos < floor(n * 0.1::DOUBLE) THEN 'val' WHEN pos < floor(n * 0.1::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM {sql_pos('k', 'id')}),
nodes AS (SELECT node, pos AS kx, n AS nn FROM {sql_pos("(SELECT src AS node FROM ed UNION SELECT dst FROM ed)", "node")}),
dr AS (SELECT part, id, d, {_U.format(s='a')} AS a, {_U.format(s='b')} AS b FROM sp, range(4) t(d), (SELECT max(nn) AS nn FROM nodes)),
pr AS (SELECT part, id, d, x.node AS src, y.node AS dst FROM dr JOIN nodes x ON x.kx = a JOIN nodes y ON y.kx = b WHERE x.node <> y.node),
fi AS (SELECT src, dst, part, src || '-' || dst AS nid FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY d, id, part) AS r FROM pr) f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.src = f.src AND ed.dst = f.dst)),
ng AS (SELECT f.src, f.dst, f.part FROM {sql_pos("fi", "nid", "part")} f JOIN (SELECT part, count(*) AS want FROM sp GROUP BY ALL) w ON w.part = f.part WHERE f.pos < w.want)
SELECT src, dst, 1 AS edge_label, part FROM sp UNION ALL SELECT src, dst, 0, part FROM ng""",
)
def split_links(read):
    return partitioning.split_links(edges(read), 0.1, 0.2)


def _sql_lpa(rounds: int) -> str:
    parts = [
        SQL_EDGES,
        "vo AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed UNION SELECT src, src FROM ed UNION SELECT dst, dst FROM ed)",
        "c0 AS (SELECT DISTINCT src AS node, src AS community FROM vo)",
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"""c{i} AS (SELECT node, community FROM (SELECT src AS node, community, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, community) AS r
FROM vo JOIN c{i - 1} ON node = dst GROUP BY src, community) WHERE r = 1)"""
        )
    return ", ".join(parts)


@query("graph_label_propagation", f"WITH {_sql_lpa(3)} SELECT node, community FROM c3")
def label_propagation(read):
    return graph.propagate_labels(stored_edges(read), 3)


@query(
    "graph_pack_communities",
    """WITH m AS (SELECT doc_id AS node, len(regexp_extract_all(text, '[.]'))::BIGINT AS community FROM documents),
s AS (SELECT community, (row_number() OVER (ORDER BY count(*), community) - 1) % 4 AS client_id FROM m GROUP BY community)
SELECT node, community, 0::BIGINT AS segment, client_id FROM m JOIN s USING (community)""",
)
def pack_communities(read):
    members = read("documents").select(
        F.col("doc_id").alias("node"), F.regexp_count("text", F.lit("[.]")).cast("long").alias("community")
    )
    return graph.pack_communities(members, 4)


@query(
    "graph_split_communities",
    f"""WITH {_sql_lpa(3)},
s AS (SELECT community, (row_number() OVER (ORDER BY count(*), community) - 1) % 4 AS client_id FROM c3 GROUP BY community)
SELECT node, community, 0::BIGINT AS segment, client_id FROM c3 JOIN s USING (community)""",
)
def split_communities(read):
    return graph.split_communities(stored_edges(read), 4, 3)


@query("graph_split_modularity")
def split_modularity(read):
    """Levels of local moving have no SQL; tests compare modularity and fixed points by brute force."""
    return modularity.split_modularity(edges(read), 4)


SQL_ASSIGN = f"{SQL_EDGES}, asg AS (SELECT node, node % 4 AS client_id FROM (SELECT src AS node FROM ed UNION SELECT dst FROM ed))"


def assign(read):
    return graph.map_node(graph.edge_nodes(edges(read)), "node", 4)


@query("graph_map_node", f"WITH {SQL_ASSIGN} SELECT node, client_id FROM asg")
def map_node(read):
    return assign(read)


@query(
    "graph_induced_subgraph",
    f"WITH {SQL_ASSIGN} SELECT src, dst, a.client_id FROM ed JOIN asg a ON a.node = src JOIN asg b ON b.node = dst WHERE a.client_id = b.client_id",
)
def induced(read):
    return graph.induced_subgraph(edges(read), assign(read))


@query(
    "graph_except_nodes",
    f"WITH {SQL_ASSIGN} SELECT node FROM asg WHERE node NOT IN (SELECT node FROM asg WHERE client_id = 3)",
)
def except_nodes(read):
    nodes = assign(read)
    return graph.except_nodes(nodes, nodes.filter("client_id = 3")).select("node")


@query(
    "graph_profile",
    f"""WITH {SQL_ASSIGN}, le AS (SELECT a.client_id, count(*) AS e FROM ed JOIN asg a ON a.node = src JOIN asg b ON b.node = dst WHERE a.client_id = b.client_id GROUP BY ALL),
pc AS (SELECT client_id, count(*) AS n, any_value(coalesce(e, 0)) AS e FROM asg LEFT JOIN le USING (client_id) GROUP BY ALL),
t AS (SELECT count(*) AS te FROM ed)
SELECT count(*) AS n_clients, sum(n)::BIGINT AS n_nodes, sum(e)::BIGINT AS kept_edges, round(stddev_pop(e), 6) AS std_edges, round(avg(2.0::DOUBLE * e / n), 6) AS mean_degree,
 round(stddev_pop(2.0::DOUBLE * e / n), 6) AS std_degree, any_value(te) AS n_edges, round((any_value(te) - sum(e))::DOUBLE / any_value(te), 6) AS edge_losing_rate, round(2.0::DOUBLE * any_value(te) / sum(n), 6) AS global_degree FROM pc, t""",
)
def graph_profile(read):
    out = graph.graph_profile(edges(read), assign(read))
    rounded = ["std_edges", "mean_degree", "std_degree", "edge_losing_rate", "global_degree"]
    return out.select(
        *[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in out.columns]
    )


@query(
    "graph_edges_between",
    f"WITH {SQL_ASSIGN} SELECT a.client_id AS client_from, b.client_id AS client_to, count(*) AS n_edges FROM ed JOIN asg a ON a.node = src JOIN asg b ON b.node = dst WHERE a.client_id <> b.client_id GROUP BY ALL",
)
def edges_between(read):
    return graph.edges_between(edges(read), assign(read))


@query(
    "split_profile",
    f"""WITH p AS (SELECT doc_id, lang, {sql_even('10')} AS client_id FROM {sql_pos('(SELECT doc_id, lang FROM documents)', 'doc_id')}),
s AS (SELECT client_id, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, client_id) AS size_rank FROM p GROUP BY client_id)
SELECT client_id, lang, count(*) AS n, any_value(size) AS size, any_value(size_rank) AS size_rank FROM p JOIN s USING (client_id) GROUP BY client_id, lang""",
)
def profile(read):
    rows = partitioning.split_iid(read("documents").select("doc_id", "lang"), "doc_id", 10)
    return partitioning.partition_profile(rows, "lang")


_SQL_CLIENTS = "cl AS (SELECT source AS client_id, count(*) AS volume FROM documents GROUP BY ALL)"


def _clients(read):
    return read("documents").groupBy(F.col("source").alias("client_id")).agg(
        F.count(F.lit(1)).alias("volume")
    )


@query(
    "sample_clients_uniform",
    f"WITH {_SQL_CLIENTS} SELECT client_id FROM cl ORDER BY md5('5:' || client_id), client_id LIMIT 6",
)
def sample_uniform(read):
    return partitioning.sample_clients(_clients(read), "uniform", 0.3, 5)


@query("sample_clients_full", f"WITH {_SQL_CLIENTS} SELECT client_id FROM cl")
def sample_full(read):
    return partitioning.sample_clients(_clients(read))


@query(
    "sample_clients_volume",
    f"""WITH {_SQL_CLIENTS}, cu AS (SELECT client_id, sum(volume) OVER (ORDER BY client_id) AS upto, sum(volume) OVER () AS t FROM cl),
dr AS (SELECT i AS draw, ((('0x' || substr(md5('5:' || i), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) AS u FROM range(10) r(i))
SELECT draw::BIGINT AS draw, min_by(client_id, upto) AS client_id FROM dr JOIN cu ON upto > u * t GROUP BY draw""",
)
def sample_volume(read):
    return partitioning.sample_clients(_clients(read), "volume", 0.5, 5)
