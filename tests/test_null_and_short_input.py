"""Both sides of every size switch on the same odd input, and splits with null keys."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import features, graph, partitioning, retrieval, routing


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, "a", "solar panel", [1.0, 0.0]), (2, None, "solar wind", [1.0, 0.1]), (3, None, "wind", [0.0, 1.0]),
        (4, "b", "solar", [1.0, 0.0]), (5, "a", "", [0.5, 0.5]), (6, "b", "solar panel", [1.0, 0.0]),
    ]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, vector array<double>").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "solar panel", [1.0, 0.0]), (2, "wind", [0.0, 1.0])], "query_id long, text string, vector array<double>")


@pytest.mark.parametrize("within", [None, "source", "client"])
@pytest.mark.parametrize("search", [retrieval.bm25, retrieval.keyword_search, retrieval.knn])
def test_paths_agree(queries, corpus, search, within):
    held = corpus.withColumn("client", F.when(F.col("source") == "a", 1).when(F.col("source") == "b", 2))
    few = search(queries, held, k=2, within=within)
    many = search(queries, held, k=2, within=within, max_queries=0)
    none = search(queries.limit(0), held, k=2, within=within)
    assert few.dtypes == many.dtypes == none.dtypes
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str)
    assert none.count() == 0 and few.count() > 0
    if within:
        assert None in {r[within] for r in few.collect()}


def test_one_cell_needs_no_join(queries, corpus):
    plan = retrieval.knn(queries, corpus, max_queries=0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_short_passages(spark, corpus):
    passages = spark.createDataFrame([(1, "solar panel"), (2, "wind"), (3, ""), (4, "no such"), (5, None)], "query_id long, text string")
    got = {tuple(r) for r in retrieval.passage_gold(passages, corpus).collect()}
    assert got == {(1, 1), (1, 6), (2, 2), (2, 3)}


def test_splits_are_complete(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "id long, label string")
    for out in (
        partitioning.split_dirichlet(df, "id", "label", 2, 0.5),
        partitioning.split_diversity(df, "id", "label", 2, 1.0),
        partitioning.split_by_id(df, "label"),
        partitioning.split_grouped(df, "label"),
    ):
        assert sorted(r["id"] for r in out.collect()) == [1, 2, 3, 4]
    assert features.reindex(df, "label").count() == 4


def test_packing_has_one_schema(spark):
    few = spark.createDataFrame([(1, "p"), (2, "p"), (3, None)], "node long, community string")
    many = spark.createDataFrame([(k, str(k)) for k in range(5)], "node long, community string")
    a, b = graph.pack_communities(few, 3), graph.pack_communities(many, 3)
    assert a.dtypes == b.dtypes and a.count() == 3 and len({r.client_id for r in a.collect()}) == 3


def test_slots_inside_values_stay(spark):
    df = spark.createDataFrame([("ask {context} now", "CTX")], "question string, context string")
    text = routing.render_template("{question} | {context} | {question}", {"question": "question", "context": "context"})
    assert df.select(text).first()[0] == "ask {context} now | CTX | ask {context} now"


@pytest.mark.parametrize("neg", [0.5, 1, 3.9, 6, 39])
@pytest.mark.parametrize("undirected", [False, True])
def test_links_have_all_negatives(spark, neg, undirected):
    chain = [(k, k + 1) for k in range(40)]
    edges = spark.createDataFrame(chain, "src long, dst long")
    if neg == 39 and undirected:
        with pytest.raises(ValueError):
            partitioning.split_links(edges, 0.2, 0.2, neg, undirected=True)
        return
    rows = partitioning.split_links(edges, 0.2, 0.2, neg, undirected=undirected).collect()
    for part in ("train", "test", "val"):
        own = [r for r in rows if r.part == part]
        positive = sum(r.edge_label for r in own)
        assert len(own) - positive == int(neg * positive)
    bad = {(r.src, r.dst) for r in rows if not r.edge_label}
    assert len(bad) == sum(1 - r.edge_label for r in rows) and not bad & set(chain) and all(a != b for a, b in bad)
    if undirected:
        assert not {(b, a) for a, b in bad} & (set(chain) | bad)


def test_links_of_a_full_graph(spark):
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(a)], "src long, dst long")
    rows = partitioning.split_links(edges, 0.2, 0.2).collect()
    assert sum(1 - r.edge_label for r in rows) == 15
    with pytest.raises(ValueError):
        partitioning.split_links(edges, 0.2, 0.2, undirected=True)
