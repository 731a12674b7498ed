import numpy as np
import pytest

from quillmesh import plans
from quillmesh.operators import retrieval
from quillmesh.operators.text_index import blocks_read, build_text_index, index_bm25, index_keywords, load_text_index


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        n = int(rng.integers(0, 40))
        text = " ".join(words[min(int(x), 299)] for x in rng.zipf(1.3, n))
        rows.append((i, text, ["a", "b", None][i % 3] if i % 5 else "a"))
    rows += [(1000 + i, rows[3][1], "b") for i in range(4)] + [(2000, None, "a"), (2001, "", None), (2002, "Ärger ärger", "c")]
    queries = [(i, " ".join(words[int(x)] for x in rng.integers(0, 300, 4)) + " w1") for i in range(20)]
    queries += [(50, "w1 w2 w3"), (51, "nothing here"), (52, None), (53, ""), (54, "ÄRGER w1"), (55, "w200 w250")]
    return (
        spark.createDataFrame(queries, "query_id long, text string"),
        spark.createDataFrame(rows, "doc_id long, text string, grp string").repartition(5),
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("within", [None, "grp"])
@pytest.mark.parametrize("block,part", [(128, 8192), (4, 32)])
def test_same_rows_as_the_scan(spark, tables, tmp_path, within, block, part):
    queries, corpus = tables
    index = build_text_index(corpus, str(tmp_path / "i"), within, block=block, part=part)
    if part == 32:
        assert index.lists.filter("parts > 1").count() > 0
    index = load_text_index(spark, str(tmp_path / "i"))
    for k in (1, 3, 1000):
        got = index_bm25(index, queries, k)
        want = retrieval.bm25(queries, corpus, k, within=within)
        assert got.columns == want.columns
        assert rows(got) == rows(want)
    assert rows(index_keywords(index, queries, 3)) == rows(retrieval.keyword_search(queries, corpus, 3, within=within))


def test_blocks_are_skipped(spark, tables, tmp_path):
    """Common words cannot make up for a rare one, so few of their blocks are read."""
    corpus = tables[1]
    index = build_text_index(corpus, str(tmp_path / "i"), block=4, part=16)
    queries = spark.createDataFrame([(i, f"w{60 + 4 * i} w0 w1 w2") for i in range(20)], "query_id long, text string")
    assert rows(index_bm25(index, queries, 1)) == rows(retrieval.bm25(queries, corpus, 1))
    use = [(r["n_blocks"], r["n_read"]) for r in blocks_read(index, queries, 1).collect()]
    assert all(read <= there for there, read in use)
    assert sum(read for _, read in use) < 0.7 * sum(there for there, _ in use)


def test_no_documents_and_no_queries(spark, tables, tmp_path):
    queries, corpus = tables
    empty = build_text_index(corpus.limit(0), str(tmp_path / "e"))
    assert index_bm25(empty, queries, 3).count() == 0 and index_keywords(empty, queries, 3).count() == 0
    index = build_text_index(corpus, str(tmp_path / "i"))
    assert index_bm25(index, queries.limit(0), 3).count() == 0


def test_blocks_of_a_list_in_parts(spark, tmp_path):
    """Lists that are cut into parts count the blocks that their documents fill."""
    docs = spark.range(9088).selectExpr("id AS doc_id", "'aa' AS text", "'s' AS source")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = plans.registered()["search_index_lists"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("aa", "s", 9088, 71)]
