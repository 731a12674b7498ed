import math

import pytest

from quillmesh.functions import ranking

CASES = [
    ([1, 2, 3], [2, 9]),
    ([2, 1], [1, 2]),
    ([], [1]),
    ([5, 5, 1], [5]),
    ([7, 8], []),
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, r, e) for i, (r, e) in enumerate(CASES)]
    df = spark.createDataFrame(
        data, "query_id long, retrieved array<bigint>, expected array<bigint>"
    )
    return ranking.retrieval_metrics(df).orderBy("query_id").collect(), df


def test_hand_values(rows):
    got = rows[0]
    first = got[0]
    assert abs(first.dcg - 0.6309297535714575) < 1e-12
    assert first.idcg == 1.0 and abs(first.ndcg - first.dcg) < 1e-12
    assert first.ref_map == 0.25 and first.f1 == 0.5
    assert first.gold_hit1 == 1.0 and first.mrr == 0.5
    assert got[1].ref_map == 1.25 and got[1].em == 1.0
    assert got[2].ref_map == 0.0 and got[2].f1 == 0.0
    assert abs(got[3].dcg - (1 + 1 / math.log2(3))) < 1e-12
    assert got[3].ndcg == 1.0
    assert got[4].em == 1.0 and got[4].f1 == 0.0


def test_hit_cuts_the_retrieved_list(rows):
    out = ranking.hit_metrics(rows[1], ks=(1, 3)).orderBy("query_id").collect()
    assert out[0].hit_1 == 0.0 and out[0].hit_3 == 1.0
    assert out[3].precision_3 == 0.5 and out[3].recall_3 == 1.0


def test_means_and_lists(spark, rows):
    means = ranking.metric_means(ranking.retrieval_metrics(rows[1])).first()
    assert means.n_queries == len(CASES)
    hits = spark.createDataFrame([(1, 2, 10), (1, 1, 20)], "query_id long, rank long, doc_id long")
    gold = spark.createDataFrame([(1, 20), (1, 5)], "query_id long, doc_id long")
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: r for r in ranking.ranked_lists(hits, gold, q).collect()}
    assert got[1].retrieved == [20, 10] and got[1].expected == [5, 20]
    assert got[2].retrieved == [] and got[2].expected == []
