"""Registered queries against their SQL; QUILLMESH_FULL=1 runs all of them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
SAMPLE = [
    "privacy_sanitize", "privacy_pii_spans", "chunk_hierarchical", "search_federated_knn",
    "search_bm25", "fuse_merge_rrf_worst", "metric_retrieval", "split_diversity", "split_links",
    "runs_smooth", "feature_lm_sequences", "detect_average_precision", "stream_request_stats",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("QUILLMESH_FULL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr([plain(v) for v in (r[names.index(c)] for c in sorted(names))]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
