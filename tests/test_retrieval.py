import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import fusion, retrieval


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    corpus = rng.standard_normal((300, 8))
    corpus[50:60] = corpus[40:50]  # exact copies tie and are ordered by id
    return rng.standard_normal((12, 8)), corpus


def frames(spark, vectors):
    q, c = vectors
    queries = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, vector array<double>"
    )
    corpus = spark.createDataFrame(
        [(i, [float(x) for x in v], 0 if i % 3 else i % 4) for i, v in enumerate(c)],
        "doc_id long, vector array<double>, client_id int",
    ).repartition(5)
    return queries, corpus


def brute(q, c, k, metric, ids=None):
    ids = np.arange(len(c)) if ids is None else ids
    if metric == "cosine":
        s = (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None])
    else:
        s = -np.linalg.norm(q[:, None] - c[None], axis=2)
    out = {}
    for i, row in enumerate(np.round(s, 6)):
        order = sorted(range(len(row)), key=lambda j: (-row[j], ids[j]))[:k]
        out[i] = [int(ids[j]) for j in order]
    return out


def listed(hits, *keys):
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(tuple(r[k] for k in ("query_id", *keys)), []).append(r.doc_id)
    return got


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("limit", [100, 3])
def test_knn_is_exact(spark, vectors, metric, limit):
    queries, corpus = frames(spark, vectors)
    got = listed(retrieval.knn(queries, corpus, 7, metric, max_queries=limit))
    assert got == {(i,): v for i, v in brute(*vectors, 7, metric).items()}


def test_cells_split_hot_groups(spark, vectors):
    queries, corpus = frames(spark, vectors)
    from pyspark.sql import functions as F

    q, c = queries.withColumn("cell", F.lit(1)), corpus.withColumn("cell", F.lit(1))
    got = listed(retrieval.knn_cells(q, c, 5, cell_rows=20, cell_queries=4))
    assert got == {(i,): v for i, v in brute(*vectors, 5, "cosine").items()}


@pytest.mark.parametrize("limit", [100, 3])
def test_federated(spark, vectors, limit):
    queries, corpus = frames(spark, vectors)
    got = listed(
        retrieval.knn(queries, corpus, 4, within="client_id", max_queries=limit), "client_id"
    )
    client = np.array([0 if i % 3 else i % 4 for i in range(300)])
    for cl in range(4):
        ids = np.flatnonzero(client == cl)
        want = brute(vectors[0], vectors[1][ids], 4, "cosine", ids)
        for i, docs in want.items():
            assert got[(i, cl)] == docs


def test_lsh_and_tree_scores_are_exact(spark, vectors):
    queries, corpus = frames(spark, vectors)
    q, c = vectors
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(q) @ unit(c).T, 6)
    lsh = retrieval.knn_lsh(queries, corpus, 5, dim=8, bits=3, tables=6).collect()
    tree = retrieval.tree_search(queries, corpus, 5, branches=6, probes=6).collect()
    for r in lsh + tree:
        assert abs(r.score - sims[r.query_id, r.doc_id]) < 1e-9
    # All cells probed is the exact search.
    want = brute(q, c, 5, "cosine")
    assert listed(retrieval.tree_search(queries, corpus, 5, branches=6, probes=6)) == {
        (i,): v for i, v in want.items()
    }
    met = sum(r.doc_id in want[r.query_id] for r in lsh)
    assert met >= 0.7 * 5 * len(q)


DOCS = [
    (1, "red fox jumps"), (2, "red red wine"), (3, "lazy dog and fox"), (4, "Fox! fox? fox."),
    (5, ""), (6, "dog"), (7, "red fox jumps"),
]


@pytest.mark.parametrize("limit", [100, 0])
def test_term_search(spark, limit):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    q = spark.createDataFrame([(1, "red fox"), (2, "unknown"), (3, "dog dog")], "query_id long, text string")
    toks = {i: [w.strip("!?.").lower() for w in t.split()] for i, t in DOCS}
    n, avg = len(DOCS), sum(map(len, toks.values())) / len(DOCS)

    def score(terms, d):
        s = 0.0
        for t in terms:
            df = sum(t in x for x in toks.values())
            tf = toks[d].count(t)
            s += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (
                tf + 1.5 * (0.25 + 0.75 * len(toks[d]) / avg)
            ) if tf else 0
        return round(s, 6)

    got = retrieval.bm25(q, docs, 3, max_queries=limit).collect()
    for qid, terms in ((1, ["red", "fox"]), (3, ["dog", "dog"])):
        ranked = sorted((-score(terms, d), d) for d in toks if score(terms, d) > 0)[:3]
        mine = sorted((r.rank, r.doc_id, r.score) for r in got if r.query_id == qid)
        assert [(d, pytest.approx(-s, abs=2e-6)) for s, d in ranked] == [(d, s) for _, d, s in mine]
    assert not [r for r in got if r.query_id == 2]
    kw = listed(retrieval.keyword_search(q, docs, 10, max_queries=limit))
    assert kw[(1,)] == [1, 7, 2, 3, 4] and kw[(3,)] == [3, 6]


def test_merge_duplicates(spark):
    hits = spark.createDataFrame(
        [(1, 0, 10, 0.9, "a"), (1, 1, 11, 0.8, "b"), (1, 2, 12, 0.7, "a")],
        "query_id long, client_id int, doc_id long, score double, text string",
    )
    import hashlib

    h = {hashlib.sha256(t.encode()).hexdigest(): t for t in "ab"}
    worst = [h[r.text_hash] for r in fusion.merge_hits(hits, 5).orderBy("rank").collect()]
    best = [h[r.text_hash] for r in fusion.merge_hits(hits, 5, dup="best").orderBy("rank").collect()]
    plain = [h[r.text_hash] for r in fusion.merge_hits(hits, 5, 0).orderBy("rank").collect()]
    assert (worst, best, plain) == (["b", "a"], ["a", "b"], ["a", "b", "a"])


def test_ensemble(spark):
    df = spark.createDataFrame(
        [(1, 2, "x"), (1, 1, "y"), (1, 3, ""), (2, 1, "only"), (3, 1, None)],
        "query_id long, client_id int, answer string",
    )
    got = {r.query_id: r.answer for r in fusion.ensemble_answers(df).collect()}
    assert got == {1: "y | x", 2: "only"}


def test_reorder_and_pack(spark):
    hits = spark.createDataFrame(
        [(1, r, float(10 - r), f"w{r} z") for r in range(1, 6)],
        "query_id long, rank long, score double, text string",
    )
    order = [r.rank for r in fusion.long_context_reorder(hits).orderBy("position").collect()]
    listing = []
    for i, r in enumerate([5, 4, 3, 2, 1]):
        listing = [r, *listing] if i % 2 == 0 else [*listing, r]
    assert order == listing
    packed = fusion.pack_context(hits, "compact", 4).orderBy("prompt_no").collect()
    assert [r.text for r in packed] == ["w1 z w2 z", "w3 z w4 z", "w5 z"]
    assert fusion.pack_context(hits, "no_text").count() == 1
    assert fusion.pack_context(hits, "refine").count() == 5


def test_auto_merge(spark):
    chunks = spark.createDataFrame(
        [(i, 100 + i // 3) for i in range(6)] + [(100, None), (101, None)],
        "chunk_id long, parent_id long",
    )
    hits = spark.createDataFrame([(1, 0, 0.4), (1, 1, 0.8), (1, 3, 0.5)], "query_id long, chunk_id long, score double")
    got = {r.chunk_id: (r.score, r.merged) for r in fusion.auto_merge(hits, chunks).collect()}
    assert got == {100: (0.6, True), 3: (0.5, False)}


def test_contrastive(spark):
    rng = np.random.default_rng(0)
    q, r = rng.standard_normal((6, 4)), rng.standard_normal((6, 4))
    df = spark.createDataFrame(
        [(i // 3, i, q[i].tolist(), r[i].tolist()) for i in range(6)],
        "batch long, i long, q array<double>, r array<double>",
    )
    got = {x.batch_id: x.loss_ce for x in fusion.contrastive_eval(df, "batch", "i").collect()}
    for b in range(2):
        m = q[b * 3 : b * 3 + 3], r[b * 3 : b * 3 + 3]
        a, c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in m)
        s = a @ c.T
        want = np.mean([np.log(np.exp(s[i]).sum()) - s[i, i] for i in range(3)])
        assert abs(got[b] - want) < 1e-12


def test_summary_tree(spark):
    hits = [(1, k, " ".join(f"w{k}_{i}" for i in range(7))) for k in range(5)] + [(2, 0, "a b"), (3, 0, None), (4, 0, ""), (4, 1, " ")]
    df = spark.createDataFrame(hits, "query_id long, rank long, text string")
    first = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 3), " ")
    got = {(r.query_id, r.level, r.node): (r.parent, r.text) for r in fusion.summary_tree(df, first, 4).collect()}

    want, toks, level = {}, [t for q, _, x in hits if q == 1 for t in x.split()], 0
    while True:
        prompts = [toks[i : i + 4] for i in range(0, len(toks), 4)]
        for k, p in enumerate(prompts):
            start = sum(len(q[:3]) for q in prompts[:k])
            want[1, level, k] = (start // 4 if len(prompts) > 1 else None, " ".join(p))
        if len(prompts) == 1:
            break
        toks, level = [t for p in prompts for t in p[:3]], level + 1
    assert level > 2
    assert got == want | {(2, 0, 0): (None, "a b")}  # queries without a token have no prompt
    with pytest.raises(ValueError):
        fusion.summary_tree(df, lambda c: F.concat_ws(" ", c, c), 4).count()
    assert fusion.summary_tree(df.limit(0), first, 4).count() == 0


def test_term_search_works_on_bounded_parts(spark, monkeypatch):
    """Blocks of queries, slices of documents and one document beyond a slice: same rows."""
    texts = ["aa bb cc", "bb cc dd " * 40, None, "", "aa aa dd", "ee bb"] * 5
    corpus = spark.createDataFrame([(i, t, i % 3 or None) for i, t in enumerate(texts)], "doc_id long, text string, grp long")
    words = ["aa bb", "cc", "dd ee", "nothing", "bb bb ee", None]
    queries = spark.createDataFrame(list(enumerate(words)), "query_id long, text string")
    for within in (None, "grp"):
        want = sorted(map(str, retrieval.bm25(queries, corpus, 4, within=within).collect()))
        with monkeypatch.context() as m:
            for name, value in (("BLOCK_PAIRS", 3), ("BLOCK_CELLS", 4), ("SLICE_TERMS", 7), ("BATCH_ROWS", 2)):
                m.setattr(retrieval, name, value)
            assert sorted(map(str, retrieval.bm25(queries, corpus, 4, within=within).collect())) == want
            assert sorted(map(str, retrieval.bm25(queries, corpus, 4, within=within, max_queries=0).collect())) == want
    parts = pa.RecordBatch.from_pydict({"terms": [["a"] * n for n in (3, 3, 3, 9, 0, 1)]})
    monkeypatch.setattr(retrieval, "SLICE_TERMS", 7)
    assert [b.num_rows for b in retrieval.slices([parts])] == [2, 1, 1, 2]
