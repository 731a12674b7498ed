import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quillmesh.llm import jaccard_join as J
from quillmesh.llm import store


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        for x in s if i is not None else ():
            by[x].append(k)
    shared = defaultdict(int)
    for own in by.values():
        for a in own:
            for b in own:
                if a < b:
                    shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((find(sets[a][0]), find(sets[b][0])))
            root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [[word() for _ in range(rng.choice([12, 40]))] for _ in range(4)]
    texts = []
    for family in range(14):
        base = [word() for _ in range(rng.choice([3, 5, 7, 30, 120, 260]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.5:
                at = rng.randrange(len(own) + 1)
                own[at:at] = rng.choice(passage)
            texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in own))
    for p in passage:
        texts += [" ".join(p), " ".join([*p, *rng.choice(passage)]), " ".join([word(), *p])]
    texts += [" ".join([*p[:-1], word()]) for p in passage for _ in range(6)]
    return [(i * 3 + 1, t) for i, t in enumerate(rng.sample(texts, len(texts)))]


@pytest.mark.parametrize("seed, frequent, block", [(0, 32, 150_000), (1, 2, 300), (2, 4, 40), (3, 1, 1)])
def test_brute_force(spark, seed, frequent, block):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_shingles int").repartition(3)
    got = J.near_duplicates(docs, frequent=frequent, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "b a"), (8, long), (9, long + " x"), (9, long + " x"), (9, "a"), (None, "a"), (12, "x\x0by z"), (0, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.near_duplicates(docs).collect()), key=str) == brute(rows)
    assert J.near_duplicates(docs.limit(0)).count() == 0
    stay = sorted((r.doc_id for r in J.one_of_each(docs).collect()), key=str)
    assert stay == sorted([0, 1, 2, 3, 4, 6, 7, None], key=str)


def test_prefix_bounds():
    for n in range(1, 400):
        for m in range(n, 500):
            if 100 * n < 80 * m:
                break
            assert J.surplus(n) <= min(J.longest(n), J.longest(m), J.need(n), J.need(m))
            assert J.surplus(m) <= min(J.longest(n), J.longest(m), J.need(n), J.need(m))


def test_sets_and_links():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 5, 900)]
    for s in sets:
        got = J.unpack_set(J.pack_set(s))
        assert (got == (s & np.uint64((1 << 48) - 1)).astype(np.int64)).all()
    a = [np.arange(10), np.arange(5, 12)]
    i, j = J.links(a, [np.arange(1, 10), np.arange(100)], columns=3)
    assert list(zip(i, j)) == [(0, 0)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    assert {tuple(r) for r in store.components(df).collect()} == want


def test_blocks_of_short_documents(spark):
    """Before, one block held all documents of one shingle, and a table of their number squared."""
    met = spark.range(9000).selectExpr("id", "1 AS n", "5L AS lo", "5L AS hi", "0 AS side")
    sides = J._blocks(met, J.BLOCK).groupBy("lo", "hi", "i", "j", "side").count()
    assert 0 < sides.agg({"count": "max"}).first()[0] < 1.2 * J.BLOCK_DOCS


def test_copies_stand_for_one(spark, monkeypatch):
    """A hot group of short copies is not compared pair by pair; near copies still meet it."""
    real = J.links

    def links(left, right, percent):
        assert len(left) * len(right) < 400
        return real(left, right, percent)

    monkeypatch.setattr(J, "links", links)
    near = "b1 b2 b3 b4 b5 b6 b7 b8 b9 c1 c2 c3 c4 c5"
    rows = [(k, "Page not found") for k in range(10, 500)] + [(k, near) for k in range(500, 700)]
    rows += [(5, near + " x"), (6, near + " x y"), (7, "page not"), (600, "page not found"), (3, "Page  NOT found")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.near_duplicates(docs).collect()), key=str) == brute(rows)
