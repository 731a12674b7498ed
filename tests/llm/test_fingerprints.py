import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillmesh.llm import common, shingles
from quillmesh.llm import fingerprints as P


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_shingle_hashes_are_sets():
    rng = random.Random(2)
    texts = [None, "", " ", "A b", "a B", "a b c d e", "É É", "x" * 400]
    texts += [" ".join(rng.choice("ab cd É ü x Y z".split()) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    texts.append(" ".join(f"w{i}" for i in range(500_000)))
    known = {}
    for size in (1 << 20, 64):
        for i, h in ((a, b) for a, b in _sets(texts, size)):
            want = shingle_set(texts[i])
            assert len(h) == len(want)
            if len(want) < 1000:
                known.setdefault(frozenset(want), tuple(h.tolist()))
                assert known[frozenset(want)] == tuple(h.tolist())
    assert len(set(known.values())) == len(known)


def _sets(texts, size):
    for first, last, data, starts in common.slices(pa.array(texts), size):
        h, at = shingles.shingle_hashes(*shingles.word_hashes(data, starts))
        for i in range(last - first):
            yield first + i, np.unique(h[at[i] : at[i + 1]])


def test_sketches():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[::2], rng.integers(0, 1 << 64, 500, dtype=np.uint64)]))
    ka, kb = P.sketch(a), P.sketch(b)
    true = len(np.intersect1d(a, b))
    assert abs(P.likeness(ka, kb) - true / len(np.union1d(a, b))) < 0.04
    assert abs(P.containment(kb, ka) - true / len(b)) < 0.04
    assert P.merge(P.to_text(ka), P.to_text(kb)) == P.to_text(P.sketch(np.union1d(a, b)))
    high = np.array([1 << 63, (1 << 63) + 5], np.uint64)
    assert P.to_text(P.sketch(high)) == "~8000000000000000" and P.merge("", "") == ""
    assert P.merge("~8000000000000001", "~8000000000000000") == "~8000000000000000"
    assert P.merge("~8000000000000001", "00000000000000ff") == "00000000000000ff"
    assert P.from_text(P.to_text(ka)).tolist() == ka.tolist()


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, t), (_, u) in zip(rows, [*rows[1:], *rows[:1]]):
        t, u = t or "", u or ""
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        s = [P.sketch(next(h for _, h in shingles.shingle_sets(pa.array([x])))) for x in (t, e, u)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), P.to_text(s[0]), P.to_text(s[1]), P.likeness(s[0], s[1]), P.likeness(s[0], s[2])))
    return out


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_successors(spark, buckets, monkeypatch):
    rng = random.Random(buckets)
    rows = [(i * 7 - 90, rng.choice([None, "", "Été à la mer " * 3, "漢字 a b c d e f g " * rng.randint(1, 9), f"n{i} " * 30])) for i in range(60)]
    rows[5] = (None, "a b c d e f g")
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n_chars string").repartition(5)
    plain = P.with_next
    monkeypatch.setattr(P, "with_next", lambda d, r, t: plain(d, r, t, buckets))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, P.compare_edited(docs).collect()), key=key) == brute(rows)


def test_few_rows(spark):
    one = spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in P.compare_edited(one).collect()] == brute([(3, "a b c d e f")])
    assert P.compare_edited(one.limit(0)).count() == 0
    twice = P.compare_edited(one.union(one)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    null = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert P.compare_edited(null).count() == 2
    assert P.fingerprint_documents(one).columns == ["doc_id", "n_chars", "fingerprint"]
    assert P.fingerprint_documents(one).collect()[0].n_chars == 11


def test_likeness_of_edited(spark):
    rows = P.op4(spark, "/root/testdata/sf0.001").collect()
    long = [r for r in rows if r.n_chars > 3000]
    assert long and 0.15 < np.mean([r.near_edited for r in long]) < 0.5
