import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillmesh.llm import packing
from quillmesh.llm.bpe import codec_source


def test_combinations():
    assert packing.combinations(4, 2) == [(4,), (3, 1), (2, 2)]
    assert all(sum(c) == 128 and len(c) <= 3 for c in packing.combinations(128, 3))


def test_nnls():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = packing.nnls(a, np.array([3.0, 0]))
    assert (x >= 0).all() and np.allclose(a @ x, [3, 0], atol=1e-3)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_all(seed):
    rng = np.random.default_rng(seed)
    hist = np.append(0, rng.integers(0, [5, 400, 3, 50_000][seed], 128))
    used = np.zeros(129, np.int64)
    for pattern, times in packing.plan_patterns(hist):
        assert sum(pattern) <= 128 and times > 0
        for k in pattern:
            used[k] += times
    assert (used == hist).all()
    assert packing.plan_patterns(np.zeros(129, np.int64)) == []


def check(rows, texts, window=2048):
    library = Tokenizer.from_str(codec_source())
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want)
    for i, own in got.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(want[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[i])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences), sum(map(len, want.values()))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    n, tokens = check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert tokens / (n * 2048) > 0.95


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a b", None: "x"}
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, length int")
    check(packing.pack_documents(docs).collect(), texts)
    again = packing.pack_documents(docs.union(docs), with_ids=True).collect()
    assert Counter((r.doc_id, r.start) for r in again) == Counter({(r.doc_id, r.start): 2 for r in again})
    assert sorted((r.sequence_id, r.offset) for r in again)[0] == (0, 0) and all(len(r.ids) == r.length for r in again)
    assert packing.pack_documents(docs.limit(0)).count() == 0
