import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import suffix_dedup as S


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdé ñ") for _ in range(n))
    shared = [make(rng.randint(length // 2, 3 * length)) for _ in range(6)]
    texts = [None, "", "a" * (length - 1), "a" * length, "b" * (length + 1), "c" * (5 * length), "ab" * length, "xyz" * length]
    for _ in range(120):
        parts = [rng.choice([make(rng.randint(0, length)), rng.choice(shared), rng.choice(shared)[: rng.randint(0, 2 * length)]]) for _ in range(rng.randint(1, 5))]
        texts.append("".join(parts))
    base = make(6 * length)
    for _ in range(12):
        at = rng.randrange(len(base))
        texts.append(base[:at] + make(rng.randint(0, 3)) + base[at:])
    return texts


@pytest.mark.parametrize("seed, length, hot, size", [(0, 40, 4096, 1 << 18), (1, 40, 0, 1 << 18), (2, 30, 3, 256), (3, 400, 2, 1 << 12)])
def test_brute_force(spark, seed, length, hot, size, monkeypatch):
    monkeypatch.setattr(S, "SLICE", size)
    texts = corpus(seed, length)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs, length=length, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_odd_rows(spark):
    x, y = "x1y2" * 120, "q" * 390 + "é" * 40
    rows = [(1, x, "a"), (1, x, "b"), (None, y, "c"), (2, y[:-1] + "z", None), (3, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = S.remove_repeats(docs, carry=True)
    assert got.columns[:3] == ["doc_id", "text", "id"]
    want = brute([r[1] for r in rows], 400)
    assert Counter((r.doc_id, r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == Counter((i, n, *w) for (i, _, n), w in zip(rows, want))
    clash = S.remove_repeats(docs.withColumn("kept", F.lit(1)), carry=True)
    assert clash.columns[3:] == ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_"]
    left = {(r.doc_id, r.id): r.text for r in S.without_repeats(docs).collect()}
    assert left[None, "c"] == "\u00e9" and left[1, "a"] == "" and left[3, "d"] is None
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in S.op5(spark, "/root/testdata/sf0.001").collect()}
    assert [got[r.doc_id] for r in docs] == brute([r.text for r in docs], 400)


@pytest.mark.parametrize("same_id", [False, True])
def test_one_piece_per_context(spark, same_id, monkeypatch):
    """Before, every copy of a text sent its pieces to the task of an anchor that has another context."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(900))
    texts = [text] * 60 + [text[:430] + "#" + text[431:], text[:450] + "?" + text[450:]]
    rows = [(7 if same_id else i, t) for i, t in enumerate(texts[:60])] + [(100, texts[60]), (101, texts[61])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    real, most = S._compare_windows, []

    def compare(pieces, length, kind):
        most.append(pieces.groupBy("anchor").agg(F.count_distinct("place").alias("n")).agg(F.max("n")).first()[0])
        if not same_id:
            most.append(pieces.groupBy("anchor").count().agg(F.max("count")).first()[0])
        return real(pieces, length, kind)

    monkeypatch.setattr(S, "_compare_windows", compare)
    got = S.remove_repeats(docs, length=400).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, brute(texts, 400)))
    assert 1 < max(most) <= 3


@pytest.mark.parametrize("hot", [4096, 0])
def test_odd_length(spark, hot):
    """Strings that agree in all bytes but the last or the middle one stay."""
    length, rng = 31, random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = corpus(4, length)
    for _ in range(20):
        s = make(length)
        texts += [make(40) + s + "x" + make(40), make(40) + s[:-1] + "#" + make(40), make(40) + s[:15] + "#" + s[16:] + make(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs, length=length, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)
