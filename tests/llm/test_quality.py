import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmesh.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


TEXTS = [
    None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 50, "A b\nA b\na b\n\n \n", "é # | <> é\x0b z",
    "one two three four five six seven eight nine ten eleven", "w" * 3000, "ab cd\n" * 400, "q r s t " * 3,
]


def test_base_counts(monkeypatch):
    big = "".join(f"w{i % 977} " for i in range(600_000))
    base, x = quality.document_stats(pa.array([*TEXTS, big]))
    assert [tuple(r) for r in base.tolist()] == [brute(t) for t in [*TEXTS, big]]
    assert np.isfinite(x).all()


def test_trees_learn_and_keep_signs():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.4) | (x[:, 1] > 0.8)).astype(float)
    flip = rng.random(3000) < 0.05
    trees = quality.fit_trees(x, np.where(flip, 1 - y, y), np.array([-1, 1, 0]))
    new = rng.random((2000, 3))
    want = (new[:, 0] < 0.4) | (new[:, 1] > 0.8)
    assert ((trees.score(new) > 0.5) == want).mean() > 0.95
    grid = np.tile(new[:200], (50, 1))
    grid[:, 0] = np.repeat(np.linspace(0, 1, 50), 200)
    assert (np.diff(trees.score(grid).reshape(50, 200), axis=0) <= 1e-12).all()


def test_no_labels_keep_all():
    trees = quality.fit_trees(np.zeros((0, 2)), np.zeros(0), np.zeros(2))
    assert (trees.score(np.zeros((4, 2))) == 0.5).all()


def test_documents(spark):
    rows = [(i, t, "src") for i, t in enumerate(TEXTS)] + [(3, "a", "src"), (None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (8, 1), (5, 0), (8, None), (99, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = Counter(tuple(r)[:6] for r in quality.judge_quality(docs, model).collect())
    assert got == Counter((i, *brute(t)) for i, t, _ in rows)
    out = quality.judge_quality(docs, model, carry=True)
    assert out.filter("base_failed and kept").count() == 0
    assert out.columns == ["doc_id", "text", "score", *quality.BASE, "base_failed", "score_", "kept"]
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.judge_quality(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = quality.fit_quality(docs, labels.filter(~held))
    out = quality.judge_quality(docs, model).join(labels.filter(held), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in out]) > 0.93


def test_repeated_ids_fit_alike_in_any_layout(spark):
    rows = [(i, "word " * (5 + i) + ("# " * k)) for i in range(30) for k in (0, 3, 9, 1, 7, 5)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    fits = []
    for rows_, parts in ((rows, 1), (rows[::-1], 7)):
        docs = spark.createDataFrame(rows_, "doc_id long, text string").repartition(parts)
        fits.append(quality.fit_quality(docs, labels, most=20))
    for a, b in zip(*(vars(f).values() for f in fits)):
        assert np.array_equal(a, b)
