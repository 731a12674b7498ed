from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmesh.llm import language_id as L


def brute(text, dim=L.DIM, n=L.N):
    table, letters = L._symbol_table(), L._letter_vectors(dim, n)
    s = [0]
    for c in (text or "").lower() + "\n":
        k = int(table[ord(c)])
        if k or s[-1]:
            s.append(k)
    out = np.zeros(dim)
    for i in range(len(s) - n + 1):
        v = np.ones(dim)
        for k in range(n):
            v = v * letters[k][s[i + k]]
        out += v
    return out if any(s) else np.zeros(dim)


def test_vectors(monkeypatch):
    texts = ["Ab c", "", None, "été ÊTRE", "漢字 кот", "\x00a\x00", "123 .", "x" * 500, "word " * 50]
    for size in (1 << 20, 8):
        got = np.zeros((len(texts), L.DIM))
        monkeypatch.setattr(L, "slices", lambda c, s=size: __import__("quillmesh.llm.common", fromlist=["slices"]).slices(c, s))
        for first, v, lettered in L.text_vectors(pa.array(texts)):
            got[first : first + len(v)] = v
            assert [bool(x) for x in lettered] == [any(c.isalpha() for c in t or "") for t in texts[first : first + len(v)]]
        for t, v in zip(texts, got):
            assert np.array_equal(v, brute(t)), t


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (2, None, "fr"), (None, "...", None), (3, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    model = L.fit_languages(docs)
    assert model[0] == ["en", "fr"]
    got = Counter((r.doc_id, r.lang_pred) for r in L.predict_languages(docs, model).collect())
    assert got == Counter([(1, "en"), (2, "fr"), (2, "und"), (None, "und"), (3, "und")])
    nothing = L.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in L.predict_languages(docs, nothing).collect()} == {"und"}
    assert L.predict_languages(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.op9(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    rows = out.filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    assert np.mean([r.lang == r.lang_pred for r in rows if r.n > 200]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
