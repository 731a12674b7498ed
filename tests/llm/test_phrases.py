import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmesh.llm import phrases
from quillmesh.llm.common import task_cache
from quillmesh.llm.phrases import collocations, split_words

FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", folded(text))]


def brute(rows, least, longest=5, first=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        own = counts.setdefault(lang, Counter())
        for words in pieces(text):
            total[lang] += len(words)
            for k in range(1, longest + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        some = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        inside = {(p[x:y], a) for p, a in some.items() for x in range(len(p)) for y in range(x + 1, len(p) + 1) if y - x < len(p)}
        scored = []
        for p, a in some.items():
            if (p, a) in inside:
                continue
            score, k = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


def corpus():
    rng = np.random.default_rng(2)
    words = ["the", "New", "york", "of", "Grüße", "東京", "a-b", "x1", "is", "Was", "tie", "eit"]
    rows = []
    for i in range(120):
        text = []
        for _ in range(int(rng.integers(1, 40))):
            w = words[min(int(rng.geometric(0.25)) - 1, len(words) - 1)]
            text.append({"New": "New York city hall"}.get(w, w))
            text.append(str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " \x0b", "\r\n", "\x0e"], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.02, 0.02, 0.02])))
        rows.append((i, ["en", "de", None][i % 3], "".join(text)))
    rows += [(200, "en", None), (201, "en", ""), (202, "en", " ;,. "), (None, "en", "new york city hall"), (None, "de", "new york city hall")]
    rows += [(7, "fr", "le mot juste")] * 12
    return rows


@pytest.mark.parametrize("sample", [2, 8, 10**9])
def test_phrases_equal_brute_force(spark, sample):
    """The last sample is empty, so that every length is found by an expansion pass."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for least, first in ((12, 2000), (5, 7)):
        got = result(collocations(docs, least=least, sample=sample, first=first))
        assert got == brute([r[1:] for r in rows], least, first=first)
        assert got


def test_products_over_64_bits_are_exact(spark):
    from pyspark.sql import functions as F

    n = 3_000_000_000_000
    over = F.expr(f"(cast({n}L AS decimal(15,0)) * cast({7 * n}L AS decimal(18,0)) * 1000) div (cast(3L AS decimal(18,0)) * cast({n}L AS decimal(18,0)))")
    assert spark.range(1).select(over.alias("x")).first()[0] == 1000 * n * 7 * n // (3 * n)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "en", "one two", 1, "x", 3) for i in range(4)], "doc_id long, lang string, text string, key int, code string, n int")
    got = result(collocations(docs, least=4))
    assert got == [("en", 1, "one two", 4, 4, 4, 8, 2000)]
    assert collocations(docs.limit(0)).count() == 0
    assert collocations(docs.withColumn("text", docs.text.substr(1, 0)), least=1).count() == 0


def test_long_texts_in_blocks(monkeypatch):
    text = folded("One two, three\tFour five. " * 40 + "z" * 500 + " six" * 30 + "é" * 90 + "z" * 500)
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = split_words(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(phrases, "BLOCK", 64)
    task_cache("other:", dict)  # the tables are made anew
    cut = split_words(raw, np.array([0, len(raw)]))
    for a, b in zip(whole[1:3], cut[1:3]):
        assert a.tolist() == b.tolist()
    assert [x.tobytes().decode() for x in (raw[b:e] for b, e in zip(*cut[1:3]))] == [w for p in pieces(text) for w in p]
    assert np.diff(cut[3]).astype(bool).tolist() == np.diff(whole[3]).astype(bool).tolist()
    hashes = {}
    for h, b, e in zip(cut[0].tolist(), *cut[1:3]):
        assert hashes.setdefault(raw[b:e].tobytes(), h) == h
    assert len(set(hashes.values())) == len(hashes)
    task_cache("other:", dict)


def test_texts_of_a_slice_do_not_meet():
    texts = ["a b", "", None, "c d.", ".e", "f"]
    batch = pa.RecordBatch.from_pydict({"_text": texts, "_lang": ["x"] * 6, "_bucket": pa.array(range(6), pa.int32())})
    (run,) = phrases.Grams.of(batch)
    assert run.row.tolist() == [0, 0, 3, 3, 4, 5]
    same = np.diff(run.piece) == 0
    assert same.tolist() == [True, False, True, False, False]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert result(phrases.op11(spark, folder)) == brute(rows, 100)
