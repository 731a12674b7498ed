import collections
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.operators import text_metrics as tm

words = st.lists(st.sampled_from("abcd"), max_size=30)


def table(a, b):
    lcs = np.zeros((len(a) + 1, len(b) + 1), int)
    ed = np.zeros((len(a) + 1, len(b) + 1), int)
    ed[:, 0], ed[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            lcs[i + 1, j + 1] = lcs[i, j] + 1 if x == y else max(lcs[i, j + 1], lcs[i + 1, j])
            ed[i + 1, j + 1] = min(ed[i, j] + (x != y), ed[i, j + 1] + 1, ed[i + 1, j] + 1)
    return lcs[-1, -1], ed[-1, -1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_alignment(a, b):
    lcs, ed = table(a, b)
    assert tm.lcs_length(a, b) == lcs
    assert tm.edit_distance(a, b) == ed
    assert len(tm._lcs_members(a, b)) == lcs


def pairs(spark):
    return spark.createDataFrame(
        [
            (1, "the cat sat", "the cat sat"),
            (2, "the the cat", "cat the mat on"),
            (3, "", "something"),
            (4, "x\ny z", "y z\nx"),
        ],
        "pair_id long, pred string, ref string",
    )


def by_id(df):
    return {r.pair_id: r for r in df.collect()}


def test_identical_texts(spark):
    one = by_id(tm.rouge_n(pairs(spark)))[1]
    assert one.rouge1_f1 == one.rouge2_f1 == 1.0
    assert by_id(tm.chrf(pairs(spark)))[1].chrf == 1.0
    assert by_id(tm.chrf(pairs(spark), 2))[1].chrf == 1.0
    assert by_id(tm.bleu(pairs(spark)))[1].bleu == 1.0
    assert abs(by_id(tm.meteor(pairs(spark)))[1].meteor - (1 - 0.5 / 27)) < 1e-12
    assert by_id(tm.wer(pairs(spark)))[1].wer == 0.0
    assert by_id(tm.rouge_l(pairs(spark)))[1].rougeL_f1 == 1.0


def test_partial_and_empty(spark):
    two = by_id(tm.rouge_n(pairs(spark)))[2]
    assert abs(two.rouge1_p - 2 / 3) < 1e-12 and two.rouge1_r == 0.5
    assert by_id(tm.wer(pairs(spark)))[2].wer == table("the the cat".split(), "cat the mat on".split())[1] / 4
    assert by_id(tm.rouge_l(pairs(spark)))[2].rougeL_r == 0.25
    for name, df in (("bleu", tm.bleu), ("chrf", tm.chrf), ("meteor", tm.meteor)):
        assert by_id(df(pairs(spark)))[3][name] == 0.0
    assert by_id(tm.wer(pairs(spark)))[3].wer == 1.0
    lsum = by_id(tm.rouge_lsum(pairs(spark)))[4]
    assert lsum.rougeLsum_f1 == 1.0
    assert by_id(tm.rouge_l(pairs(spark)))[4].rougeL_f1 < 1.0


def test_perplexity(spark):
    df = spark.createDataFrame([(None,), (10.0,), (2000.0,), (float("nan"),)], "perplexity double")
    got = [(r.perplexity, r.too_large) for r in tm.clean_perplexity(df).collect()]
    assert got == [(50.0, False), (10.0, False), (0.0, True), (50.0, False)]


def test_lcs_members_of_long_lines():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = sorted(tm._lcs_members(a, b))
        assert len(got) == tm.lcs_length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)
    a, b = ([rng.randint(0, 3000) for _ in range(20_000)] for _ in range(2))
    assert len(tm._lcs_members(a, b)) == tm.lcs_length(a, b)


lines = st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é", "𝄞"]), max_size=9), max_size=3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(lines, lines), min_size=1, max_size=4), st.booleans())
def test_clipped_matches(rows, chars):
    def grams(texts, n):
        return collections.Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))

    if chars:
        rows = [[["".join(t) for t in side] for side in row] for row in rows]
    kind = pa.list_(pa.string() if chars else pa.list_(pa.string()))
    got = tm.clipped_matches(*[pa.array([row[i] for row in rows], kind) for i in (0, 1)], 6)
    for k, (p, r) in enumerate(rows):
        for n in range(1, 7):
            a, b = grams(p, n), grams(r, n)
            assert got[:, n - 1, k].tolist() == [(a & b).total(), a.total(), b.total()]


def test_grams_of_many_tokens_are_numbered_anew():
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.permutation(np.arange(0x4E00, 0x9E00))))
    p, r = pa.array([[text]]), pa.array([[text[::-1], text + "x"]])
    got = tm.clipped_matches(p, r, 6)[0, :, 0]
    assert got.tolist() == [len(text), *[len(text) - n + 1 for n in range(2, 7)]]


def test_grams_are_no_rows(spark):
    """every n-gram was a row of an aggregation."""
    for df in (tm.chrf(pairs(spark), 2), tm.chrf(pairs(spark)), tm.rouge_n(pairs(spark)), tm.bleu(pairs(spark))):
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    twice = pairs(spark).union(pairs(spark)).filter("pair_id = 2")
    assert [r.chrf for r in tm.chrf(twice).collect()] == [by_id(tm.chrf(pairs(spark)))[2].chrf] * 2
