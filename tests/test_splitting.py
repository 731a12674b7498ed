import re

import numpy as np
import pytest

from quillmesh.operators.splitting import chunk_recursive, chunk_sentences, fold_units

SPACE = " \t\n\r\f"


def brute_fold(lengths, size, overlap):
    """Unit by unit: close a chunk when the next does not fit, go back for the overlap."""
    out, first, run = [], 0, [0] * len(lengths)
    for i, n in enumerate(lengths):
        run[i] = run[i - 1] + (n < 0) if i else 0
    n = [abs(x) for x in lengths]
    while first < len(n):
        last = first
        while last + 1 < len(n) and run[last + 1] == run[first] and sum(n[first : last + 2]) <= size:
            last += 1
        out.append((first, last - first + 1, sum(n[first : last + 1])))
        follows = last + 1
        if follows < len(n) and run[follows] == run[first]:
            back = follows
            while back - 1 > first and sum(n[back - 1 : follows]) <= overlap and sum(n[back - 1 : follows + 1]) <= size:
                back -= 1
            first = back
        else:
            first = follows
    return out


def test_fold_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        size = int(rng.integers(2, 20))
        overlap = int(rng.integers(0, size))
        lengths = rng.integers(1, size + 1, int(rng.integers(0, 30))) * rng.choice([1, 1, 1, -1], 1)
        lengths = np.where(rng.random(len(lengths)) < 0.2, -np.abs(lengths), np.abs(lengths))
        assert fold_units(lengths, size, overlap) == brute_fold(lengths.tolist(), size, overlap)


def brute_recursive(text, size, overlap, separators):
    """Textbook recursion: split, merge the short ones, recurse into the long ones."""
    if len(text) <= size:
        return [text]
    if not separators:
        return [text[s : s + size] for s in range(0, max(len(text) - 1 - overlap, 0) + 1, size - overlap)]
    first, rest = separators[0], separators[1:]
    parts = text.split(first)
    parts = [p for p in [parts[0], *(first + p for p in parts[1:])] if p]
    out, short = [], []

    def flush():
        for a, n, _ in brute_fold([len(p) for p in short], size, overlap):
            out.append("".join(short[a : a + n]))
        short.clear()

    for p in parts:
        if len(p) <= size:
            short.append(p)
        else:
            flush()
            out.extend(brute_recursive(p, size, overlap, rest))
    flush()
    return out


TEXTS = [
    None, "", "   \n ", "short", "a" * 95, "one two three. " * 20, "para one\n\npara two is longer than the other one\n\n\n\nthree",
    "x\n" * 60, "word " * 3 + "\n\n" + "y" * 200 + " tail\n" + "z " * 50, "\n\n" + "É" * 41 + "\n\nq", " " * 100 + "end",
]


@pytest.mark.parametrize("size,overlap", [(40, 10), (20, 0), (30, 15)])
def test_recursive_splitting_equals_brute_force(spark, size, overlap):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for r in chunk_recursive(docs, "doc_id", "text", size, overlap).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, text in enumerate(TEXTS):
        expected = [c.strip(SPACE) for c in brute_recursive(text, size, overlap, ["\n\n", "\n", " "])] if text else []
        assert got.get(i, []) == [c for c in expected if c], (i, text)


def test_sentence_chunks(spark):
    texts = ["One two. Three four five! Six. " * 4, "w " * 23 + "end. Next one.", None, "", " \n", "No end"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, pos int")
    got = {}
    for r in chunk_sentences(docs.select("doc_id", "text"), "doc_id", "text", 8, 3).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_tokens"]))
    for i, text in enumerate(texts):
        units = []
        for s in re.split(r"(?<=[.!?\n])\s+", text or ""):
            words = s.split()
            if words:
                units += [s.strip()] if len(words) <= 8 else [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
        folded = brute_fold([len(u.split()) for u in units], 8, 3)
        assert got.get(i, []) == [(" ".join(units[a : a + n]), total) for a, n, total in folded]
    assert max(n for own in got.values() for _, n in own) <= 8


def test_bad_sizes(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        chunk_sentences(docs, "doc_id", "text", 8, 8)
    with pytest.raises(ValueError):
        chunk_recursive(docs, "doc_id", "text", 8, 5)
