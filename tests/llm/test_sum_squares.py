import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmesh.llm import sum_squares
from quillmesh.llm.sum_squares import ByteCodec, pack_best_fit, place, plan_sequences, vocabulary_source

TEXTS = [
    None,
    "",
    " ",
    "Plain words, it's 12 o'clock.\n\n  indented\ttabs \r\n",
    "Grüße, 東京 \U0001f600 é   nbsp   wide",
    "a<|endoftext|>b <|endoftext|><|endoftext|> |endoftext|",
    "word " * 3000,
    "x" * 5000,
    "tie one",
    "tie one",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(vocabulary_source())


def brute_place(lengths, window):
    """Sum of squares computed anew for every open sequence."""
    gaps, out = [], []
    for s in lengths:
        best = None
        for i, g in enumerate(gaps):
            if g >= s:
                after = gaps.copy()
                after[i] = g - s
                total = sum(x * x for x in np.bincount([x for x in after if x], minlength=1))
                best = min(best or (total, g, -i), (total, g, -i))
        if best is None:
            gaps.append(window)
            best = (0, 0, 1 - len(gaps))
        i = -best[2]
        out.append((i, window - gaps[i]))
        gaps[i] -= s
    return out, len(gaps)


def test_codec_gives_the_ids_of_the_library(library):
    codec = ByteCodec(vocabulary_source())
    for text in [t for t in TEXTS if t is not None] + ["\n" * 30_000 + "x", "a" + " " * 15_000]:
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_where_tokens_end(library, monkeypatch):
    monkeypatch.setattr(sum_squares, "SLICE", 50)
    text = " ".join(["It's a line of 12 words, with  gaps\n and: marks"] * 40) + "é" * 300
    assert ByteCodec(vocabulary_source()).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_place_equals_brute_force():
    rng = np.random.default_rng(3)
    for window, n in ((20, 60), (64, 90), (7, 40)):
        lengths = np.sort(rng.integers(1, window, n))[::-1]
        sequence, offset, used = place(lengths, window)
        expected, n_expected = brute_place(lengths.tolist(), window)
        assert used == n_expected
        # Which of the sequences of one gap is taken does not change what is left open.
        got = sorted(np.bincount(sequence, lengths).tolist())
        assert got == sorted(np.bincount([i for i, _ in expected], lengths).tolist())
        assert sorted(offset.tolist()) == sorted(o for _, o in expected)


@pytest.mark.parametrize("planned", [1 << 18, 500, 37])
def test_plans_use_every_piece_once_and_waste_little(planned):
    rng = np.random.default_rng(5)
    hist = np.bincount(np.minimum(rng.geometric(1 / 40, 20_000), 127), minlength=128)
    plan = plan_sequences(hist, planned)
    filled, places = defaultdict(int), defaultdict(set)
    seen = np.zeros(128, int)
    for length, first, end, copies, at, base in plan.spans:
        for pos in range(first, end):
            item = at + (pos - first) // copies
            own = base + plan.sequence[item] + (pos - first) % copies
            filled[own] += length
            places[own].add((int(plan.offset[item]), length))
        seen[length] += end - first
    assert (seen == hist).all() and len(filled) == plan.sequences and max(filled.values()) <= 128
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    assert plan.sequences <= (1.01 if planned > 1000 else 1.06) * -(-int((hist * np.arange(128)).sum()) // 128) + 2


def check_pieces(rows, texts, library, window, end):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        own = sorted(by_doc.pop(doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert len(own) == -(-len(ids) // window)
        at = 0
        for r in own:
            assert r["start"] == at and 0 < r["length"] <= window
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == window for r in own[1:])
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return len(by_sequence)


def test_packing_of_odd_texts(spark, library):
    texts = dict(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, piece int, offset int")
    rows = pack_best_fit(docs, window=64).collect()
    used = check_pieces(rows, texts, library, 64, 2)
    assert used <= -(-sum(r["length"] for r in rows) // 64) + 1


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x"), (None, "x")], "doc_id long, text string")
    got = pack_best_fit(docs)
    assert got.count() == 4 and got.select("sequence_id", "offset").distinct().count() == 4
    assert got.filter("doc_id IS NULL").count() == 2
    empty = pack_best_fit(docs.limit(0))
    assert empty.count() == 0 and empty.schema.names == got.schema.names


def test_query_on_whole_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = sum_squares.op13(spark, folder)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", *["bigint"] * 5]
    rows = got.collect()
    used = check_pieces(rows, texts, library, 1024, 2)
    total = got.agg(F.sum("length")).first()[0]
    assert used <= 1.02 * -(-total // 1024) + 1
