import hashlib
import random

import pytest
from tokenizers import Tokenizer

from quillmesh.llm import bpe

SOURCE = bpe.codec_source()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(SOURCE)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(SOURCE)


def texts():
    rng = random.Random(5)
    odd = "é́ ﬁ İ ſ ΑΣ ς 漢字 кот 😀    \x1c\x85 ² ½ ª µ ß Ǆ ŉ 'S 'll ''s don't I'VE <|endoftext|> a<|startoftext|>b <| |>"
    pool = ["the", "Of", "erheouenst", "don't", "x1y22", "…", "—", "a_b", "###", "ÉÀ", "  ", "\n", "\t", *odd.split(" ")]
    out = ["", " ", "a", odd, "z" * 300, "ab" * 5000, "é" * 70, "'" * 90, "1234567890" * 9, "\x00\x01 \x1b"]
    out += ["".join(rng.choice(pool) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x24F), rng.randint(32, 126), rng.randint(0x2010, 0x20B0)])) for _ in range(80)) for _ in range(400)]
    return out


def test_equals_library(codec, library):
    own = texts()
    for text, ids in zip(own, codec.encode(own)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert codec.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_plain_characters_agree(codec, library):
    for c in map(chr, range(0x2100)):
        if not codec.odd(c):
            text = f"a{c}b {c}{c} {c}"
            assert codec.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, repr(c)


def test_boundaries(codec):
    ids, starts = codec.merge_word(b"international")
    assert starts[0] == 0 and len(ids) == len(starts)
    assert b"".join(codec.names[i] for i in ids) == b"international</w>"


def test_cache_overflow(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    small, own = bpe.Codec(SOURCE), texts()
    for k in range(0, len(own), 7):
        for text, ids in zip(own[k : k + 7], small.encode(own[k : k + 7])):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    own = texts()[:60]
    rows = [(i, t, "x") for i, t in enumerate(own)] + [(None, "again", "x"), (7, None, "x"), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode_documents(docs).drop("ids", "decoded").collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(docs.limit(0)).count() == 0
