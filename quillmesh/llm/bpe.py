"""BPE encoding and decoding of whole texts with a tokenizers vocabulary file.

Words are encoded many at a time: a matrix holds the part boundaries and part ids
of one word per row and, beside it, the rank of every adjacent pair. Each step
finds the smallest rank of every row, deletes that boundary and refreshes the two
ranks next to it, until no pair of a row can merge. Only words that the worker has
not met go through it.

Covers vocabularies of BPE with an end-of-word suffix over byte-level characters,
NFC, white space to a space, lower case, and no decoder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm.common import map_arrow, query, slices, table, task_cache, trim

NONE = np.int32(1 << 30)
#: Words of more bytes go through a heap, since scans are quadratic in the length.
SHORT_WORD = 64
#: Words of the newer of two generations that a worker remembers. When it is full it
#: becomes the older one, whose words come back as they are met.
CACHE_WORDS = 200_000
SLICE = 1 << 20
#: Words of a matrix: its arrays and their temporaries take some 40 bytes per word and byte.
BLOCK_WORDS = 4_000

# The characters for which Python's lower(), split() and tables agree with the
# library's on every version: all others take its normalizer and splitter.
_PLAIN = "\x00-\x1b\x20-įı-ſ‐-‧‰-⁞€"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _char_class(kind: str) -> str:
    """The plain characters of a Unicode category, as the inside of a class."""
    plain = re.compile(f"[{_PLAIN}]")
    chars = [c for c in map(chr, range(0x20AD)) if plain.match(c) and unicodedata.category(c)[0] == kind]
    return "".join(map(re.escape, chars))


class Codec:
    """Encoder and decoder for the text of one vocabulary file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if spec.get("decoder") or spec.get("post_processor") or not model.get("end_of_word_suffix"):
            raise ValueError("this vocabulary is of another kind")
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        chars = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        codes = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int32)
        names = [""] * size
        for name, i in [*vocab.items(), *special.items()]:
            names[i] = name
        self.names = [n.encode() for n in names]
        self.numbers = [str(i).encode() for i in range(size)]
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        letters, digits = _char_class("L"), _char_class("N")
        # The splitting pattern of the vocabulary file.
        self.pieces = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^\\s{letters}{digits}]+").findall
        self.odd = re.compile(f"[^{_PLAIN}]").search
        self.source, self.library = source, None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- merging ---------------------------------------------------------------

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = (left.astype(np.int64) << 20) | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_words(self, words: Sequence[bytes]) -> list[bytes]:
        """Token ids of every word (not empty), as the bytes of int32 numbers."""
        out: list = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(sizes > SHORT_WORD):
            out[i] = self._merge_long(words[i]).tobytes()
        short = np.flatnonzero(sizes <= SHORT_WORD)
        short = short[np.argsort(sizes[short], kind="stable")]
        for k in range(0, len(short), BLOCK_WORDS):
            own = short[k : k + BLOCK_WORDS].tolist()
            ids, _, at = self._merge_block([words[i] for i in own], sizes[own])
            raw, at = ids.tobytes(), (at * 4).tolist()
            for i, start, end in zip(own, at, at[1:]):
                out[i] = raw[start:end]
        return out

    def merge_word(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of one short word and the byte at which each starts."""
        ids, bounds, _ = self._merge_block([word], np.array([len(word)]))
        return ids, bounds

    def _merge_block(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part ids and boundaries of all words on end, and where each word's start."""
        m, width = len(words), int(sizes.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(m), sizes)
        col = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
        parts = np.full((m, width), -1, np.int32)
        parts[row, col] = self.inner[flat]
        parts[np.arange(m), sizes - 1] = self.final[flat[ends - 1]]
        bounds = np.broadcast_to(np.arange(width, dtype=np.int8), parts.shape)
        # One column more than there are pairs, so that a row always has a minimum.
        ranks = np.full((m, width), NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        left, live = sizes.copy(), np.arange(m)
        done: list[tuple[np.ndarray, ...]] = []
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            going = best < NONE
            if not going.all():
                over = ~going
                real = np.arange(parts.shape[1]) < left[over][:, None]
                done.append((live[over], left[over], parts[over][real], bounds[over][real]))
                parts, bounds, ranks = parts[going], bounds[going], ranks[going]
                left, live, at, best = left[going], live[going], at[going], best[going]
            if not len(live):
                break
            rows = np.arange(len(live))
            cols = np.arange(parts.shape[1] - 1)[None, :]
            # The boundary after `at` goes: what stands behind it moves up.
            stays = (cols <= at[:, None]) | np.zeros_like(cols, bool)
            parts = np.where(stays, parts[:, :-1], parts[:, 1:])
            bounds = np.where(stays, bounds[:, :-1], bounds[:, 1:])
            ranks = np.where(stays, ranks[:, :-1], ranks[:, 1:])
            parts[rows, at] = self.merged[best]
            left = left - 1
            follow = np.minimum(at + 1, parts.shape[1] - 1)
            fresh = self.pair_ranks(parts[rows, at], parts[rows, follow])
            ranks[rows, at] = np.where(follow > at, fresh, NONE)
            later = np.flatnonzero(at > 0)
            before = at[later] - 1
            ranks[later, before] = self.pair_ranks(parts[later, before], parts[later, before + 1])
        word = np.concatenate([d[0] for d in done])
        count = np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        source = np.cumsum(count) - count
        at = np.zeros(m + 1, np.int64)
        np.cumsum(count[order], out=at[1:])
        pick = np.arange(at[-1]) + np.repeat(source[order] - at[:-1], count[order])
        return np.concatenate([d[2] for d in done])[pick], np.concatenate([d[3] for d in done])[pick], at

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, by a heap over a linked list."""
        ids = self.inner[np.frombuffer(word, np.uint8)]
        ids[-1] = self.final[word[-1]]
        n = len(ids)
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(ranks[i]), int(i)) for i in np.flatnonzero(ranks < NONE)]
        heapq.heapify(heap)
        parts, follow, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        now = ranks.tolist() + [int(NONE)]

        def refresh(i: int) -> None:
            j = follow[i]
            now[i] = int(NONE)
            if j < n:
                r = int(self.pair_ranks(np.array([parts[i]]), np.array([parts[j]]))[0])
                now[i] = r
                if r < NONE:
                    heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r or parts[i] < 0:
                continue
            j = follow[i]
            parts[i], parts[j], now[j] = int(self.merged[r]), -1, int(NONE)
            follow[i] = follow[j]
            if follow[j] < n:
                before[follow[j]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        return np.array([p for p in parts if p >= 0], np.int32)

    # -- texts -----------------------------------------------------------------

    def _learn(self, words: list[str]) -> None:
        """Put words of plain, lower-case characters, and their pieces, into the cache."""
        known, older, mixed, wanted = self.words, self.older, [], set()
        for w in words:
            if w.isalpha():
                wanted.add(w)
            else:
                own = self.pieces(w)
                mixed.append((w, own))
                wanted.update(own)
        new = []
        for p in wanted:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        known.update(zip(new, self.merge_words([p.encode() for p in new])))
        for w, own in mixed:
            if len(own) > 1:
                known[w] = b"".join([known[p] for p in own])

    def _odd_text(self, text: str) -> bytes:
        """A text outside the plain characters, split by the library."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source)
        spelled = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        raw = [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in spelled if piece]
        return b"".join(self.merge_words(raw))

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Token ids (int32) of every text."""
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        out: list = [None] * len(texts)
        plain, where = [], []
        for i, text in enumerate(texts):
            if self.split_special is not None and "<|" in text and self.split_special.search(text):
                pieces = self.split_special.split(text)
                ids = [
                    np.array([self.special[p]], np.int32) if k % 2 else self.encode([p])[0]
                    for k, p in enumerate(pieces)
                ]
                out[i] = np.concatenate(ids)
            elif self.odd(text):
                out[i] = np.frombuffer(self._odd_text(text), np.int32)
            else:
                plain.append(text.lower().split())
                where.append(i)
        seen = set().union(*plain)
        words, older, new = self.words, self.older, []
        for w in seen.difference(words):
            if w in older:
                words[w] = older[w]
            else:
                new.append(w)
        self._learn(new)
        get = self.words.__getitem__
        for i, words in zip(where, plain):
            out[i] = np.frombuffer(b"".join(map(get, words)), np.int32)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: without a decoder, the tokens joined by a space."""
        return b" ".join(map(self.names.__getitem__, ids.tolist()))

    def decimal(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.numbers.__getitem__, ids.tolist()))


def codec_source(path: str | None = None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def worker_codec(source: str) -> Codec:
    def build() -> Codec:
        codec = Codec(source)
        trim()  # what parsing the file took
        return codec

    return task_cache(f"codec:{hash(source)}", build)


def encoded(batch: pa.Array, source: str) -> Iterator[tuple[int, np.ndarray, Codec]]:
    """Yield (row, token ids, codec) for every row of a text column."""
    codec = worker_codec(source)
    for first, last, data, starts in slices(batch, SLICE):
        raw = data.tobytes()
        texts = [raw[starts[i] : starts[i + 1]].decode() for i in range(last - first)]
        for i, ids in enumerate(codec.encode(texts)):
            yield first + i, ids, codec


def encode_documents(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """Token ids of every whole text and what they decode to.

    Returns ``row_id``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by a space),
    ``decoded_sha256`` and, with ``with_ids``, ``ids`` and ``decoded``. A null or empty
    text has no tokens and decodes to an empty text; repeated rows and null ids come
    back as they are. Nothing is shuffled; the vocabulary (a few MB) goes with the tasks.
    """
    spark = docs.sparkSession
    kind = docs.schema[row_id].dataType.simpleString()
    source = spark.sparkContext.broadcast(codec_source(path))
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own, back, ids_, decoded = [], [], [], [], []
            for _, ids, codec in encoded(batch.column("_text"), source.value):
                n.append(len(ids))
                own.append(hashlib.sha256(codec.decimal(ids)).hexdigest())
                spelled = codec.decode(ids)
                back.append(hashlib.sha256(spelled).hexdigest())
                if with_ids:
                    ids_.append(ids)
                    decoded.append(spelled.decode())
            cols = [batch.column("_id"), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())]
            names = [row_id, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids_, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{row_id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}"
    return map_arrow(docs.select(docs[row_id].alias("_id"), docs[text].alias("_text")), run, schema)


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of every document."""
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
