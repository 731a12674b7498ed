"""Best-fit packing of texts into windows of tokens by sums of squares.

Only texts longer than a window are cut, into full pieces behind a shorter first one.
Full pieces fill a sequence each. All others are placed largest first: among the open
sequences that have room, a piece goes to the residual gap for which the sum of the
squared counts of open sequences per gap becomes smallest; a sequence is opened where
none has room. Pieces of one length are alike, so the placing works on the histogram of
lengths, whose size does not grow with the data. Beyond ``PLANNED`` pieces, a placement
stands for several equal sequences, and what the division leaves is placed in the same
way. Pieces then take their places by position within their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.positions import sorted_positions
from quillmesh.llm.common import map_arrow, query, table, task_cache
from quillmesh.llm.store import stored

WINDOW = 1024
END = 2
#: Placements worked out one by one; with more pieces each stands for several.
PLANNED = 1 << 18
#: Characters that are encoded at once; longer texts are cut where tokens end anyway.
SLICE = 1 << 20
#: Runs of white space from which on the regular expression engine runs out of stack.
LONG_GAP = 10_000


def vocabulary_source(path: str | None = None) -> str:
    """The text of a byte-level BPE file of the tokenizers library."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


class ByteCodec:
    """Ids as the tokenizers library gives them, through tiktoken, which is faster.

    Strings of special tokens within a text become the special tokens, as there.
    """

    # Fixed value: the splitting pattern of byte-level BPE files.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, source: str):
        import json

        import tiktoken

        spec = json.loads(source)
        before = spec.get("pre_tokenizer") or {}
        known = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not known or spec.get("normalizer") or spec["model"].get("end_of_word_suffix"):
            raise ValueError("this vocabulary is of another kind")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(self.byte_characters())}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in w): i for w, i in vocab.items() if w not in self.special}
        self.fast = tiktoken.Encoding("quillmesh", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.gap = re.compile(r"\s{%d}" % LONG_GAP)
        self.border = re.compile(r"(?<=\S) (?=[A-Za-z])")
        self.source, self.library = source, None

    @staticmethod
    def byte_characters() -> list[str]:
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]

    def _plain(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens."""
        if self.gap.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.source)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def _blocks(self, text: str) -> Iterator[str]:
        """The text in runs of about ``SLICE`` characters, cut before a blank and a word."""
        at = 0
        while len(text) - at > SLICE:
            cut = self.border.search(text, at + SLICE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4"))
            else:
                out += [self._plain(block) for block in self._blocks(part)]
        return out[0] if len(out) == 1 else np.concatenate(out)


def cut_pieces(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", path: str | None = None,
    window: int = WINDOW, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """Pieces of every text with its end id: one, or full ones behind a shorter first.

    A null or empty text is the end id alone.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_source(path))  # one file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = task_cache("bytecodec:", lambda: ByteCodec(shared.value))
        for batch in batches:
            rows, piece, start, length, crc, held = [], [], [], [], [], []
            for row, text in enumerate(batch.column("_text")):
                ids = np.append(codec.encode(text.as_py() or ""), np.array([end], "<u4"))
                first = len(ids) % window or window
                cuts = [0, *range(first, len(ids) + 1, window)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        held.append(ids[a:b].astype(np.int32))
            cols = [batch.column("_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
            cols += [pa.array(c, pa.int64()) for c in (start, length, crc)]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    more = ", ids array<int>" if with_ids else ""
    schema = f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{more}"
    return map_arrow(docs.select(docs[row_id].alias("_id"), docs[text].alias("_text")), run, schema)


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each of some pieces shorter than a window, and the number
    of sequences. Pieces are taken in the given order.

    With ``open[g]`` sequences of gap ``g``, a piece of length ``s`` put into a gap ``g``
    changes the sum of squares by ``2 (open[g - s] - open[g] + 1)``, or by
    ``1 - 2 open[g]`` where it closes the sequence; full sequences do not count. Among
    equal changes the smallest gap, and of equal gaps the sequence opened last, is taken.
    """
    open_ = np.zeros(window, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(window)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i, s in enumerate(lengths.tolist()):
        left = np.flatnonzero(open_[s:])  # what would be left of the gaps with room
        if len(left):
            change = 2 * (open_[left] - open_[left + s] + 1)
            if left[0] == 0:
                change[0] = 1 - 2 * open_[s]
            k = int(left[change.argmin()])
            own = by_gap[k + s].pop()
            open_[k + s] -= 1
        else:
            own, k = used, window - s
            used += 1
        sequence[i], offset[i] = own, window - k - s
        if k:
            by_gap[k].append(own)
            open_[k] += 1
    return sequence, offset, used


@dataclass
class Plan:
    """``spans``: (length, first position, end, copies, first item, first sequence), and
    per item its sequence within the span's round and its offset."""

    spans: list[tuple[int, int, int, int, int, int]]
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_sequences(hist: np.ndarray, planned: int = PLANNED) -> Plan:
    """Places for ``hist[k]`` pieces of length ``k``, ``len(hist)`` being the window."""
    window, left = len(hist), hist.astype(np.int64).copy()
    taken = np.zeros(window, np.int64)
    spans, parts, items, sequences = [], [], 0, 0
    while left.any():
        # With more placements than lengths, some length has pieces for every copy.
        copies = -(-int(left.sum()) // max(planned, 4 * window))
        now = left // copies
        lengths = np.repeat(np.arange(window)[::-1], now[::-1])
        sequence, offset, used = place(lengths, window)
        parts.append((sequence * copies, offset))
        at = items
        for k in range(window - 1, 0, -1):
            if now[k]:
                spans.append((k, int(taken[k]), int(taken[k] + now[k] * copies), copies, at, sequences))
                at += int(now[k])
        taken += now * copies
        left -= now * copies
        items, sequences = at, sequences + used * copies
    flat = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2
    return Plan(spans, *flat, sequences)


def pack_best_fit(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", path: str | None = None,
    window: int = WINDOW, end: int = END, planned: int = PLANNED, with_ids: bool = False,
) -> DataFrame:
    """``row_id``, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Every id of every text lies in one piece, every piece in one sequence, whose pieces
    stand one behind the other from offset 0. Full pieces have negative sequence numbers,
    the others count from 0. Repeated rows are packed as often as they occur, null ids
    like others; a null or empty text is its end id; an empty table gives no pieces.
    Further columns of ``docs`` are ignored, whatever their names. Pieces (with
    ``with_ids`` their ids too) are stored in the checkpoint folder, since plan and
    placement both read them.
    """
    if window < 2:
        raise ValueError("a window holds two tokens at least")
    spark, names = docs.sparkSession, ["piece", "start", "length", "ids_crc32"]
    more = ["ids"] if with_ids else []
    cut = cut_pieces(docs, row_id, text, path, window, end, with_ids)
    pieces = stored(cut.withColumn("_row", F.monotonically_increasing_id()))
    hist = np.zeros(window, np.int64)
    rest = pieces.filter(F.col("length") < window)
    for r in rest.groupBy("length").count().collect():  # fewer rows than the window has tokens
        hist[r["length"]] = r["count"]
    plan = plan_sequences(hist, planned)
    # Both tables are bounded: window x rounds rows, and the planned placements.
    spans = spark.createDataFrame(plan.spans, "length bigint, _first bigint, _end bigint, _copies bigint, _at bigint, _base bigint")
    places = pa.table({"_item": np.arange(len(plan.offset)), "_seq": plan.sequence, "offset": plan.offset})
    places = spark.createDataFrame(places) if len(plan.offset) else spark.createDataFrame([], "_item bigint, _seq bigint, offset bigint")
    at = sorted_positions(rest.drop("_row"), ["_id", "start", "ids_crc32"], ["length"], "_pos", None)
    at = at.join(F.broadcast(spans), "length").filter("_first <= _pos AND _pos < _end")
    at = at.withColumn("_item", F.expr("_at + (_pos - _first) div _copies"))
    at = at.join(F.broadcast(places), "_item")
    number = F.expr("_base + _seq + (_pos - _first) % _copies").alias("sequence_id")
    placed = at.select("_id", *names, number, "offset", *more)
    full = pieces.filter(F.col("length") == window)
    full = full.select("_id", *names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *more)
    return placed.unionByName(full).select(F.col("_id").alias(row_id), *names, "sequence_id", "offset", *more)


@query("op13_best_fit")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens, cut only where they are longer."""
    return pack_best_fit(table(spark, sf_dir, "documents"))
