"""Packing texts into windows of tokens by length patterns.

Texts are cut into whole windows and a rest. The rests' lengths, in bins, form a
histogram. Shallow combinations of bins that fill a window are the columns of a
non-negative least squares problem whose solution says how often to repeat each; the
rounded-down repeats are planned first, and what the histogram then still holds is
planned greedily, also as patterns with repeat counts. All of that works on the
histogram, whose size does not grow with the data. Pieces then look up their place in
the plan by their position within their bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions.positions import sorted_positions
from quillmesh.llm.bpe import codec_source, encoded
from quillmesh.llm.common import map_arrow, query, table
from quillmesh.session import cut_lineage

WINDOW = 2048
END = 1
#: Tokens of a bin of lengths, and pieces of a combination at most.
BIN = 16
DEPTH = 3


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Descending tuples of at most ``depth`` bins whose sum is ``units``."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], rest: int, most: int) -> None:
        if rest == 0:
            out.append(head)
            return
        left = depth - len(head)
        if left == 0:
            return
        for k in range(min(rest, most), (rest + left - 1) // left - 1, -1):
            extend((*head, k), rest - k, k)

    extend((), units, units)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Minimise |a x - b| over x >= 0 by accelerated projected gradients."""
    x = np.zeros(a.shape[1])
    if not b.any():
        return x
    gram, target = a.T @ a, a.T @ b
    v = np.random.default_rng(1).random(a.shape[1])
    for _ in range(30):
        v = gram @ v
        v /= np.linalg.norm(v)
    step = 1.0 / float(v @ gram @ v * 1.02)
    look, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(look - step * (gram @ look - target), 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_patterns(hist: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): bins per window, using up the histogram exactly.

    ``hist[k]`` counts pieces of bin ``k``, which takes ``k`` of ``len(hist) - 1`` units.
    """
    units = len(hist) - 1
    left = hist.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        for k in pattern:
            left[k] -= times
        plan.append((pattern, times))

    if left[units]:
        use((units,), int(left[units]))
    columns = [c for c in combinations(units, depth) if len(c) > 1 and all(left[k] for k in c)]
    if columns:
        a = np.zeros((units + 1, len(columns)))
        for j, c in enumerate(columns):
            for k in c:
                a[k, j] += 1
        scale = float(left.max())
        x = nnls(a, left / scale) * scale
        for j in np.argsort(-x, kind="stable"):
            c = columns[j]
            need = {k: c.count(k) for k in c}
            times = min([int(x[j]), *(int(left[k]) // n for k, n in need.items())])
            if times > 0:
                use(c, times)
    # The residual: the largest piece, then always the largest that still fits.
    while left.any():
        pattern, room = [], units
        need = np.zeros(units + 1, np.int64)
        while room:
            fits = np.flatnonzero(left[: room + 1] > need[: room + 1])
            if not len(fits):
                break
            k = int(fits[-1])
            pattern.append(k)
            need[k] += 1
            room -= k
        used = np.flatnonzero(need)
        use(tuple(pattern), int((left[used] // need[used]).min()))
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first position, end, first sequence, slot): where a bin's pieces go."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in plan:
        for slot, k in enumerate(pattern):
            at = taken.get(k, 0)
            out.append((k, at, at + times, sequence, slot))
            taken[k] = at + times
        sequence += times
    return out


def cut_documents(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", path: str | None = None,
    window: int = WINDOW, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``window`` tokens: all full but a text's last.

    A null or empty text is the end id alone.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    source = docs.sparkSession.sparkContext.broadcast(codec_source(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, length, crc, total, ids_ = [], [], [], [], [], []
            for row, ids, _ in encoded(batch.column("_text"), source.value):
                ids = np.append(ids, end).astype("<u4")
                for a in range(0, len(ids), window):
                    piece = ids[a : a + window]
                    rows.append(row)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        ids_.append(piece.astype(np.int32))
            cols = [batch.column("_id").take(pa.array(rows, pa.int64()))]
            cols += [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
            names = [row_id, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(ids_, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    more = ", ids array<int>" if with_ids else ""
    schema = f"`{row_id}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{more}"
    return map_arrow(docs.select(docs[row_id].alias("_id"), docs[text].alias("_text")), run, schema)


def pack_documents(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", path: str | None = None,
    window: int = WINDOW, bin_size: int = BIN, depth: int = DEPTH, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see ``cut_documents`` for the rest.

    Every id of every text lies in exactly one piece and every piece in one sequence,
    whose pieces stand one behind the other from offset 0. Repeated rows are packed as
    often as they occur, null ids like others; an empty table gives no pieces. Pieces
    are written to the checkpoint folder (with ``with_ids`` their ids too), since plan
    and placement both read them.
    """
    if window % bin_size:
        raise ValueError("bin_size must divide window")
    units = window // bin_size
    cut = cut_documents(docs, row_id, text, path, window, end, with_ids)
    # Stored, since the range partitioner's sample would encode all texts once more.
    pieces = cut_lineage(cut.withColumn("_bin", F.ceil(F.col("length") / bin_size).cast("int")))
    order = [row_id, "start", "ids_crc32", "doc_tokens"]
    placed = sorted_positions(pieces, order, ["_bin"], "_pos", None)
    hist = np.zeros(units + 1, np.int64)
    for r in pieces.groupBy("_bin").count().collect():  # at most units rows
        hist[r["_bin"]] = r["count"]
    slots = _slots(plan_patterns(hist, depth))
    spark = docs.sparkSession
    # One row of bounds per bin; the number of patterns depends on the units alone.
    by_bin: dict[int, list] = {}
    for k, first, last, sequence, slot in slots:
        by_bin.setdefault(k, []).append((first, sequence, slot))
    rows = [(k, *map(list, zip(*own))) for k, own in sorted(by_bin.items())]
    bounds = spark.createDataFrame(rows, "_bin int, _first array<bigint>, _seq array<bigint>, _slot array<int>")
    # The last bound that is not above the position, by halving.
    steps = max([len(r[1]) for r in rows], default=1).bit_length()
    joined = placed.join(F.broadcast(bounds), "_bin")
    low = F.lit(0)
    for k in range(steps, -1, -1):
        ahead = low + F.lit(1 << k)
        fits = (ahead < F.size("_first")) & (F.get(F.col("_first"), ahead) <= F.col("_pos"))
        joined = joined.withColumn("_low", F.when(fits, ahead).otherwise(low))
        low = F.col("_low")
    found = joined.select(
        *placed.columns,
        (F.get("_seq", F.col("_low")) + F.col("_pos") - F.get("_first", F.col("_low"))).alias("sequence_id"),
        F.get("_slot", F.col("_low")).alias("_slot"),
    )
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    more = ["ids"] if with_ids else []
    return found.select(row_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, *more)


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
