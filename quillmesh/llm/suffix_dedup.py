"""Removal of long byte strings that occur more than once, by prefix doubling.

Positions are ranked by the strings that start there: first of half the threshold, then
of the whole, each longer rank being the pair of two shorter ones at that offset, and
positions whose rank is unique leave after every step. A row per byte would take some
ten times the text in every step's shuffle, so the first step ranks anchors only: of
the half strings inside each window of the threshold's length the one with the
smallest hash (the first on a tie). Equal windows have the same anchor at the same
offset, hence

1. Spark counts anchors (the half string's rank) together with the rank of the anchor's
   context, all bytes that a window around it can reach. Anchors that occur once leave.
2. Where a context occurs again, all of it goes.
3. Contexts that occur once though their anchor occurs again are compared by the ranks
   of their windows: dealt by anchor, sorted, and counted. Of each context that occurs
   often one takes part, in whatever number of copies of a text it is. An anchor with
   very many contexts deals out its windows one by one instead, so that it is no hot key.

Ranks are 64-bit hashes in place of consecutive numbers, which would need a sort of all
positions; ranks of equal strings are equal whatever the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import free_names, map_arrow, query, slices, table, task_cache
from quillmesh.llm.shingles import mix
from quillmesh.llm.store import is_member, membership, stored

LENGTH = 400
#: Contexts of an anchor beyond which its windows are dealt out one by one.
HOT = 32768
#: Text bytes ranked at once; small, so that the arrays stay in the processor's cache.
SLICE = 1 << 18
CHUNK = 4 << 20
_SEED = 8161


def _tables() -> dict:
    rng = np.random.default_rng(_SEED)
    base = int(rng.integers(1 << 62, 1 << 63)) | 1
    return {"values": rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1), "base": base,
            "inverse": pow(base, -1, 1 << 64), "n": 0}


def _powers(n: int) -> dict:
    t = task_cache("suffix:tables", _tables)
    if t["n"] < n:
        size = max(n, 2 * SLICE)
        for name in ("base", "inverse"):
            p = np.full(size, t[name], np.uint64)
            p[0] = 1
            t[f"{name}_pow"] = np.cumprod(p, dtype=np.uint64)
        t["n"] = size
    return t


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return best(x[:-rest], x[rest:]) if rest else x


class Ranks:
    """Ranks of one run of bytes that holds whole texts or a part of one."""

    def __init__(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
        """``first`` and ``last`` bound, per byte, the text that it is in."""
        self.half = length - length // 2  # the two halves of an odd length overlap
        self.width = length - self.half + 1
        self.length, self.first, self.last = length, first, last
        n = len(data)
        self.anchors = np.zeros(0, np.int64)
        if n < length:
            return
        t = _powers(n + 1)
        self.inverse = t["inverse_pow"]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(t["values"][data] * t["base_pow"][:n], out=self.sums[1:])
        k = self.half
        self.rank = mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: n - k + 1])
        least = _sliding(self.rank, self.width, np.minimum)
        inside = np.arange(len(least)) + length <= last[: len(least)]
        least = np.where(inside, least, np.uint64(0))
        self.least = least
        edge = np.zeros(self.width - 1, np.uint64)
        most = _sliding(np.concatenate([edge, least, edge]), self.width, np.maximum)
        self.anchors = np.flatnonzero((most == self.rank) & (most > 0))

    def span(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that windows around the anchors can reach."""
        return np.maximum(at - (self.width - 1), self.first[at]), np.minimum(at + self.length, self.last[at])

    def contexts(self, at: np.ndarray) -> np.ndarray:
        low, high = self.span(at)
        own = (self.sums[high] - self.sums[low]) * self.inverse[low]
        own += (at - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own += (high - at).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return mix(own)

    def owned(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 of the windows whose anchor each chosen one (an index) is; may be none."""
        at = self.anchors
        order = np.lexsort((at, self.rank[at]))
        before = np.full(len(at), -1)
        same = self.rank[at[order[1:]]] == self.rank[at[order[:-1]]]
        before[order[1:][same]] = at[order[:-1][same]]
        if len(chosen) > 4096:  # periodic texts have an anchor at every byte
            parts = [self.owned(chosen[a : a + 4096]) for a in range(0, len(chosen), 4096)]
            return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        at, before = at[chosen], before[chosen]
        reach = at[:, None] - np.arange(self.width - 1, -1, -1)[None, :]
        own = (reach > before[:, None]) & (reach >= 0) & (reach < len(self.least))
        own &= self.least[np.clip(reach, 0, len(self.least) - 1)] == self.rank[at][:, None]
        begin = reach[np.arange(len(at)), own.argmax(1)]
        return begin, begin + own.sum(1)


def window_ranks(ranks: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of whole strings: the pairs of two half ranks at the offset between them."""
    return mix(ranks[:-offset] * np.uint64(0x9E3779B97F4A7C15) + ranks[offset:])


def scan(column: pa.Array, ids: pa.Array, length: int):
    """Yield (data, Ranks, kept anchors as indices, rows of them, keys, owners, offset in the text).

    A key is the hash of the text, an owner that of the text and the row's id.

    Rows shorter than ``length`` are passed over. A long text comes in parts with enough
    of its surroundings, each anchor in one part only.
    """
    margin = 2 * length
    names = np.array([xxhash.xxh64_intdigest(str(i), _SEED) for i in ids.to_pylist()], np.uint64)
    for first, last, data, starts in slices(column, SLICE):
        sizes = np.diff(starts)
        raw = data.tobytes()
        keys = np.array([xxhash.xxh64_intdigest(raw[starts[i] : starts[i + 1]], _SEED) for i in range(last - first)], np.uint64)
        owners = mix(keys + names[first:last])
        if last - first > 1 or len(data) <= 2 * SLICE:
            row = np.repeat(np.arange(last - first), sizes)
            found = Ranks(data, np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes), length)
            kept = np.arange(len(found.anchors))
            own = row[found.anchors]
            yield data, found, kept, first + own, keys[own], owners[own], -starts[own]
            continue
        for a in range(0, len(data), SLICE):
            low, high = max(0, a - margin), min(len(data), a + SLICE + margin)
            part = data[low:high]
            # A bound that is not the text's own must not cut a context short.
            begin = np.zeros(len(part), np.int64) - (margin if low else 0)
            end = np.full(len(part), len(part))
            found = Ranks(part, begin, end, length)
            kept = np.flatnonzero((found.anchors + low >= a) & (found.anchors + low < a + SLICE))
            n = len(kept)
            yield part, found, kept, np.full(n, first), np.repeat(keys, n), np.repeat(owners, n), np.full(n, low)


def occurrence(context: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(context + mix(owner + at.astype(np.uint64)))


def _rows(docs: DataFrame, length: int, make, schema: str) -> DataFrame:
    """Rows that ``make`` gives for every scanned part, as column arrays by name."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id")
            for part in scan(batch.column("_text"), ids, length):
                got = make(part, ids)
                if got is not None:
                    cols = [c if isinstance(c, pa.Array) else pa.array(c) for c in got]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(docs, run, schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def repeated_spans(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT
) -> DataFrame:
    """(id, key, low, high): byte ranges that are covered by repeated strings.

    ``key`` is the xxh64 of the text. Ranges overlap, and together cover just the bytes
    inside strings of ``length`` bytes that also start elsewhere.
    """
    spark = docs.sparkSession
    kind = docs.schema[row_id].dataType.simpleString()
    plain = docs.select(docs[row_id].alias("_id"), docs[text].alias("_text"))
    share = spark.sparkContext.broadcast

    def first_ranks(part, ids):
        _, found, kept, _, _, owners, offset = part
        at = found.anchors[kept]
        if not len(at):
            return None
        context = found.contexts(at)
        return _signed(found.rank[at]), _signed(context), _signed(occurrence(context, owners, at + offset))

    ranked = _rows(plain, length, first_ranks, "anchor bigint, context bigint, place bigint")
    contexts = ranked.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    anchors = contexts.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("contexts"))
    again = stored(contexts.join(anchors.filter("total > 1"), "anchor").drop("total"))
    whole = share(membership(again.filter("n > 1"), F.col("context")))
    in_part = share(membership(again.filter("contexts > 1"), F.col("place")))
    many = share(membership(again.filter(F.col("contexts") > hot), F.col("anchor")))

    def whole_contexts(part, ids):
        _, found, kept, rows, keys, _, offset = part
        at = found.anchors[kept]
        if not len(at):
            return None
        context = found.contexts(at)
        own = np.flatnonzero(is_member(whole.value, context))
        if not len(own):
            return None
        low, high = found.span(at[own])
        off = offset[own]
        return (_signed(found.rank[at[own]]), _signed(context[own]), ids.take(pa.array(rows[own])),
                _signed(keys[own]), low + off, high + off)

    candidates = _rows(plain, length, whole_contexts, f"anchor bigint, context bigint, id {kind}, key bigint, low bigint, high bigint")
    known = again.filter("n > 1").select("anchor", "context")
    spans = candidates.join(known, ["anchor", "context"], "left_semi").select("id", "key", "low", "high")

    def chosen(part, hot_ones: bool):
        """Anchors whose windows are compared, as (index among kept, first and last + 1 window, place)."""
        _, found, kept, _, _, owners, offset = part
        at = found.anchors[kept]
        if not len(at):
            return None
        place = occurrence(found.contexts(at), owners, at + offset)
        own = is_member(in_part.value, place)
        own &= is_member(many.value, found.rank[at]) == hot_ones
        if not own.any():
            return None
        own = np.flatnonzero(own)
        begin, end = found.owned(kept[own])
        some = end > begin
        return (own[some], begin[some], end[some], place[own[some]]) if some.any() else None

    def part_contexts(part, ids):
        got = chosen(part, False)
        if got is None:
            return None
        data, found, kept, rows, keys, _, offset = part
        own, begin, end, place = got
        raw = data.tobytes()
        texts = [raw[a : b + length - 1] for a, b in zip(begin.tolist(), end.tolist())]
        return (_signed(found.rank[found.anchors[kept[own]]]), _signed(place), ids.take(pa.array(rows[own])), _signed(keys[own]),
                begin + offset[own], pa.array(texts, pa.binary()))

    def hot_windows(part, ids):
        got = chosen(part, True)
        if got is None:
            return None
        _, found, _, rows, keys, _, offset = part
        own, begin, end, _ = got
        which = np.repeat(own, end - begin)
        at = np.arange(len(which)) - np.repeat(np.cumsum(end - begin) - (end - begin) - begin, end - begin)
        low = at + offset[which]
        rank = window_ranks(found.rank, length // 2)[at]
        return _signed(rank), ids.take(pa.array(rows[which])), _signed(keys[which]), low

    pieces = _rows(plain, length, part_contexts, f"anchor bigint, place bigint, id {kind}, key bigint, low bigint, bytes binary")
    dealt = pieces.repartition("anchor").sortWithinPartitions("anchor", "place")
    spans = spans.unionByName(_compare_windows(dealt, length, kind))
    if not many.value.any():
        return spans
    windows = _rows(plain, length, hot_windows, f"rank bigint, id {kind}, key bigint, low bigint")
    often = windows.groupBy("rank").count().filter("count > 1").select("rank")
    found = windows.join(often, "rank", "left_semi")
    return spans.unionByName(found.select("id", "key", "low", (F.col("low") + length).alias("high")))


def _compare_windows(pieces: DataFrame, length: int, kind: str) -> DataFrame:
    """Ranges of windows that occur twice among the pieces of one anchor.

    Pieces come in order of anchor and place. Of those with one place, rows that have id
    and text in common, the first takes part: all of their context goes anyway.
    """
    half = length - length // 2

    def windows(texts: list[bytes], sizes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Ranks of all windows of some pieces, one piece behind the other."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        t = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(t["values"][data] * t["base_pow"][: len(data)], out=sums[1:])
        rank = mix((sums[half:] - sums[:-half]) * t["inverse_pow"][: len(data) - half + 1])
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return window_ranks(rank, length - half)[place + np.repeat(np.cumsum(sizes) - sizes, count)]

    def close(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[3]) for r in rows])
        count = sizes - length + 1
        which = np.repeat(np.arange(len(rows)), count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        # Bytes are ranked some pieces at a time; only a window's rank is kept.
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1))
        rank = np.concatenate(
            [windows([r[3] for r in rows[a:b]], sizes[a:b], count[a:b]) for a, b in zip(cuts, [*cuts[1:], len(rows)])]
        )
        _, index, seen = np.unique(rank, return_inverse=True, return_counts=True)
        hit = seen[index] > 1
        begin = np.flatnonzero(hit & ~(np.append(False, hit[:-1]) & (inside > 0)))
        end = np.flatnonzero(hit & ~(np.append(hit[1:], False) & (np.append(inside[1:], 0) > 0)))
        low = np.array([r[2] for r in rows], np.int64)
        own = which[begin]
        cols = [pa.array([rows[i][0] for i in own], ids_type[0]), pa.array(np.array([r[1] for r in rows], np.int64)[own])]
        cols += [pa.array(low[own] + inside[begin]), pa.array(low[own] + inside[end] + length)]
        return pa.RecordBatch.from_arrays(cols, ["id", "key", "low", "high"])

    ids_type: list = [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, here = [], 0, None, None
        for batch in batches:
            ids_type[0] = batch.column("id").type
            cols = [batch.column(c).to_pylist() for c in ("anchor", "place", "id", "key", "low", "bytes")]
            for anchor, place, *row in zip(*cols):
                if anchor == last and place == here:
                    continue
                if anchor != last and size > CHUNK // 8:
                    yield close(held)
                    held, size = [], 0
                held.append(tuple(row))
                size += len(row[3])
                last, here = anchor, place
        if held:
            yield close(held)

    return map_arrow(pieces, run, f"id {kind}, key bigint, low bigint, high bigint")


def remove_repeats(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT,
    carry: bool = False,
) -> DataFrame:
    """Every row's text without the bytes that repeated strings cover.

    Returns ``row_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256``, ``spans`` (arrays of first and last + 1 byte) and ``kept`` (the
    remaining bytes as text, characters that were cut in part left out). A null or short
    text stays whole (a null one is empty, ``kept`` null). Rows are texts of their own:
    repeated rows of ``length`` bytes or more remove each other. With ``carry`` all
    columns of ``docs`` come in front, and a result whose name they have already gets
    underscores added. Both sides of ``hot`` give the same rows.
    """
    spark = docs.sparkSession
    names = list(docs.columns) if carry else [row_id]
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    spans = repeated_spans(docs, row_id, text, length, hot)
    merged = stored(spans.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("found")))
    touched = spark.sparkContext.broadcast(membership(merged, F.col("key")))
    front = [docs[c].alias(f"c{i}") for i, c in enumerate(names)]
    own = docs.select(*front, docs[row_id].alias("_id"), docs[text].alias("_text"))
    carried = [f"c{i}" for i in range(len(names))]

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        out = [0 if t is None else xxhash.xxh64_intdigest(t.encode(), _SEED) for t in batch.column("_text").to_pylist()]
        return np.array(out, np.uint64)

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        n, gone, runs, sha, spans_, kept = [], [], [], [], [], []
        for t, own_spans in zip(batch.column("_text").to_pylist(), found):
            raw = (t or "").encode()
            merged_: list[list[int]] = []
            for s in own_spans or ():
                if merged_ and s["low"] <= merged_[-1][1]:
                    merged_[-1][1] = max(merged_[-1][1], s["high"])
                else:
                    merged_.append([s["low"], s["high"]])
            left, at = [], 0
            for low, high in merged_:
                left.append(raw[at:low])
                at = high
            rest = b"".join([*left, raw[at:]])
            n.append(len(raw))
            gone.append(len(raw) - len(rest))
            runs.append(len(merged_))
            sha.append(hashlib.sha256(rest).hexdigest())
            spans_.append(merged_)
            kept.append(None if t is None else t if not merged_ else rest.decode("utf-8", "ignore"))
        cols = [batch.column(c) for c in carried]
        cols += [pa.array(c, pa.int64()) for c in (n, gone, runs)]
        cols += [pa.array(sha, pa.string()), pa.array(spans_, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(cols, [*carried, *results])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~is_member(touched.value, keys(batch))))
            yield finish(batch, [None] * batch.num_rows)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_keys = keys(batch)
            here = is_member(touched.value, own_keys)
            part = batch.filter(pa.array(here))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_signed(own_keys[here]))], [*part.schema.names, "_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield finish(batch, batch.column("found").to_pylist())

    head = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(names))
    last = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>, kept string"
    left = map_arrow(own, maybe, f"{head}, _id {kinds[row_id]}, _text string, _key bigint")
    both = left.join(merged, left["_id"].eqNullSafe(merged["id"]) & (left["_key"] == merged["key"]), "left")
    some = map_arrow(both.select(*carried, "_text", "found"), cut, f"{head}, {last}")
    out = map_arrow(own, untouched, f"{head}, {last}").unionByName(some)
    return out.toDF(*names, *free_names(names, results))


def without_repeats(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with what ``remove_repeats`` leaves of each text in its place."""
    out = remove_repeats(docs, row_id, text, length, carry=True)
    own = [F.col(f"`{out.columns[-1]}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own)


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur again."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
