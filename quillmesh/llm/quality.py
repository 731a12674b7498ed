"""Quality rules: boosted trees over statistics of whole texts.

The trees are fitted on labelled rows (a bounded sample, see ``MAX_LABELLED``), the
chosen features with monotonic constraints, and flattened into node arrays, so that a
task scores all rows of a batch with a few array look-ups per level and tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import free_names, map_arrow, query, slices, table, task_cache
from quillmesh.llm.shingles import shingle_hashes, word_hashes

#: Labelled rows that the model is fitted on at most: those with the smallest md5 of
#: the label's id, a sample that does not depend on order or on the label.
MAX_LABELLED = 20_000
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
KEEP_AT = 0.5

#: Feature names with the direction in which quality may move: -1 falls, 1 rises, 0 free.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_ratio": -1,
    "symbols_per_word": -1,
    "upper_ratio": 0,
    "digit_ratio": 0,
    "stop_ratio": 0,
    "other_punct_ratio": 0,
    "line_words": 0,
    "dup_line_ratio": -1,
    "repeat_ratio": -1,
    "distinct_words": 0,
    "non_ascii_ratio": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _classes() -> np.ndarray:
    """Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 symbol, 5 stop, 6 other, 7 tail, 8 lead."""
    kind = np.full(256, 6, np.uint8)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    kind[list(b"#*$%&|<>")] = 4
    kind[list(b".!?")] = 5
    kind[128:192], kind[192:] = 7, 8
    return kind


def document_stats(column: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (rows x ``BASE``) and features (rows x ``FEATURES``) of whole texts."""
    base, features = [], []
    kind = task_cache("words:classes", _classes)
    for first, last, data, starts in slices(column):
        n = last - first
        row = np.repeat(np.arange(n), np.diff(starts))
        seen = np.bincount(row * 9 + kind[data], minlength=9 * n).reshape(n, 9).astype(np.float64)
        words, at = word_hashes(data, starts, fold=False)
        n_words = np.diff(at)
        repeats, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
        rolled, rolled_at = shingle_hashes(words, at, window)
        dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
        raw = data.tobytes()
        for i in range(n):
            distinct[i] = len(np.unique(words[at[i] : at[i + 1]]))
            if n_words[i] > window:
                own = rolled[rolled_at[i] : rolled_at[i + 1]]
                _, back, count = np.unique(own, return_inverse=True, return_counts=True)
                if len(count) < len(own):
                    begin = np.flatnonzero(count[back] > 1)
                    cover = np.zeros(n_words[i] + 1, np.int64)
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + window, -1)
                    repeats[i] = np.count_nonzero(np.cumsum(cover[:-1]))
            own_lines = [x for x in raw[starts[i] : starts[i + 1]].split(b"\n") if x.strip()]
            lines[i] = len(own_lines)
            dup[i] = len(own_lines) - len(set(own_lines))
        chars = seen[:, :7].sum(1) + seen[:, 8]
        word_chars = chars - seen[:, 3]
        base.append(np.stack([n_words, word_chars, seen[:, 4], dup, repeats], 1).astype(np.int64))
        c, w, k = np.maximum(word_chars, 1), np.maximum(n_words, 1), np.maximum(lines, 1)
        features.append(
            np.stack(
                [
                    np.log1p(n_words), word_chars / w, seen[:, 4] / c, seen[:, 4] / w, seen[:, 1] / c,
                    seen[:, 2] / c, seen[:, 5] / w, seen[:, 6] / w, n_words / k, dup / k, repeats / w,
                    distinct / w, seen[:, 8] / c,
                ],
                1,
            )
        )
    if not base:
        return np.zeros((0, len(BASE)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate(base), np.concatenate(features)


@dataclass
class Trees:
    """Flattened trees: node ``i`` goes to ``left[i]`` if ``x[feature[i]] <= threshold[i]``
    and to ``right[i]`` else; a leaf points to itself and holds ``value[i]``."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for every row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                lower = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(lower, self.left[node], self.right[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 3,
    rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 0.5,
) -> Trees:
    """Second-order boosting of the logistic loss on histograms.

    A split on a feature with a sign must order its two leaf values that way, and
    both subtrees keep to their side of the middle, so the sum is monotonic in it.
    Without rows, or with one class only, there are no trees.
    """
    share = (float(y.sum()) + 1.0) / (len(y) + 2.0)
    start = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots = []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(y) else []
    binned = [np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)]
    raw = np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + ridge), low, high))
        here = len(nodes)
        nodes.append([0, np.inf, here, here, value * rate])
        best = None
        if level < depth:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                own = binned[f][rows]
                gl = np.cumsum(np.bincount(own, g[rows], len(cut) + 1))[:-1]
                hl = np.cumsum(np.bincount(own, h[rows], len(cut) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                vl = np.clip(-gl / (hl + ridge), low, high)
                vr = np.clip(-gr / (hr + ridge), low, high)
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
                allowed = (hl >= least) & (hr >= least) & (signs[f] * (vr - vl) >= 0)
                gain = np.where(allowed, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        if best is None:
            step[rows] = value * rate
            return here
        _, f, k, vl, vr = best
        goes = binned[f][rows] <= k
        mid = (vl + vr) / 2
        lows, highs = [low, low], [high, high]
        if signs[f] > 0:
            highs[0], lows[1] = mid, mid
        elif signs[f] < 0:
            lows[0], highs[1] = mid, mid
        a = grow(rows[goes], g, h, level + 1, lows[0], highs[0])
        b = grow(rows[~goes], g, h, level + 1, lows[1], highs[1])
        nodes[here] = [f, float(cuts[f][k]), a, b, 0.0]
        return here

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-raw))
            step = np.zeros(len(y))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
            raw = raw + step
    columns = list(zip(*nodes)) if nodes else [[], [], [], [], []]
    return Trees(
        np.array(roots, np.int64), np.array(columns[0], np.int64), np.array(columns[1], np.float64),
        np.array(columns[2], np.int64), np.array(columns[3], np.int64), np.array(columns[4], np.float64),
        start, depth,
    )


def fit_quality(
    docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text",
    label: str = "quality", most: int = MAX_LABELLED,
) -> Trees:
    """Fit the trees on at most ``most`` labelled rows with a known 0/1 label.

    Several labels of one id count as their maximum, several documents of one id as the
    one whose features come first in order; labels without a document, null ids and null
    labels are left out. Without usable labels the model keeps all.
    """
    spark = docs.sparkSession
    sample = (
        labels.filter(F.col(row_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(row_id).agg(F.max(label).cast("double").alias("_y"))
        .orderBy(F.md5(F.col(row_id).cast("string")), row_id).limit(most)
    )
    rows = {r[0]: r[1] for r in sample.collect()}  # at most `most` ids
    if not rows:
        return fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(len(FEATURES)))
    kind = labels.schema[row_id].dataType
    small = spark.createDataFrame([(k,) for k in rows], f"`{row_id}` {kind.simpleString()}")
    own = docs.join(F.broadcast(small), row_id, "left_semi")
    own = document_features(own, row_id, text).groupBy(row_id).agg(F.min("features").alias("features"))
    found = own.orderBy(row_id).collect()  # at most `most` rows
    x = np.array([r[1] for r in found]).reshape(-1, len(FEATURES))
    y = np.array([rows[r[0]] for r in found])
    return fit_trees(x, y, np.array(list(FEATURES.values())))


def document_features(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id``, the base counts and the features as an array, per row."""
    kind = docs.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = document_stats(batch.column("_text"))
            cols = [batch.column("_id"), *(pa.array(c) for c in base.T)]
            cols.append(pa.array(list(x), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, [row_id, *BASE, "features"])

    counts = ", ".join(f"{c} bigint" for c in BASE)
    schema = f"`{row_id}` {kind}, {counts}, features array<double>"
    return map_arrow(docs.select(docs[row_id].alias("_id"), docs[text].alias("_text")), run, schema)


def judge_quality(
    docs: DataFrame, model: Trees, row_id: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT,
    carry: bool = False,
) -> DataFrame:
    """Base counts, ``base_failed``, ``score`` and ``kept`` of every row.

    A row fails the base rules with fewer than ``MIN_WORDS`` words or more than
    ``REPEAT_PERCENT`` % of its words in repeated windows; a null or empty text has no
    words and fails. Others stay if the trees give them ``keep_at`` or more. Rows are
    judged alone: copies and repeated ids come back as often as they came. With
    ``carry`` all columns of ``docs`` come in front of the results, and a result whose
    name they have already gets underscores added.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kept = list(docs.columns) if carry else [row_id]
    results = free_names(kept, [*BASE, "base_failed", "score", "kept"])
    inner = [f"c{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = document_stats(batch.column("_text"))
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])
            score = model.score(x)
            cols = [batch.column(c) for c in inner] + [pa.array(c) for c in base.T]
            cols += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))]
            yield pa.RecordBatch.from_arrays(cols, [*inner, *(f"r{i}" for i in range(len(results)))])

    sorts = ["bigint"] * len(BASE) + ["boolean", "double", "boolean"]
    schema = ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(inner, kept)), *(f"r{i} {k}" for i, k in enumerate(sorts))])
    front = [docs[c].alias(n) for n, c in zip(inner, kept)]
    out = map_arrow(docs.select(*front, docs[text].alias("_text")), run, schema)
    return out.toDF(*kept, *results)


def keep_good(docs: DataFrame, model: Trees, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with their columns."""
    out = judge_quality(docs, model, row_id, text, carry=True)
    return out.filter(F.col(f"`{out.columns[-1]}`")).select(*(F.col(f"`{c}`") for c in docs.columns))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, with trees fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
