"""Box preparation and detection metrics.

Boxes are ``(image_id, box_id, label, x1, y1, x2, y2[, score])``. Only boxes that
overlap can match, so pairs are looked up through a grid: boxes meet in the cells
they cover, and a pair counts in the one cell that holds the upper-left corner of
their intersection. An image with very many boxes thus spreads over its cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.session import cut_lineage, written

GRID = 64.0
#: Boxes of an image and label, of both kinds, up to which each detection meets all.
HOT = 512
#: Detections of a label that are stored as one row.
BLOCK = 1 << 16
# IoU thresholds 0.50, 0.55 ... 0.95.
THRESHOLDS = [0.5 + 0.05 * i for i in range(10)]


def to_xywh(df: DataFrame) -> DataFrame:
    return df.select(
        "*", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")
    )


def normalize_boxes(df: DataFrame, width: str, height: str, crowd: str | None = None) -> DataFrame:
    """From ``x, y, w, h`` to clipped corners; empty and crowd boxes are dropped."""
    rows = df.filter(F.col(crowd) == 0) if crowd else df

    def clip(c: Column, top: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(c, F.col(top).cast("double")))

    out = rows.select(
        *[c for c in rows.columns if c not in ("x", "y", "w", "h")],
        clip(F.col("x"), width).alias("x1"),
        clip(F.col("y"), height).alias("y1"),
        clip(F.col("x") + F.col("w"), width).alias("x2"),
        clip(F.col("y") + F.col("h"), height).alias("y2"),
    )
    return out.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def remap_categories(df: DataFrame, cats: Sequence, col: str = "label") -> DataFrame:
    """Keep the listed categories and number them by list position."""
    known = F.array(*[F.lit(c) for c in cats])
    return df.filter(F.col(col).isin(list(cats))).withColumn(
        col, F.array_position(known, F.col(col)) - 1
    )


def drop_unannotated(
    images: DataFrame, boxes: DataFrame, keypoints: str | None = None, least: int = 10
) -> DataFrame:
    """Images with at least one box of both sides above 1.

    With a visible-keypoint count column, also at least ``least`` of them in all.
    """
    aggs = [F.bool_or((F.col("w") > 1) & (F.col("h") > 1)).alias("_ok")]
    if keypoints:
        aggs.append(F.sum(keypoints).alias("_k"))
    good = boxes.groupBy("image_id").agg(*aggs).filter("_ok")
    if keypoints:
        good = good.filter(F.col("_k") >= least)
    return images.join(good, "image_id", "left_semi")


def _cells(lo: str, hi: str) -> Column:
    """Grid cells of a closed pixel range, which is one unit wider than it reads."""
    return F.sequence(
        F.floor(F.col(lo) / GRID).cast("int"), F.floor((F.col(hi) + 1) / GRID).cast("int")
    )


def _gridded(boxes: DataFrame, prefix: str, on: Sequence[str], extra: Sequence[str]) -> DataFrame:
    named = boxes.select(
        *on,
        *[F.col(c).alias(f"{prefix}_{c}") for c in ["box_id", "x1", "y1", "x2", "y2", *extra]],
    )
    return named.withColumn("_cx", F.explode(_cells(f"{prefix}_x1", f"{prefix}_x2"))).withColumn(
        "_cy", F.explode(_cells(f"{prefix}_y1", f"{prefix}_y2"))
    )


def iou(a: str, b: str) -> Column:
    """Intersection over union with sides counted in whole pixels (+1)."""

    def side(prefix: str, axis: str) -> Column:
        return F.col(f"{prefix}_{axis}2") - F.col(f"{prefix}_{axis}1") + 1

    def common(axis: str) -> Column:
        low = F.greatest(f"{a}_{axis}1", f"{b}_{axis}1")
        high = F.least(f"{a}_{axis}2", f"{b}_{axis}2")
        return F.greatest(F.lit(0.0), high - low + 1)

    inter = common("x") * common("y")
    union = side(a, "x") * side(a, "y") + side(b, "x") * side(b, "y") - inter
    return inter / union


def overlaps(
    gts: DataFrame,
    dets: DataFrame,
    on: Sequence[str],
    gt_extra: Sequence[str] = (),
    det_extra: Sequence[str] = (),
) -> DataFrame:
    """Overlapping (gt, det) pairs with their ``iou``, each pair once."""
    g = _gridded(gts, "g", on, gt_extra)
    d = _gridded(dets, "d", on, det_extra)
    met = g.join(d, [*on, "_cx", "_cy"])
    home = (F.col("_cx") == F.floor(F.greatest("g_x1", "d_x1") / GRID)) & (
        F.col("_cy") == F.floor(F.greatest("g_y1", "d_y1") / GRID)
    )
    return met.filter(home).withColumn("iou", iou("g", "d")).filter("iou > 0").drop("_cx", "_cy")


def _large(gts: DataFrame, dets: DataFrame) -> DataFrame | None:
    """Image and label of more than ``HOT`` boxes of both kinds, counted in images of as many."""
    key = ["image_id", "label"]
    both = gts.select(*key).unionByName(dets.select(*key))
    images = written(both.groupBy("image_id").count().filter(F.col("count") > HOT).select("image_id"))
    if images.isEmpty():
        return None
    kinds = both.join(images, "image_id", "left_semi").groupBy(*key).count()
    large = written(kinds.filter(F.col("count") > HOT).select(*key))
    return None if large.isEmpty() else large


def _met(gts: DataFrame, dets: DataFrame) -> DataFrame:
    """``d_box_id, g_box_id, iou`` of boxes that overlap, of one image and label."""
    key, large = ["image_id", "label"], _large(gts, dets)
    names = ["box_id", "x1", "y1", "x2", "y2"]

    def met(g: DataFrame, d: DataFrame) -> DataFrame:
        g, d = (x.select(*key, *[F.col(c).alias(f"{p}_{c}") for c in names]) for p, x in (("g", g), ("d", d)))
        return d.join(g, key).withColumn("iou", iou("g", "d")).filter("iou > 0").select("d_box_id", "g_box_id", "iou")

    if large is None:
        return met(gts, dets)
    small, big = ([x.join(large, key, how) for x in (gts, dets)] for how in ("left_anti", "left_semi"))
    return met(*small).unionByName(overlaps(*big, key).select("d_box_id", "g_box_id", "iou"))


def _first_hits(dets: DataFrame, best: DataFrame, levels: Sequence[float]) -> DataFrame:
    """``label, _s, box_id, _lo, _hi``: every detection with the levels (as a range of their
    numbers) at which it is the first of its best ground truth."""
    own = dets.select("label", "box_id", (-F.col("score")).alias("_s")).join(best, "box_id", "left")
    passed = F.coalesce(sum((F.col("iou") > t).cast("int") for t in levels), F.lit(0))
    rows = own.select("label", "box_id", "_s", "gt", passed.alias("_hi"))
    # Detections without a hit are their own groups, else they were one.
    hit = F.col("_hi") > 0
    # Ids come first, as a sort by what has few values compares whole rows.
    w = Window.partitionBy(F.when(hit, F.col("gt")), F.when(~hit, F.col("box_id")), "label").orderBy("_s", "box_id")
    before = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("label", "_s", "box_id", F.coalesce(before, F.lit(0)).alias("_lo"), "_hi")


def _blocks(ranged: DataFrame, kind: str) -> DataFrame:
    """``label, _at, _pid``: sorted ``label, _at`` as runs of a label of about ``BLOCK`` rows.

    ``_pid`` numbers the blocks, those of a label in their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, kind_ = TaskContext.get().partitionId() << 32, {}, None
        for batch in chain(batches, [None]):
            full = list(held)
            if batch is not None:
                kind_ = batch.column(0).type
                label = batch.column(0).dictionary_encode()
                code = np.nan_to_num(label.indices.to_numpy(zero_copy_only=False), nan=-1)
                order = np.argsort(code, kind="stable")
                packed = batch.column(1).to_numpy()[order]
                cuts = np.flatnonzero(np.diff(code[order], prepend=-2))
                for a, rows in zip(cuts, np.split(packed, cuts[1:])):
                    held.setdefault(batch.column(0)[order[a]].as_py(), []).append(rows)
                full = [k for k, v in held.items() if sum(map(len, v)) >= BLOCK]
            for name in full:
                cols = [pa.array([name], kind_), pa.array([np.concatenate(held.pop(name)).tobytes()]), pa.array([number])]
                yield pa.RecordBatch.from_arrays(cols, ["label", "_at", "_pid"])
                number += 1

    return ranged.mapInArrow(run, f"label {kind}, _at binary, _pid bigint")


def _areas(flagged: DataFrame, n: int) -> DataFrame:
    """``label, _areas``: per level the sum over hits of the best precision from there on.

    Rows are dealt by ranges of a label, its last detection first, and stored in blocks.
    Counts and best precisions of the blocks behind then go into each, so a label of any
    size is many tasks.
    """
    order = [F.col("_s").desc(), F.col("box_id").desc()]
    # Of rows that are alike the one that hits is the first by score.
    ranged = flagged.repartitionByRange(F.col("label").asc(), *order).sortWithinPartitions(*order, F.col("_hi") > F.col("_lo"))
    kind = flagged.schema["label"].dataType.simpleString()
    at = (F.col("_lo") * 65536 + F.col("_hi")).cast("int")
    stored = cut_lineage(_blocks(ranged.select("label", at.alias("_at")), kind))

    def walk(counts: dict, best: dict, make, schema: str) -> DataFrame:
        """What ``make`` gives per block for its levels, its counts and best precisions behind."""
        share = stored.sparkSession.sparkContext.broadcast((counts, best))
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, best = share.value
            for batch in batches:
                got = []
                for label, raw, pid in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    x = np.frombuffer(raw, np.int32)
                    got.append(make(x >> 16, x & 65535, counts.get(pid), best.get(pid, np.zeros(n))))
                if got:
                    cols = [batch.column(2), batch.column(0), pa.array([g.tolist() for g in got])]
                    yield pa.RecordBatch.from_arrays(cols, names)

        return stored.mapInArrow(run, schema)

    def number(lo, hi, counts, best) -> np.ndarray:
        """Rows, then hits of each level."""
        hits = np.bincount(lo, minlength=n + 1) - np.bincount(np.maximum(lo, hi), minlength=n + 1)
        return np.append(len(lo), np.cumsum(hits)[:n])

    def levels(lo, hi, counts):
        """Per level the precisions at its hits, from the end."""
        total, seen = counts
        for i in range(n):
            hit = np.flatnonzero((lo <= i) & (hi > i))
            # Hits and detections up to and with each row, which come from the end.
            yield (total[1 + i] - seen[1 + i] - np.arange(len(hit))) / (total[0] - seen[0] - hit)

    def highest(lo, hi, counts, best) -> np.ndarray:
        return np.array([p.max(initial=0.0) for p in levels(lo, hi, counts)])

    def area(lo, hi, counts, best) -> np.ndarray:
        return np.array([np.maximum(np.maximum.accumulate(p), b).sum() for p, b in zip(levels(lo, hi, counts), best)])

    def listed(rows: DataFrame, combine, start: np.ndarray) -> tuple[dict, dict]:
        """By block what comes before it within its label; by label all of it."""
        before: dict = {}
        upto: dict = {}
        for r in sorted(rows.collect(), key=lambda r: r["_pid"]):
            before[r["_pid"]] = r["label"], upto.get(r["label"], start)
            upto[r["label"]] = combine(upto.get(r["label"], start), np.array(r["_c"]))
        return before, upto

    before, totals = listed(
        walk({}, {}, number, f"_pid bigint, label {kind}, _c array<bigint>"), np.add, np.zeros(n + 1, np.int64)
    )
    counts = {pid: (totals[label], seen) for pid, (label, seen) in before.items()}
    tops, _ = listed(walk(counts, {}, highest, f"_pid bigint, label {kind}, _c array<double>"), np.maximum, np.zeros(n))
    best = {pid: top for pid, (_, top) in tops.items()}
    areas = walk(counts, best, area, f"_pid bigint, label {kind}, _areas array<double>")
    return areas.groupBy("label").agg(F.array(*[F.sum(F.col("_areas")[i]) for i in range(n)]).alias("_areas"))


def average_precision(
    gts: DataFrame,
    dets: DataFrame,
    thresholds: Sequence[float] = tuple(THRESHOLDS),
) -> DataFrame:
    """``label, threshold, ap``: all-point interpolated AP per class.

    A detection stands for its best ground truth; the first detection of a ground
    truth by score is the hit, later ones are misses. Boxes of an image and label meet
    in one task, those of more than ``HOT`` in the cells of the grid. Detections are then
    dealt once, by score; classes are few enough to be listed on the driver.
    """
    levels = sorted(float(t) for t in thresholds)
    best = _met(gts, dets).groupBy("d_box_id").agg(
        F.max_by(F.struct("g_box_id", "iou"), F.struct("iou", -F.col("g_box_id"))).alias("_b")
    ).select(
        F.col("d_box_id").alias("box_id"),
        F.col("_b.g_box_id").alias("gt"),
        F.col("_b.iou").alias("iou"),
    )
    flagged = _first_hits(dets, best, levels)
    areas = _areas(written(flagged), len(levels)).select(
        "label", *[F.col("_areas")[levels.index(float(t))].alias(f"_a{i}") for i, t in enumerate(thresholds)]
    )
    labels = (
        gts.select("label", F.lit(1).alias("_g"))
        .unionByName(dets.select("label", F.lit(0).alias("_g")))
        .groupBy("label")
        .agg(F.sum("_g").alias("n_gt"))
    )
    listed = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_a{i}").alias("_area"))
            for i, t in enumerate(thresholds)
        ]
    )
    return (
        labels.join(areas, "label", "left")
        .select("label", "n_gt", F.inline(listed))
        .select(
            "label",
            "threshold",
            "n_gt",
            F.coalesce(F.col("_area") / (F.col("n_gt") + 1e-8), F.lit(0.0)).alias("ap"),
        )
    )


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """mAP at 0.5, at 0.75 and over all thresholds, from the per-class table."""

    def at(t: float) -> Column:
        return F.avg(F.when(F.abs(F.col("threshold") - t) < 1e-6, F.col("ap")))

    return ap.agg(at(0.5).alias("map_50"), at(0.75).alias("map_75"), F.avg("ap").alias("map_50_95"))


def box_scores(
    gts: DataFrame, dets: DataFrame, threshold: float = 0.5, label=None
) -> DataFrame:
    """Precision, recall, F1, AP, accuracy and redundancy of box sets, one row.

    A target is met when any detection of its image overlaps it enough. Targets
    in images without detections only count for recall; detections in images
    without targets count as misses.
    """
    pairs = overlaps(gts, dets, ["image_id"], ["label"], ["label"])
    close = pairs.filter(F.col("iou") > threshold)
    met = close.groupBy(F.col("g_box_id").alias("box_id")).agg(
        F.lit(1).alias("_met"),
        F.max((F.col("g_label") == F.col("d_label")).cast("int")).alias("_same"),
    )
    per_gt = gts.groupBy("image_id").agg(F.count(F.lit(1)).alias("_ng"))
    per_det = dets.groupBy("image_id").agg(F.count(F.lit(1)).alias("_nd"))
    targets = gts.join(met, "box_id", "left").join(per_det, "image_id", "left")
    if label is not None:
        targets = targets.filter(F.col("label") == label)
    seen = F.col("_nd").isNotNull()
    t = targets.agg(
        F.count(F.lit(1)).alias("n_gt"),
        F.count_if(seen).alias("n_seen"),
        F.coalesce(F.sum("_met"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("_same"), F.lit(0)).alias("correct"),
    )
    lone = dets.join(per_gt, "image_id", "left_anti").agg(F.count(F.lit(1)).alias("c")).scalar()
    shown = dets if label is None else dets.filter(F.col("label") == label)
    n_det = shown.agg(F.count(F.lit(1)).alias("c")).scalar()
    both = t.withColumn("n_pred", n_det).withColumn("_n", F.col("n_seen") + lone)
    tp, n, gt = F.col("tp"), F.col("_n"), F.col("n_gt")
    empty = F.when(gt == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    precision = F.when(n == 0, empty).when(gt == 0, F.lit(0.0)).otherwise(tp / n)
    recall = F.when(n == 0, empty).when(gt == 0, F.lit(0.0)).otherwise(tp / gt)
    area = F.when(n == 1, tp / n).otherwise(F.greatest(tp - 1, F.lit(0)) / gt)
    ap = F.when(n == 0, empty).when(gt == 0, F.lit(0.0)).otherwise(area)
    out = both.select(
        "n_gt", "n_pred", "tp", "correct",
        precision.alias("precision"), recall.alias("recall"), ap.alias("ap"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.select(
        "n_gt",
        "n_pred",
        p,
        r,
        F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1"),
        "ap",
        F.when(F.col("n_pred") == 0, F.lit(1.0))
        .otherwise(F.col("correct") / F.col("n_pred"))
        .alias("accuracy"),
        F.when(F.col("n_gt") == 0, F.col("n_pred").cast("double"))
        .otherwise(F.col("n_pred") / F.col("n_gt"))
        .alias("redundancy"),
    )
