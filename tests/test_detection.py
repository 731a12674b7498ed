import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import detection, prediction_metrics

BOX = "image_id int, box_id long, label int, x1 double, y1 double, x2 double, y2 double"


def boxes(seed, n, images=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, y = rng.integers(0, 120, 2)
        w, h = rng.integers(20, 90, 2)
        out.append((int(rng.integers(images)), i, int(rng.integers(1, 3)), float(x), float(y), float(x + w), float(y + h)))
    return out


def iou(a, b):
    w = min(a[5], b[5]) - max(a[3], b[3]) + 1
    h = min(a[6], b[6]) - max(a[4], b[4]) + 1
    inter = max(0, w) * max(0, h)
    area = lambda r: (r[5] - r[3] + 1) * (r[6] - r[4] + 1)
    return inter / (area(a) + area(b) - inter)


def test_iou_with_whole_pixels(spark):
    df = spark.createDataFrame([(0, 0, 9, 9, 0, 0, 9, 4)], "g_x1 int, g_y1 int, g_x2 int, g_y2 int, d_x1 int, d_y1 int, d_x2 int, d_y2 int")
    assert df.select(detection.iou("g", "d")).first()[0] == 0.5


def test_overlaps_find_every_pair_once(spark):
    g, d = boxes(1, 60), boxes(2, 60)
    got = detection.overlaps(
        spark.createDataFrame(g, BOX), spark.createDataFrame(d, BOX), ["image_id"]
    ).collect()
    want = {(a[1], b[1]): iou(a, b) for a in g for b in d if a[0] == b[0] and iou(a, b) > 0}
    assert len(got) == len(want)
    assert {(r.g_box_id, r.d_box_id): r.iou for r in got} == pytest.approx(want)


def test_average_precision(spark):
    g = boxes(3, 50)
    rng = np.random.default_rng(4)
    d = []
    for i in range(90):
        b = g[i % 50]
        shift = rng.integers(-12, 13, 4)
        d.append((b[0], i, b[2], *[b[3 + j] + float(shift[j]) for j in range(4)], float(round(rng.random(), 1))))
    got = detection.average_precision(
        spark.createDataFrame(g, BOX), spark.createDataFrame(d, BOX + ", score double")
    ).collect()
    for r in got:
        gts = [b for b in g if b[2] == r.label]
        dets = sorted((b for b in d if b[2] == r.label), key=lambda b: (-b[7], b[1]))
        used, tp = set(), []
        for b in dets:
            near = [(iou(a, b), -a[1]) for a in gts if a[0] == b[0]]
            best = max(near, default=(-1, 0))
            hit = best[0] > r.threshold and best[1] not in used
            if hit:
                used.add(best[1])
            tp.append(hit)
        cum = np.cumsum(tp)
        prec = cum / np.arange(1, len(tp) + 1)
        env = np.maximum.accumulate(prec[::-1])[::-1]
        assert r.ap == pytest.approx(env[np.array(tp)].sum() / (len(gts) + 1e-8))
        assert r.n_gt == len(gts)


def test_box_scores_edge_cases(spark):
    g = spark.createDataFrame(boxes(5, 5), BOX)
    d = spark.createDataFrame(boxes(5, 5), BOX)
    same = detection.box_scores(g, d).first()
    assert same.precision == same.recall == same.f1 == same.accuracy == same.redundancy == 1.0
    none = detection.box_scores(g, d.filter("false")).first()
    assert none.precision == 0.0 and none.accuracy == 1.0
    empty = detection.box_scores(g.filter("false"), d.filter("false")).first()
    assert empty.precision == empty.recall == empty.ap == 1.0


def test_box_preparation(spark):
    df = spark.createDataFrame(
        [(1, "cat", -5.0, 0.0, 10.0, 10.0, 0, 20, 8), (1, "dog", 30.0, 0.0, 5.0, 5.0, 0, 20, 8), (2, "cow", 1.0, 1.0, 2.0, 2.0, 1, 20, 8)],
        "image_id int, label string, x double, y double, w double, h double, crowd int, width int, height int",
    )
    row = detection.normalize_boxes(df, "width", "height", "crowd").collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in row] == [(0.0, 0.0, 5.0, 8.0)]
    kept = detection.remap_categories(df, ["dog", "cat"]).collect()
    assert sorted((r.label for r in kept)) == [0, 1]
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id int")
    assert detection.drop_unannotated(images, df).count() == 2


def test_link_ranking(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200) + 0.3 * y, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    row = prediction_metrics.ranking_quality(df, "y", "s").first()
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
    assert row.roc_auc == pytest.approx(wins / (len(pos) * len(neg)))
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        rec = (pos >= t).sum() / len(pos)
        ap += (rec - last) * (pos >= t).sum() / (s >= t).sum()
        last = rec
    assert row.ap == pytest.approx(ap)
    one = prediction_metrics.ranking_quality(df.withColumn("y", F.lit(1)), "y", "s").first()
    assert one.roc_auc is None and one.ap == 1.0


def test_part_iou_counts_absent_parts(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 1, 1)], "o int, l int, p int")
    got = {r.part: r.iou for r in prediction_metrics.part_iou(df, "o", "l", "p", 3).collect()}
    assert got == {0: (0.5 + 1) / 2, 1: (0.0 + 1) / 2, 2: 1.0}


def test_judges(spark):
    df = spark.createDataFrame(
        [(0.4, True, False, 1), (1.5, False, False, 0), (0.0, False, True, 2), (None, False, False, 3)],
        "score double, passing boolean, failed boolean, verdicts int",
    )
    run = lambda f, **k: [(r.judged, r.counted) for r in prediction_metrics.judge_scores(df, f, **k).collect()]
    assert run("llamaindex", passing="passing", failed="failed") == [(1.0, True), (0.0, True), (0.0, False), (0.0, True)]
    assert run("uptrain") == [(0.4, True), (0.0, False), (0.0, True), (0.0, False)]
    assert run("deepeval", verdicts="verdicts") == [(1.0, True), (0.0, False), (0.0, True), (0.0, True)]


def test_average_precision_without_cells(spark, monkeypatch):
    """all boxes were dealt by the cells they cover, then three times more."""
    g = spark.createDataFrame(boxes(6, 300, 3), BOX)
    rng = np.random.default_rng(7)
    rows = [(*r[:3], *[c + float(s) for c, s in zip(r[3:], rng.integers(-5, 6, 4))]) for r in boxes(6, 300, 3)]
    rows += [(9, 5000, None, 0.0, 0.0, 9.0, 9.0), *[(*r[:2], r[2] % 2 + 1, *r[3:]) for r in rows[:40]]]
    d = spark.createDataFrame(rows, BOX).withColumn("score", F.pmod(F.xxhash64("box_id"), F.lit(20)) / 20)
    key = ["label", "threshold"]
    monkeypatch.setattr(detection, "HOT", 0)
    want = {(r.label, r.threshold): (r.n_gt, r.ap) for r in detection.average_precision(g, d).collect()}
    monkeypatch.setattr(detection, "HOT", 512)
    monkeypatch.setattr(detection, "overlaps", None)
    got = {(r.label, r.threshold): (r.n_gt, r.ap) for r in detection.average_precision(g, d).select(*key, "n_gt", "ap").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    assert len(got) == 30 and all(got[None, t] == (0, 0.0) for t in detection.THRESHOLDS)
    assert max(ap for _, ap in got.values()) > 0.5


def test_mean_average_precision_without_stored_copies(spark, monkeypatch):
    """detections were stored three times on the way to the mean."""
    stored, cut = [], detection.cut_lineage
    monkeypatch.setattr(detection, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    b = spark.createDataFrame(boxes(8, 30), BOX)
    row = detection.mean_average_precision(detection.average_precision(b, b.withColumn("score", F.lit(0.5)))).first()
    assert tuple(row) == pytest.approx((1.0, 1.0, 1.0), abs=1e-6)
    assert stored == [["label", "_at", "_pid"]]


def test_average_precision_in_blocks(spark, monkeypatch):
    """every detection was stored as a row of its own and sent to tasks three times."""
    g = spark.createDataFrame(boxes(9, 240, 5) + [(9, 9000, None, 0.0, 0.0, 9.0, 9.0)], BOX)
    rng = np.random.default_rng(10)
    rows = [(*r[:3], *[c + float(s) for c, s in zip(r[3:], rng.integers(-6, 7, 4))], float(k % 7)) for k, r in enumerate(boxes(9, 240, 5) * 2)]
    d = spark.createDataFrame([*rows, (9, 9000, None, 0.0, 0.0, 9.0, 9.0, 1.0)], BOX + ", score double")
    blocks, cut = [], detection.cut_lineage
    monkeypatch.setattr(detection, "cut_lineage", lambda df: blocks.append(cut(df)) or blocks[-1])

    def run():
        return {(r.label, r.threshold): (r.n_gt, r.ap) for r in detection.average_precision(g, d).collect()}

    whole = run()
    monkeypatch.setattr(detection, "BLOCK", 8, raising=False)
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(records)
    try:
        spark.conf.set(records, "5")
        cut_up = run()
    finally:
        spark.conf.set(records, before)
    assert set(whole) == set(cut_up) and all(cut_up[k] == pytest.approx(whole[k]) for k in whole)
    assert {k[0] for k in whole} == {1, 2, None} and 0.2 < whole[1, 0.5][1] < 1
    many, few = blocks[1].count(), blocks[0].count()
    assert few < 50 < many < 481


def test_large_groups_are_counted_within_large_images(spark, monkeypatch):
    """all boxes were counted by image and label, three times as many groups as images."""
    monkeypatch.setattr(detection, "HOT", 4)
    box = "image_id int, label string"
    rows = [(1, "a")] * 3 + [(2, "a")] * 2 + [(2, "b")] * 2 + [(3, None)] * 9
    g, d = spark.createDataFrame(rows, box), spark.createDataFrame(rows[:3] + rows[5:7] + [(None, "a")] * 6, box)
    assert [tuple(r) for r in detection._large(g, d).orderBy("image_id").collect() if r.label] == [(1, "a")]
    # Image 2 has six boxes, but at most four of a label.
    assert detection._large(g.filter("image_id = 2"), d.filter("image_id = 2")) is None
