"""Answer, prediction and detection metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import aggregation, detection, prediction_metrics, text_metrics
from quillmesh.plans.common import query
from quillmesh.plans.privacy import SQL_PAIRS, dialogue_pairs
from quillmesh.plans.retrieval import sql_tokens


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# ---------------------------------------------------------------- answers


def answer_pairs(read):
    """Replies against the question they answer."""
    return dialogue_pairs(read).select(
        "pair_id", F.col("answer").alias("pred"), F.col("question").alias("ref")
    )


SQL_QA = f"{SQL_PAIRS}, qa AS (SELECT pair_id, answer AS pred, question AS ref FROM pairs)"
_WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"


def sql_word_grams(orders) -> str:
    """CTE ``gr(pair_id, side, n, gram)`` of lower-cased words."""
    parts = [
        f"SELECT pair_id, side, {n} AS n, array_to_string(t[i : i + {n - 1}], ' ') AS gram FROM (SELECT pair_id, side, t, unnest(range(1, len(t) - {n - 2})) AS i FROM wd WHERE len(t) >= {n})"
        for n in orders
    ]
    return f"""wd AS (SELECT pair_id, 'p' AS side, {_WORDS.format(c='pred')} AS t FROM qa UNION ALL SELECT pair_id, 'r', {_WORDS.format(c='ref')} FROM qa),
gr AS ({" UNION ALL ".join(parts)})"""


SQL_COUNTS = """gc AS (SELECT pair_id, n, gram, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM gr GROUP BY ALL),
oc AS (SELECT pair_id, n, sum(least(p, r)) AS m, sum(p) AS np, sum(r) AS nr FROM gc GROUP BY ALL)"""


@query(
    "metric_rouge_n",
    f"""WITH {SQL_QA}, {sql_word_grams((1, 2))}, {SQL_COUNTS},
s AS (SELECT pair_id, n, CASE WHEN np > 0 THEN m / np::DOUBLE ELSE 0 END AS p, CASE WHEN nr > 0 THEN m / nr::DOUBLE ELSE 0 END AS r FROM oc),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM s)
SELECT pair_id, {", ".join(f"round(coalesce(max({c}) FILTER (n = {n}), 0), 6)::DOUBLE AS rouge{n}_{a}" for n in (1, 2) for c, a in (("p", "p"), ("r", "r"), ("f", "f1")))}
FROM qa LEFT JOIN f USING (pair_id) GROUP BY pair_id""",
)
def rouge_n(read):
    out = text_metrics.rouge_n(answer_pairs(read))
    return out.select("pair_id", *r6(*[c for c in out.columns if c != "pair_id"]))


# A row of the alignment table per word of the reference; each follows from the one before
# by a running maximum or minimum, as the neighbour to the left adds no or one step.
_SQL_LCS = f"""RECURSIVE {SQL_QA},
w AS (SELECT pair_id, {_WORDS.format(c="pred")} AS p, {_WORDS.format(c="ref")} AS r FROM qa),
lcs(pair_id, i, best, p, r) AS (
  SELECT pair_id, 0::BIGINT, [0::BIGINT FOR k IN range(0, len(p) + 1)], p, r FROM w
  UNION ALL
  SELECT pair_id, i + 1, [0::BIGINT] || [list_max(c[1 : j]) FOR j IN range(1, len(c) + 1)], p, r
  FROM (SELECT pair_id, i, p, r, [greatest(best[k + 1], CASE WHEN p[k] = r[i + 1] THEN best[k] + 1 ELSE 0::BIGINT END) FOR k IN range(1, len(p) + 1)] AS c
        FROM lcs WHERE i < len(r)))"""


@query(
    "metric_rouge_l",
    f"""WITH {_SQL_LCS},
s AS (SELECT pair_id, CASE WHEN len(p) > 0 THEN best[len(p) + 1]::DOUBLE / len(p) ELSE 0 END AS a, CASE WHEN len(r) > 0 THEN best[len(p) + 1]::DOUBLE / len(r) ELSE 0 END AS b
      FROM lcs WHERE i = len(r))
SELECT pair_id, round(a, 6)::DOUBLE AS "rougeL_p", round(b, 6)::DOUBLE AS "rougeL_r", round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 6)::DOUBLE AS "rougeL_f1" FROM s""",
)
def rouge_l(read):
    out = text_metrics.rouge_l(answer_pairs(read))
    return out.select("pair_id", *r6(*[c for c in out.columns if c != "pair_id"]))


@query("metric_rouge_lsum")
def rouge_lsum(read):
    out = text_metrics.rouge_lsum(answer_pairs(read))
    return out.select("pair_id", *r6(*[c for c in out.columns if c != "pair_id"]))


@query(
    "metric_wer",
    f"""WITH RECURSIVE {SQL_QA},
tp AS (SELECT pair_id, pred AS text FROM qa), tr AS (SELECT pair_id, ref AS text FROM qa),
w AS (SELECT a.pair_id, a.toks AS p, b.toks AS r FROM ({sql_tokens("tp", "pair_id")}) a JOIN ({sql_tokens("tr", "pair_id")}) b USING (pair_id)),
ed(pair_id, i, least_, p, r) AS (
  SELECT pair_id, 0::BIGINT, range(0, len(p) + 1), p, r FROM w
  UNION ALL
  SELECT pair_id, i + 1, [i + 1] || [j + least(i + 1, list_min(c[1 : j])) FOR j IN range(1, len(c) + 1)], p, r
  FROM (SELECT pair_id, i, p, r, [least(least_[k + 1] + 1, least_[k] + (p[k] <> r[i + 1])::BIGINT) - k FOR k IN range(1, len(p) + 1)] AS c
        FROM ed WHERE i < len(r)))
SELECT pair_id, round(least_[len(p) + 1]::DOUBLE / greatest(len(r), 1), 6)::DOUBLE AS wer FROM ed WHERE i = len(r)""",
)
def wer(read):
    return text_metrics.wer(answer_pairs(read)).select("pair_id", *r6("wer"))


# DuckDB compares bytes, so every character is first mapped to one ASCII byte.
@query(
    "metric_cer",
    f"""WITH {SQL_QA}, v AS (SELECT pair_id, pred, ref, list_sort(list_distinct(string_split(pred || ref, ''))) AS v FROM qa),
e AS (SELECT pair_id, ref, array_to_string(list_transform(string_split(pred, ''), lambda c: chr((31 + list_position(v, c))::INT)), '') AS a,
 array_to_string(list_transform(string_split(ref, ''), lambda c: chr((31 + list_position(v, c))::INT)), '') AS b FROM v)
SELECT pair_id, round(levenshtein(a, b)::DOUBLE / greatest(length(ref), 1), 6) AS cer FROM e""",
)
def cer(read):
    out = answer_pairs(read).select("pair_id", text_metrics.cer("pred", "ref").alias("cer"))
    return out.select("pair_id", *r6("cer"))


def sql_chrf(words: int) -> str:
    chars = [
        f"SELECT pair_id, side, {n} AS n, substr(t, i, {n}) AS gram FROM (SELECT pair_id, side, t, unnest(range(1, length(t) - {n - 2})) AS i FROM ch WHERE length(t) >= {n})"
        for n in range(1, 7)
    ]
    tokens = [
        f"SELECT pair_id, side, -{n} AS n, array_to_string(t[i : i + {n - 1}], ' ') AS gram FROM (SELECT pair_id, side, t, unnest(range(1, len(t) - {n - 2})) AS i FROM tw WHERE len(t) >= {n})"
        for n in range(1, words + 1)
    ]
    return f"""WITH {SQL_QA},
ch AS (SELECT pair_id, 'p' AS side, regexp_replace(pred, '\\s+', '', 'g') AS t FROM qa UNION ALL SELECT pair_id, 'r', regexp_replace(ref, '\\s+', '', 'g') FROM qa),
tp AS (SELECT pair_id, pred AS text FROM qa), tr AS (SELECT pair_id, ref AS text FROM qa),
tw AS (SELECT pair_id, 'p' AS side, toks AS t FROM ({sql_tokens("tp", "pair_id")}) UNION ALL SELECT pair_id, 'r', toks FROM ({sql_tokens("tr", "pair_id")})),
gr AS ({" UNION ALL ".join(chars + tokens)}), {SQL_COUNTS},
av AS (SELECT pair_id, avg(m / np::DOUBLE) AS p, avg(m / nr::DOUBLE) AS r FROM oc WHERE np > 0 AND nr > 0 GROUP BY ALL)
SELECT pair_id, round(CASE WHEN coalesce(4 * p + r, 0) > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END, 6)::DOUBLE AS chrf FROM qa LEFT JOIN av USING (pair_id)"""


@query("metric_chrf", sql_chrf(0))
def chrf(read):
    return text_metrics.chrf(answer_pairs(read)).select("pair_id", *r6("chrf"))


@query("metric_chrf_plus", sql_chrf(2))
def chrf_plus(read):
    return text_metrics.chrf(answer_pairs(read), 2).select("pair_id", *r6("chrf"))


@query(
    "metric_bleu",
    f"""WITH {SQL_QA}, {sql_word_grams((1, 2, 3, 4))}, {SQL_COUNTS},
pt AS (SELECT pair_id, {", ".join(f"coalesce(max({c}) FILTER (n = {n}), 0)::DOUBLE AS {c}{n}" for n in range(1, 5) for c in ("m", "np", "nr"))} FROM oc GROUP BY pair_id)
SELECT pair_id, round(CASE WHEN coalesce(np1, 0) > 0 THEN exp(least(0.0::DOUBLE, 1 - nr1 / np1)) * exp(({" + ".join(f"ln((m{n} + 1) / (np{n} + 1))" for n in range(1, 5))}) / 4) ELSE 0 END, 6)::DOUBLE AS bleu
FROM qa LEFT JOIN pt USING (pair_id)""",
)
def bleu(read):
    return text_metrics.bleu(answer_pairs(read)).select("pair_id", *r6("bleu"))


@query(
    "metric_meteor",
    f"""WITH {SQL_QA}, {sql_word_grams((1,))},
tk AS (SELECT pair_id, side, len(t) AS l, unnest(t) AS tok, unnest(range(0, len(t))) AS pos FROM wd),
oc AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, tok ORDER BY pos) AS occ FROM tk),
al AS (SELECT p.pair_id, p.pos AS pp, r.pos AS rp, p.l AS np, r.l AS nr FROM oc p JOIN oc r ON p.pair_id = r.pair_id AND p.tok = r.tok AND p.occ = r.occ WHERE p.side = 'p' AND r.side = 'r'),
ck AS (SELECT *, CASE WHEN lag(pp) OVER w = pp - 1 AND lag(rp) OVER w = rp - 1 THEN 0 ELSE 1 END AS nw FROM al WINDOW w AS (PARTITION BY pair_id ORDER BY pp)),
ag AS (SELECT pair_id, count(*)::DOUBLE AS m, sum(nw)::DOUBLE AS c, max(np)::DOUBLE AS np, max(nr)::DOUBLE AS nr FROM ck GROUP BY pair_id)
SELECT pair_id, round(coalesce(10 * (m / np) * (m / nr) / (m / nr + 9 * (m / np)) * (1 - 0.5 * pow(c / m, 3)), 0), 6)::DOUBLE AS meteor FROM qa LEFT JOIN ag USING (pair_id)""",
)
def meteor(read):
    return text_metrics.meteor(answer_pairs(read)).select("pair_id", *r6("meteor"))


@query(
    "metric_clean_perplexity",
    """WITH p AS (SELECT event_id, CASE WHEN value < 5 THEN NULL ELSE value * 20 END AS v FROM events)
SELECT event_id, CASE WHEN coalesce(v, 50) > 1600 THEN 0 ELSE coalesce(v, 50) END AS perplexity, coalesce(v, 50) > 1600 AS too_large FROM p""",
)
def perplexity(read):
    rows = read("events").select(
        "event_id", F.when(F.col("value") >= 5, F.col("value") * 20).alias("perplexity")
    )
    return text_metrics.clean_perplexity(rows)


# ---------------------------------------------------------------- judges

_SQL_JUDGE = "jd AS (SELECT event_id, event_type AS metric, value / 20 AS score, value > 30 AS passing, value < 1 AS failed, event_id % 3 AS verdicts FROM events)"


def judge_rows(read):
    return read("events").select(
        "event_id",
        F.col("event_type").alias("metric"),
        (F.col("value") / 20).alias("score"),
        (F.col("value") > 30).alias("passing"),
        (F.col("value") < 1).alias("failed"),
        F.pmod("event_id", F.lit(3)).alias("verdicts"),
    )


def _judge_mean(df):
    return aggregation.valid_mean(df, "judged", "counted").select("metric", *r6("mean"), "n_valid")


def sql_judge(value: str, counted: str) -> str:
    return f"""WITH {_SQL_JUDGE}, j AS (SELECT metric, ({value})::DOUBLE AS judged, {counted} AS counted FROM jd)
SELECT metric, round(avg(judged) FILTER (counted), 6) AS mean, count(*) FILTER (counted) AS n_valid FROM j GROUP BY metric"""


@query(
    "metric_judge_llamaindex",
    sql_judge("CASE WHEN passing THEN 1.0 WHEN score BETWEEN 0 AND 1 THEN score ELSE 0.0 END", "NOT failed"),
)
def judge_llamaindex(read):
    return _judge_mean(
        prediction_metrics.judge_scores(judge_rows(read), "llamaindex", passing="passing", failed="failed")
    )


@query(
    "metric_judge_uptrain",
    sql_judge("CASE WHEN score BETWEEN 0 AND 1 THEN score ELSE 0.0 END", "NOT failed AND score BETWEEN 0 AND 1"),
)
def judge_uptrain(read):
    return _judge_mean(
        prediction_metrics.judge_scores(judge_rows(read), "uptrain", failed="failed")
    )


@query(
    "metric_judge_deepeval",
    sql_judge("CASE WHEN score <> 0 THEN 1.0 ELSE 0.0 END", "NOT failed AND verdicts > 0"),
)
def judge_deepeval(read):
    return _judge_mean(
        prediction_metrics.judge_scores(
            judge_rows(read), "deepeval", failed="failed", verdicts="verdicts"
        )
    )


# ---------------------------------------------------------------- predictions

SQL_CLS = """cls AS (SELECT l_orderkey AS obj, l_linenumber, (l_partkey % 6)::INT AS label, (CASE WHEN l_suppkey % 4 = 0 THEN (l_partkey + l_linenumber) % 6 ELSE l_partkey % 6 END)::INT AS pred,
 round(l_discount * 100)::BIGINT AS loss, l_quantity FROM lineitem)"""


def classified(read):
    """A label per line item and a prediction that is off for a quarter of them."""
    label = F.pmod("l_partkey", F.lit(6))
    off = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(6))
    return read("lineitem").select(
        F.col("l_orderkey").alias("obj"),
        "l_linenumber",
        label.cast("int").alias("label"),
        F.when(F.pmod("l_suppkey", F.lit(4)) == 0, off).otherwise(label).cast("int").alias("pred"),
        F.round(F.col("l_discount") * 100).cast("long").alias("loss"),
        "l_quantity",
    )


@query(
    "metric_classification",
    f"WITH {SQL_CLS} SELECT count(*) AS n, round(avg((label = pred)::INT), 6) AS accuracy, round(avg(loss), 6) AS loss FROM cls",
)
def classification(read):
    out = prediction_metrics.classification(classified(read), "label", "pred", "loss")
    return out.select("n", *r6("accuracy", "loss"))


@query(
    "metric_classification_argmax",
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS pred FROM embeddings",
)
def argmax(read):
    return read("embeddings").select("vec_id", prediction_metrics.argmax("embedding").alias("pred"))


@query(
    "metric_confusion",
    f"WITH {SQL_CLS} SELECT label, pred, count(*) AS n FROM cls GROUP BY ALL",
)
def confusion(read):
    return prediction_metrics.confusion(classified(read), "label", "pred")


def sql_classes(eps: str) -> str:
    return f"""{SQL_CLS}, cm AS (SELECT label, pred, count(*) AS n FROM cls GROUP BY ALL),
cc AS (SELECT c AS cls, coalesce(sum(n) FILTER (label = c), 0)::BIGINT AS n_label, coalesce(sum(n) FILTER (pred = c), 0)::BIGINT AS n_pred, coalesce(sum(n) FILTER (label = c AND pred = c), 0)::BIGINT AS hits
 FROM cm, (SELECT label AS c FROM cm UNION SELECT pred FROM cm) GROUP BY c),
km AS (SELECT *, hits / (n_label + {eps}::DOUBLE) AS accuracy, hits / (n_label + n_pred - hits + {eps}::DOUBLE) AS iou FROM cc)"""


@query(
    "metric_segmentation_classes",
    f"WITH {sql_classes('1e-8')} SELECT cls, n_label, n_pred, hits, round(accuracy, 6) AS accuracy, round(iou, 6) AS iou FROM km",
)
def seg_classes(read):
    out = prediction_metrics.class_metrics(confusion(read))
    return out.select("cls", "n_label", "n_pred", "hits", *r6("accuracy", "iou"))


@query(
    "metric_segmentation",
    f"WITH {sql_classes('1e-8')} SELECT round(sum(hits) / (sum(n_label) + 1e-8::DOUBLE), 6) AS accuracy, round(avg(iou), 6) AS miou, round(avg(accuracy), 6) AS mean_class_accuracy FROM km",
)
def segmentation(read):
    out = prediction_metrics.segmentation_summary(prediction_metrics.class_metrics(confusion(read)))
    return out.select(*r6(*out.columns))


@query(
    "metric_points_semantic",
    f"WITH {sql_classes('1e-6')} SELECT round(sum(hits) / sum(n_label)::DOUBLE, 6) AS accuracy, round(avg(iou), 6) AS miou, round(avg(accuracy), 6) AS mean_class_accuracy FROM km",
)
def points_semantic(read):
    classes = prediction_metrics.class_metrics(confusion(read), 1e-6)
    out = prediction_metrics.segmentation_summary(classes, 0.0)
    return out.select(*r6(*out.columns))


@query(
    "metric_part_iou",
    f"""WITH {SQL_CLS}, g AS (SELECT o.obj, p AS part, count(*) FILTER (label = p OR pred = p) AS u, count(*) FILTER (label = p AND pred = p) AS i FROM cls o, range(6) t(p) GROUP BY ALL)
SELECT part, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE i / u::DOUBLE END), 6) AS iou FROM g GROUP BY part""",
)
def part_iou(read):
    out = prediction_metrics.part_iou(classified(read), "obj", "label", "pred", 6)
    return out.select("part", *r6("iou"))


@query(
    "metric_regression",
    """WITH g AS (SELECT l_returnflag, round(l_discount * 100)::BIGINT * 10 - round(l_tax * 100)::BIGINT * 12 AS g FROM lineitem)
SELECT l_returnflag, round(avg(g * g), 6) AS mse, round(avg(abs(g)), 6) AS mae, round(sqrt(avg(g * g)), 6) AS rmse FROM g GROUP BY ALL""",
)
def regression(read):
    rows = read("lineitem").select(
        "l_returnflag",
        (F.round(F.col("l_discount") * 100).cast("long") * 10).alias("pred"),
        (F.round(F.col("l_tax") * 100).cast("long") * 12).alias("label"),
    )
    out = prediction_metrics.regression(rows, "label", "pred", ["l_returnflag"])
    return out.select("l_returnflag", *r6("mse", "mae", "rmse"))


@query(
    "metric_ratings",
    """WITH g AS (SELECT round(value * 100)::BIGINT - user_id % 30 * 100 AS g FROM events)
SELECT round(avg(abs(g)), 6) AS mae, round(sqrt(avg(g * g)), 6) AS rmse FROM g""",
)
def ratings(read):
    rows = read("events").select(
        F.round(F.col("value") * 100).cast("long").alias("value"),
        (F.pmod("user_id", F.lit(30)) * 100).alias("pred"),
    )
    return prediction_metrics.regression(rows, "value", "pred").select(*r6("mae", "rmse"))


@query(
    "metric_link_ranking",
    """WITH s AS (SELECT l_quantity AS score, sum((l_returnflag = 'R')::INT) AS pos, count(*) AS a FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(a) OVER (ORDER BY score DESC) AS seen, sum(pos) OVER () AS p, sum(a - pos) OVER () AS n FROM s)
SELECT max(p)::BIGINT AS n_pos, max(n)::BIGINT AS n_neg, round(sum(pos / p::DOUBLE * (tp / seen::DOUBLE)), 6) AS ap, round(sum(pos * ((n - (seen - tp)) + (a - pos) / 2.0::DOUBLE)) / (max(p) * max(n))::DOUBLE, 6) AS roc_auc FROM r""",
)
def link_ranking(read):
    rows = read("lineitem").select(
        F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    out = prediction_metrics.ranking_quality(rows, "y", "score")
    return out.select("n_pos", "n_neg", *r6("ap", "roc_auc"))


# ---------------------------------------------------------------- boxes

SQL_BOXES = """gt AS (SELECT l_orderkey AS image_id, l_orderkey * 10 + l_linenumber AS box_id, l_returnflag AS label, (l_partkey % 200)::DOUBLE AS x1, (l_suppkey % 150)::DOUBLE AS y1,
 (l_partkey % 200 + 20 + l_partkey % 37)::DOUBLE AS x2, (l_suppkey % 150 + 20 + l_suppkey % 29)::DOUBLE AS y2 FROM lineitem),
dt AS (SELECT l_orderkey + CASE WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 7 ELSE 0 END AS image_id, l_orderkey * 10 + l_linenumber AS box_id, CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'R' ELSE l_returnflag END AS label,
 (l_partkey % 200 + (l_partkey + l_linenumber) % 9 - 4)::DOUBLE AS x1, (l_suppkey % 150 + l_linenumber % 5 - 2)::DOUBLE AS y1,
 (l_partkey % 200 + 20 + l_partkey % 37 + l_linenumber)::DOUBLE AS x2, (l_suppkey % 150 + 20 + l_suppkey % 29)::DOUBLE AS y2, l_discount + l_tax / 10 AS score FROM lineitem)"""


def boxes(read):
    """Ground truth from line items; detections are shifted, some to other images."""
    line = read("lineitem")
    px, sy = F.pmod("l_partkey", F.lit(200)), F.pmod("l_suppkey", F.lit(150))
    x2 = px + 20 + F.pmod("l_partkey", F.lit(37))
    y2 = sy + 20 + F.pmod("l_suppkey", F.lit(29))
    box = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id")

    def d(c, name):
        return c.cast("double").alias(name)

    gt = line.select(
        F.col("l_orderkey").alias("image_id"), box, F.col("l_returnflag").alias("label"),
        d(px, "x1"), d(sy, "y1"), d(x2, "x2"), d(y2, "y2"),
    )
    moved = F.when(F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz"), 7).otherwise(0)
    relabelled = (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)
    dt = line.select(
        (F.col("l_orderkey") + moved).alias("image_id"),
        box,
        F.when(relabelled, "R").otherwise(F.col("l_returnflag")).alias("label"),
        d(px + F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(9)) - 4, "x1"),
        d(sy + F.pmod("l_linenumber", F.lit(5)) - 2, "y1"),
        d(x2 + F.col("l_linenumber"), "x2"),
        d(y2, "y2"),
        (F.col("l_discount") + F.col("l_tax") / 10).alias("score"),
    )
    return gt, dt


_IOU = """(greatest(0, least(g.x2, d.x2) - greatest(g.x1, d.x1) + 1) * greatest(0, least(g.y2, d.y2) - greatest(g.y1, d.y1) + 1))"""
SQL_IOU = f"{_IOU} / ((g.x2 - g.x1 + 1) * (g.y2 - g.y1 + 1) + (d.x2 - d.x1 + 1) * (d.y2 - d.y1 + 1) - {_IOU})"

SQL_AP = f"""{SQL_BOXES},
pr AS (SELECT d.box_id, d.label, g.box_id AS gt, {SQL_IOU} AS iou FROM dt d JOIN gt g ON d.image_id = g.image_id AND d.label = g.label),
be AS (SELECT box_id, gt, iou FROM (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY iou DESC, gt) AS r FROM pr) WHERE r = 1),
po AS (SELECT label, box_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, box_id) - 1 AS pos FROM dt),
th AS (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in detection.THRESHOLDS)}]) AS threshold),
hi AS (SELECT label, threshold, gt, min(pos) AS pos FROM po JOIN be USING (box_id), th WHERE iou > threshold GROUP BY ALL),
tp AS (SELECT label, threshold, pos, row_number() OVER (PARTITION BY label, threshold ORDER BY pos) / (pos + 1)::DOUBLE AS prec FROM hi),
en AS (SELECT label, threshold, max(prec) OVER (PARTITION BY label, threshold ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM tp),
ar AS (SELECT label, threshold, sum(env) AS area FROM en GROUP BY ALL),
ng AS (SELECT label, sum(g)::BIGINT AS n_gt FROM (SELECT label, 1 AS g FROM gt UNION ALL SELECT label, 0 FROM dt) GROUP BY ALL),
ap AS (SELECT label, threshold, n_gt, coalesce(area / (n_gt + 1e-8::DOUBLE), 0) AS ap FROM ng CROSS JOIN th LEFT JOIN ar USING (label, threshold))"""


@query(
    "detect_average_precision",
    f"WITH {SQL_AP} SELECT label, round(threshold, 2) AS threshold, n_gt, round(ap, 6) AS ap FROM ap",
)
def average_precision(read):
    out = detection.average_precision(*boxes(read))
    return out.select("label", F.round("threshold", 2).alias("threshold"), "n_gt", *r6("ap"))


@query(
    "detect_map",
    f"WITH {SQL_AP} SELECT round(avg(ap) FILTER (abs(threshold - 0.5) < 1e-6), 6) AS map_50, round(avg(ap) FILTER (abs(threshold - 0.75) < 1e-6), 6) AS map_75, round(avg(ap), 6) AS map_50_95 FROM ap",
)
def mean_ap(read):
    out = detection.mean_average_precision(detection.average_precision(*boxes(read)))
    return out.select(*r6(*out.columns))


@query(
    "detect_box_scores",
    f"""WITH {SQL_BOXES},
pr AS (SELECT g.box_id, g.label = d.label AS same, {SQL_IOU} AS iou FROM dt d JOIN gt g ON d.image_id = g.image_id),
me AS (SELECT box_id, bool_or(same) AS same FROM pr WHERE iou > 0.5 GROUP BY ALL),
t AS (SELECT count(*) AS n_gt, count(*) FILTER (gt.image_id IN (SELECT image_id FROM dt)) AS seen, count(me.box_id) AS tp, count(*) FILTER (me.same) AS ok FROM gt LEFT JOIN me ON gt.box_id = me.box_id),
u AS (SELECT count(*) AS lone FROM dt WHERE image_id NOT IN (SELECT image_id FROM gt)), c AS (SELECT count(*) AS n_pred FROM dt),
s AS (SELECT n_gt, n_pred, tp / (seen + lone)::DOUBLE AS p, tp / n_gt::DOUBLE AS r, greatest(tp - 1, 0) / n_gt::DOUBLE AS ap, ok FROM t, u, c)
SELECT n_gt, n_pred, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(ap, 6) AS ap, round(ok / n_pred::DOUBLE, 6) AS accuracy, round(n_pred / n_gt::DOUBLE, 6) AS redundancy FROM s""",
)
def box_scores(read):
    out = detection.box_scores(*boxes(read))
    return out.select("n_gt", "n_pred", *r6(*out.columns[2:]))


_SQL_RAW = """rb AS (SELECT l_orderkey AS image_id, l_linenumber, l_returnflag AS label, (l_partkey % 90 - 10)::DOUBLE AS x, (l_suppkey % 90 - 10)::DOUBLE AS y, (l_partkey % 30)::DOUBLE AS w, (l_suppkey % 25)::DOUBLE AS h,
 (l_linestatus = 'O')::INT AS crowd, 64 AS width, 48 AS height FROM lineitem)"""


def raw_boxes(read):
    return read("lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        "l_linenumber",
        F.col("l_returnflag").alias("label"),
        (F.pmod("l_partkey", F.lit(90)) - 10).cast("double").alias("x"),
        (F.pmod("l_suppkey", F.lit(90)) - 10).cast("double").alias("y"),
        F.pmod("l_partkey", F.lit(30)).cast("double").alias("w"),
        F.pmod("l_suppkey", F.lit(25)).cast("double").alias("h"),
        (F.col("l_linestatus") == "O").cast("int").alias("crowd"),
        F.lit(64).alias("width"),
        F.lit(48).alias("height"),
    )


@query(
    "detect_normalize_boxes",
    f"""WITH {_SQL_RAW}, c AS (SELECT image_id, l_linenumber, greatest(0, least(x, width)) AS x1, greatest(0, least(y, height)) AS y1, greatest(0, least(x + w, width)) AS x2, greatest(0, least(y + h, height)) AS y2 FROM rb WHERE crowd = 0)
SELECT image_id, l_linenumber, x1, y1, x2, y2, x2 - x1 AS w, y2 - y1 AS h FROM c WHERE x2 > x1 AND y2 > y1""",
)
def normalize_boxes(read):
    clipped = detection.normalize_boxes(raw_boxes(read), "width", "height", "crowd")
    return detection.to_xywh(clipped).drop("label", "crowd", "width", "height")


@query(
    "detect_remap_categories",
    f"WITH {_SQL_RAW} SELECT image_id, l_linenumber, CASE label WHEN 'R' THEN 0 ELSE 1 END::BIGINT AS label FROM rb WHERE label IN ('R', 'A')",
)
def remap(read):
    out = detection.remap_categories(raw_boxes(read), ["R", "A"])
    return out.select("image_id", "l_linenumber", "label")


@query(
    "detect_drop_unannotated",
    f"""WITH {_SQL_RAW} SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey IN (SELECT image_id FROM rb GROUP BY image_id HAVING bool_or(w > 1 AND h > 1) AND sum(l_linenumber) >= 10)""",
)
def drop_unannotated(read):
    images = read("orders").select(F.col("o_orderkey").alias("image_id"))
    return detection.drop_unannotated(images, raw_boxes(read), "l_linenumber")
