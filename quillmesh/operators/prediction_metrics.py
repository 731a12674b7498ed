"""Classification, segmentation, regression, link and judge metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.positions import sorted_positions
from quillmesh.functions.running import running


def argmax(scores: str | Column) -> Column:
    """Index of the largest entry, the first on ties."""
    col = F.col(scores) if isinstance(scores, str) else scores
    return F.array_position(col, F.array_max(col)) - 1


def classification(
    df: DataFrame, label: str, pred: str, loss: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and mean loss over rows."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
    ]
    if loss:
        aggs.append(F.avg(loss).alias("loss"))
    return df.groupBy(*keys).agg(*aggs)


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_metrics(counts: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Per class: rows, predictions, hits, accuracy and IoU from confusion counts."""
    both = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("n").alias("row"), F.lit(0).cast("long").alias("col")),
                F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("row"), F.col("n").alias("col")),
            )
        ),
    )
    sums = both.groupBy("cls").agg(F.sum("row").alias("n_label"), F.sum("col").alias("n_pred"))
    diag = counts.filter(F.col("label") == F.col("pred")).select(
        F.col("label").alias("cls"), F.col("n").alias("hits")
    )
    joined = sums.join(diag, "cls", "left").na.fill(0, ["hits"])
    union = F.col("n_label") + F.col("n_pred") - F.col("hits")
    return joined.select(
        "cls",
        "n_label",
        "n_pred",
        "hits",
        (F.col("hits") / (F.col("n_label") + eps)).alias("accuracy"),
        (F.col("hits") / (union + eps)).alias("iou"),
    )


def segmentation_summary(classes: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Global accuracy, mean IoU and mean class accuracy."""
    return classes.agg(
        (F.sum("hits") / (F.sum("n_label") + eps)).alias("accuracy"),
        F.avg("iou").alias("miou"),
        F.avg("accuracy").alias("mean_class_accuracy"),
    )


def part_iou(
    df: DataFrame, obj: str, label: str, pred: str, n_parts: int
) -> DataFrame:
    """``part, iou``: mean over objects; a part absent on both sides counts as 1.

    Objects without a part need no rows: their ones are added from the object
    count.
    """
    counts = df.groupBy(obj, F.col(label).alias("l"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = counts.select(
        obj,
        "n",
        (F.col("l") == F.col("p")).alias("same"),
        F.explode(F.array_distinct(F.array("l", "p"))).alias("part"),
    )
    per = sides.groupBy(obj, "part").agg(
        (F.coalesce(F.sum(F.when(F.col("same"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("iou")
    )
    objects = df.select(obj).distinct().agg(F.count(F.lit(1))).scalar()
    sums = per.groupBy("part").agg(F.sum("iou").alias("s"), F.count(F.lit(1)).alias("c"))
    parts = df.sparkSession.range(n_parts).select(F.col("id").cast("long").alias("part"))
    dense = parts.join(sums.withColumn("part", F.col("part").cast("long")), "part", "left")
    known = dense.na.fill(0, ["s", "c"]).withColumn("_o", objects)
    return known.select(
        "part", ((F.col("s") + F.col("_o") - F.col("c")) / F.col("_o")).alias("iou")
    )


def regression(
    df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()
) -> DataFrame:
    """MSE, MAE and RMSE."""
    gap = F.col(pred) - F.col(label)
    return df.groupBy(*keys).agg(
        F.avg(gap * gap).alias("mse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )


def ranking_quality(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision and ROC-AUC of 0/1 labels, exact with tied scores.

    Rows are first counted per distinct score; the running counts over scores are
    computed block by block. AUC is null unless both classes occur.
    """
    groups = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("all")
    )
    ordered = sorted_positions(
        groups.withColumn("_s", -F.col("score")), ["_s"], pos="_pos", total=None
    )
    run = running(
        ordered,
        [],
        "_pos",
        {"_tp": ("sum", F.col("pos")), "_seen": ("sum", F.col("all"))},
    )
    neg = F.col("all") - F.col("pos")
    # A positive outranks all negatives with lower scores and half of its ties.
    totals = ordered.agg(
        F.struct(F.sum("pos").alias("p"), F.sum(F.col("all") - F.col("pos")).alias("n"))
    ).scalar()
    below = F.col("_n") - (F.col("_seen") - F.col("_tp"))
    return (
        run.withColumn("_all", totals)
        .select("*", F.col("_all.p").alias("_p"), F.col("_all.n").alias("_n"))
        .agg(
            F.max("_p").alias("n_pos"),
            F.max("_n").alias("n_neg"),
            F.sum(F.col("pos") / F.col("_p") * (F.col("_tp") / F.col("_seen"))).alias("ap"),
            F.sum(F.col("pos") * (below + neg / 2)).alias("_wins"),
        )
        .select(
            "n_pos",
            "n_neg",
            "ap",
            F.when(
                (F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                F.col("_wins") / (F.col("n_pos") * F.col("n_neg")),
            ).alias("roc_auc"),
        )
    )


def judge_scores(
    df: DataFrame, family: str, score: str = "score", passing: str | None = None,
    failed: str | None = None, verdicts: str | None = None,
) -> DataFrame:
    """Normalise supplied judge scores: adds ``judged`` and ``counted``.

    ``llamaindex``: a pass is 1, else a score inside [0, 1], else 0; counted unless
    it failed. ``uptrain``: counted only inside [0, 1]. ``deepeval``: any non-zero
    score is 1; no verdicts means not counted.
    """
    s = F.col(score)
    inside = F.coalesce(s.between(0, 1), F.lit(False))
    ran = ~F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(True)
    if family == "llamaindex":
        value = F.when(F.coalesce(F.col(passing), F.lit(False)), 1.0).when(inside, s).otherwise(0.0)
        counted = ran
    elif family == "uptrain":
        value, counted = F.when(inside, s).otherwise(0.0), ran & inside
    elif family == "deepeval":
        has = F.coalesce(F.col(verdicts), F.lit(0)) > 0 if verdicts else F.lit(True)
        counted = ran & has
        nonzero = F.coalesce(s != 0, F.lit(False))
        value = F.when(counted & nonzero, 1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown family {family}")
    return df.withColumn("judged", value).withColumn("counted", counted)
