"""Retrieval metrics as array expressions over (retrieved, expected)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def f1(r: Column, e: Column) -> Column:
    """Retrieved list cut to the length of the gold list, both taken as sets."""
    cut = F.slice(r, F.lit(1), F.size(e))
    tp = _overlap(cut, e)
    p = _ratio(tp, F.size(F.array_distinct(cut)))
    rec = _ratio(tp, F.size(F.array_distinct(e)))
    return _ratio(2 * p * rec, p + rec)


def exact_match(r: Column, e: Column) -> Column:
    same = F.sort_array(e) == F.sort_array(F.slice(r, F.lit(1), F.size(e)))
    return F.when(same, 1.0).otherwise(0.0)


def mrr(r: Column, e: Column) -> Column:
    first = F.array_min(
        F.transform(r, lambda x, i: F.when(F.array_contains(e, x), i + 1))
    )
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def gold_hit(r: Column, e: Column, k: int) -> Column:
    """Any retrieved id among the first ``k`` gold ids (the gold list is cut)."""
    return F.when(F.arrays_overlap(r, F.slice(e, 1, k)), 1.0).otherwise(0.0)


def hit_at(r: Column, e: Column, k: int) -> Column:
    """Any gold id among the first ``k`` retrieved."""
    return F.when(F.arrays_overlap(F.slice(r, 1, k), e), 1.0).otherwise(0.0)


def ref_map(r: Column, e: Column) -> Column:
    """Mean over gold items, in gold order i, of (i+1) / rank; may exceed 1."""
    terms = F.transform(
        e,
        lambda g, i: F.when(
            F.array_contains(r, g), (i + 1) / F.array_position(r, g)
        ).otherwise(F.lit(0.0)),
    )
    return _ratio(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.size(e))


def dcg(r: Column, e: Column) -> Column:
    """Binary gain; repeated ids count each time."""
    gains = F.transform(
        r,
        lambda x, i: F.when(
            F.array_contains(e, x), F.lit(1.0) / F.log2(i + F.lit(2))
        ).otherwise(F.lit(0.0)),
    )
    return F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)


def idcg(r: Column, e: Column) -> Column:
    """Gain if the relevant retrieved items came first; gold size plays no part."""
    hits = F.size(F.filter(r, lambda x: F.array_contains(e, x)))
    return F.when(
        hits > 0,
        F.aggregate(
            F.sequence(F.lit(1), hits),
            F.lit(0.0),
            lambda a, i: a + F.lit(1.0) / F.log2(i + F.lit(1)),
        ),
    ).otherwise(F.lit(0.0))


def ndcg(r: Column, e: Column) -> Column:
    return _ratio(dcg(r, e), idcg(r, e))


def recall_at(r: Column, e: Column, k: int) -> Column:
    return _ratio(_overlap(F.slice(r, 1, k), e), F.size(F.array_distinct(e)))


def precision_at(r: Column, e: Column, k: int) -> Column:
    top = F.slice(r, 1, k)
    return _ratio(_overlap(top, e), F.size(F.array_distinct(top)))


def retrieval_metrics(
    df: DataFrame, retrieved: str = "retrieved", expected: str = "expected"
) -> DataFrame:
    """All list metrics of one query set, one row per query."""
    r, e = F.col(retrieved), F.col(expected)
    return df.select(
        "query_id",
        f1(r, e).alias("f1"),
        exact_match(r, e).alias("em"),
        mrr(r, e).alias("mrr"),
        gold_hit(r, e, 1).alias("gold_hit1"),
        gold_hit(r, e, 10).alias("gold_hit10"),
        ref_map(r, e).alias("ref_map"),
        dcg(r, e).alias("dcg"),
        idcg(r, e).alias("idcg"),
        ndcg(r, e).alias("ndcg"),
    )


def hit_metrics(
    df: DataFrame,
    retrieved: str = "retrieved",
    expected: str = "expected",
    ks: tuple[int, ...] = (1, 2, 3, 4, 5, 8, 10),
) -> DataFrame:
    """Hit, recall and precision at several depths."""
    r, e = F.col(retrieved), F.col(expected)
    cols = []
    for k in ks:
        cols += [
            hit_at(r, e, k).alias(f"hit_{k}"),
            recall_at(r, e, k).alias(f"recall_{k}"),
            precision_at(r, e, k).alias(f"precision_{k}"),
        ]
    return df.select("query_id", *cols)


def metric_means(df: DataFrame) -> DataFrame:
    """Mean of every metric over the query set."""
    names = [c for c in df.columns if c != "query_id"]
    return df.agg(
        F.count(F.lit(1)).alias("n_queries"), *[F.avg(c).alias(c) for c in names]
    )


def ranked_lists(hits: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, retrieved, expected`` for every query, empty lists included."""
    got = hits.groupBy("query_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "doc_id"))),
            lambda s: s["doc_id"],
        ).alias("retrieved")
    )
    want = gold.groupBy("query_id").agg(
        F.sort_array(F.collect_list("doc_id")).alias("expected")
    )
    none = F.array().cast("array<bigint>")
    return (
        queries.select("query_id")
        .join(got, "query_id", "left")
        .join(want, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("retrieved", none).alias("retrieved"),
            F.coalesce("expected", none).alias("expected"),
        )
    )
