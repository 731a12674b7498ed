"""Plain relational operators on question, corpus, link and option tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gold_ids(qa: DataFrame, titles: DataFrame) -> DataFrame:
    """``qa_id, title, doc_id`` per distinct supporting title.

    ``qa(qa_id, titles)``, ``titles(title, doc_id)``. A question with any title
    that is not in the corpus is dropped as a whole.
    """
    wanted = qa.select("qa_id", F.explode(F.array_distinct("titles")).alias("title"))
    linked = wanted.join(titles.select("title", "doc_id"), "title", "left")
    broken = linked.filter(F.col("doc_id").isNull()).select("qa_id").distinct()
    return linked.join(broken, "qa_id", "left_anti").select("qa_id", "title", "doc_id")


def build_corpus(*parts: DataFrame) -> DataFrame:
    """Union by name; repeated passages stay."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filter_links(links: DataFrame, users: DataFrame) -> DataFrame:
    """Trust links whose two ends are both known users."""
    a = users.select(F.col("user_id").alias("trustor"))
    b = users.select(F.col("user_id").alias("trustee"))
    return links.join(a, "trustor", "left_semi").join(b, "trustee", "left_semi")


def client_rows(data: DataFrame, assign: DataFrame, row_id: str) -> DataFrame:
    """Rows with the client that holds them."""
    return data.join(assign.select(row_id, "client_id"), row_id)


def option_grid(options: DataFrame, names: Sequence[str]) -> DataFrame:
    """All combinations of the array columns ``names`` of an options row.

    Exploding one array after the other keeps the row's lineage and needs no join.
    """
    out = options
    for name in names:
        out = out.withColumn(name, F.explode(name))
    return out
