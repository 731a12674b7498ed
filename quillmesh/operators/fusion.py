"""Combining, re-ranking and packing hit lists.

Hit lists hold at most ``k`` rows per query, variant or client, so the windows
here stay small whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import ws_tokens
from quillmesh.operators.chunking import chunk_tokens
from quillmesh.operators.retrieval import DIGITS, top_k
from quillmesh.session import cut_lineage

RRF_K = 60
CONTRAST_WEIGHT = 100.0
BATCHES_PER_GROUP = 1024


def hybrid(vector_hits: DataFrame, term_hits: DataFrame, mode: str = "OR") -> DataFrame:
    """Intersect (``AND``) or unite (``OR``) two hit lists; the term score wins."""
    if mode not in ("AND", "OR"):
        raise ValueError("mode must be AND or OR")
    v = vector_hits.select("query_id", "doc_id", F.col("score").alias("_v"))
    t = term_hits.select("query_id", "doc_id", F.col("score").alias("_t"))
    how = "inner" if mode == "AND" else "full_outer"
    return v.join(t, ["query_id", "doc_id"], how).select(
        "query_id", "doc_id", F.coalesce("_t", "_v").alias("score")
    )


def fuse_max(hits: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """Best score of a document over all query variants."""
    best = hits.groupBy("query_id", doc).agg(F.max("score").alias("score"))
    return top_k(best, k, doc=doc)


def fuse_rrf(
    hits: DataFrame, k: int, variant: str = "variant_id", k_rrf: int = RRF_K
) -> DataFrame:
    """Reciprocal-rank fusion over the variants of a query."""
    ranked = top_k(hits.drop("rank"), None, ["query_id", variant])
    fused = ranked.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (F.lit(k_rrf) + F.col("rank"))), DIGITS + 4).alias("score")
    )
    return top_k(fused, k)


def auto_merge(hits: DataFrame, chunks: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Replace the hits under a parent by the parent once most children are hit.

    ``hits(query_id, chunk_id, score)``, ``chunks(chunk_id, parent_id)``.
    """
    # A hit list is short but costs a search, and it is read three times below.
    hits = cut_lineage(hits.select("query_id", "chunk_id", "score"))
    children = (
        chunks.filter(F.col("parent_id").isNotNull())
        .groupBy("parent_id")
        .agg(F.count(F.lit(1)).alias("_all"))
    )
    linked = hits.join(chunks.select("chunk_id", "parent_id"), "chunk_id", "left")
    share = (
        linked.filter(F.col("parent_id").isNotNull())
        .groupBy("query_id", "parent_id")
        .agg(F.count(F.lit(1)).alias("_hit"), F.avg("score").alias("_mean"))
        .join(children, "parent_id")
        .filter(F.col("_hit") / F.col("_all") > ratio)
        .select("query_id", "parent_id", "_mean")
    )
    merged = share.select(
        "query_id",
        F.col("parent_id").alias("chunk_id"),
        F.round("_mean", DIGITS).alias("score"),
        F.lit(True).alias("merged"),
    )
    kept = linked.join(share, ["query_id", "parent_id"], "left_anti").select(
        "query_id", "chunk_id", "score", F.lit(False).alias("merged")
    )
    both = kept.unionByName(merged)
    # A parent may itself be a hit: keep its better entry.
    return both.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("score"), F.max("merged").alias("merged")
    )


def resolve_parents(hits: DataFrame, links: DataFrame) -> DataFrame:
    """Hits on sub-chunks count for their base node, best score kept."""
    return (
        hits.join(links.select("chunk_id", "base_id"), "chunk_id")
        .groupBy("query_id", "base_id")
        .agg(F.max("score").alias("score"))
    )


def expand_window(hits: DataFrame, windows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Swap the hit text for the sentence window around it."""
    return hits.join(windows.select(*key, "window"), list(key)).withColumnRenamed(
        "window", "text"
    )


def rerank(
    hits: DataFrame, score_col: str, n: int, cutoff: float | None = None
) -> DataFrame:
    """Order by a supplied score, drop scores below ``cutoff``, keep ``n``."""
    scored = hits.drop("rank") if "rank" in hits.columns else hits
    if cutoff is not None:
        scored = scored.filter(F.col(score_col) >= cutoff)
    return top_k(scored, n, score=score_col)


def long_context_reorder(hits: DataFrame) -> DataFrame:
    """Best hits at both ends, weakest in the middle: adds ``position`` from 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    up = n - F.col("rank")
    front = F.floor((n - 1) / 2) - F.floor(up / 2)
    back = F.ceil(n / 2) + F.floor(up / 2)
    return hits.withColumn(
        "position", F.when(up % 2 == 0, front).otherwise(back).cast("long")
    )


def pack_context(
    hits: DataFrame, mode: str = "compact", budget: int = 1024, order: str = "rank"
) -> DataFrame:
    """Prompt texts per query: ``query_id, prompt_no, text``.

    ``compact``, ``compact_accumulate`` and the leaf level of ``tree_summarize`` (all
    levels: ``summary_tree``) join all texts and cut them at ``budget`` tokens; they
    differ in how the answers are put together. ``refine`` and ``accumulate`` give one prompt per
    hit; ``simple_summarize`` keeps the first ``budget`` tokens; ``no_text``
    passes no context.
    """
    if mode in ("refine", "accumulate"):
        w = Window.partitionBy("query_id").orderBy(order)
        return hits.select(
            "query_id", (F.row_number().over(w) - 1).cast("long").alias("prompt_no"), "text"
        )
    if mode == "no_text":
        return hits.select("query_id").distinct().select(
            "query_id", F.lit(0).cast("long").alias("prompt_no"), F.lit("").alias("text")
        )
    if mode not in ("compact", "compact_accumulate", "tree_summarize", "simple_summarize"):
        raise ValueError(f"unknown mode {mode}")
    joined = hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct(order, "text"))),
                lambda s: s["text"],
            ),
            "\n\n",
        ).alias("text")
    )
    cut = chunk_tokens(joined, "query_id", "text", budget, 0)
    if mode == "simple_summarize":
        cut = cut.filter("pos = 0")
    return cut.select("query_id", F.col("pos").alias("prompt_no"), "text")


def summary_tree(
    hits: DataFrame, answer: Callable[[Column], Column], budget: int = 1024, order: str = "rank"
) -> DataFrame:
    """All prompts of ``tree_summarize``: ``query_id, level, node, parent, text``.

    Prompts of level 0 hold the texts of the hits, those of a level above the answers to
    the prompts below, joined in order and cut at ``budget`` tokens, until a query has
    one prompt left. ``answer`` turns the prompts of a level into answers; it may be
    a model behind a pandas UDF. ``parent`` is the prompt above in which a node's answer
    starts, null for the last one and for an answer without tokens. Every level is stored,
    so an answer is asked for once. Answers of a query that together are no shorter than
    their prompts raise, as no level would be the last.
    """
    seen = Window.partitionBy("query_id").orderBy("prompt_no")
    prompts = cut_lineage(pack_context(hits, "tree_summarize", budget, order))
    done, level = None, 0
    while True:
        count = Window.partitionBy("query_id")
        open_ = prompts.withColumn("_n", F.count(F.lit(1)).over(count)).filter("_n > 1").drop("_n")
        answers = cut_lineage(open_.withColumn("_answer", answer(F.col("text"))))
        words = F.coalesce(F.size(ws_tokens("_answer")), F.lit(0))
        start = F.sum(words).over(seen) - words
        parents = answers.select(
            "query_id", "prompt_no", F.when(words > 0, F.floor(start / budget)).cast("long").alias("parent")
        )
        own = prompts.join(parents, ["query_id", "prompt_no"], "left").select(
            "query_id", F.lit(level).cast("long").alias("level"), F.col("prompt_no").alias("node"), "parent", "text"
        )
        done = own if done is None else done.unionByName(own)
        sums = answers.groupBy("query_id").agg(
            F.sum(words).alias("after"), F.sum(F.size(ws_tokens("text"))).alias("before")
        )
        left, stuck = sums.agg(F.count(F.lit(1)), F.count_if(F.col("after") >= F.col("before"))).first()
        if left == 0:
            return done
        if stuck:
            raise ValueError(f"the answers of level {level} are no shorter than its prompts")
        level += 1
        texts = answers.select("query_id", F.col("prompt_no").alias(order), F.col("_answer").alias("text"))
        prompts = cut_lineage(pack_context(texts, "tree_summarize", budget, order))


def merge_hits(
    hits: DataFrame, k: int, k_rrf: int = RRF_K, dup: str = "worst"
) -> DataFrame:
    """Merge the hits of all clients into one list.

    ``k_rrf = 0`` orders by score. Otherwise one ranking over all clients is
    scored by ``1 / (k_rrf + rank)``, keyed by the SHA-256 of the text; a repeated
    text keeps its worst or its best rank.
    """
    if dup not in ("worst", "best"):
        raise ValueError("dup must be worst or best")
    w = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc("client_id"), F.asc("doc_id")
    )
    ranked = hits.withColumn("_r", F.row_number().over(w).cast("long")).withColumn(
        "text_hash", F.sha2("text", 256)
    )
    if k_rrf == 0:
        return ranked.filter(F.col("_r") <= k).select(
            "query_id", "text_hash", F.col("score"), F.col("_r").alias("rank")
        )
    pick = F.max if dup == "worst" else F.min
    one = ranked.groupBy("query_id", "text_hash").agg(pick("_r").alias("_r"))
    scored = one.select(
        "query_id", "text_hash", (1.0 / (F.lit(k_rrf) + F.col("_r"))).alias("score")
    )
    return top_k(scored, k, doc="text_hash")


def ensemble_answers(answers: DataFrame, generated: str | None = None) -> DataFrame:
    """One answer per query from the non-empty client answers.

    A single answer passes through. Otherwise the generated text is taken when
    longer than 30 characters; failing that the first two are joined.
    """
    usable = answers.filter(F.col("answer").isNotNull() & (F.col("answer") != ""))
    counts = usable.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.max(F.trim(generated) if generated else F.lit(None).cast("string")).alias("_g"),
    )
    # Two answers per query are enough; the limit is applied in every task.
    w = Window.partitionBy("query_id").orderBy("client_id", "answer")
    top = usable.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    firsts = top.groupBy("query_id").agg(
        F.max(F.when(F.col("_r") == 1, F.col("answer"))).alias("_1"),
        F.max(F.when(F.col("_r") == 2, F.col("answer"))).alias("_2"),
    )
    chosen = (
        F.when(F.col("n_answers") == 1, F.col("_1"))
        .when(F.length("_g") > 30, F.col("_g"))
        .otherwise(F.concat("_1", F.lit(" | "), "_2"))
    )
    return counts.join(firsts, "query_id").select(
        "query_id", "n_answers", chosen.alias("answer")
    )


def contrastive_eval(
    pairs: DataFrame, batch: str, order: str, other: bool = False
) -> DataFrame:
    """In-batch contrastive loss per batch of a fixed size.

    ``pairs(batch, order, q, r[, q_other, r_other])``. The loss is the mean cross
    entropy of the cosine matrix with the diagonal as labels, plus 100 times the
    mean squared difference to the matrix of another model.
    """
    cols = ["q", "r", *(["q_other", "r_other"] if other else [])]

    def unit(vectors) -> np.ndarray:
        m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def losses(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b, part in pdf.sort_values(order).groupby(batch):
            m = unit(part["q"]) @ unit(part["r"]).T
            top = m.max(axis=1, keepdims=True)
            lse = np.log(np.exp(m - top).sum(axis=1)) + top[:, 0]
            ce = float((lse - np.diag(m)).mean())
            mse = 0.0
            if other:
                n = unit(part["q_other"]) @ unit(part["r_other"]).T
                mse = float(((m - n) ** 2).mean())
            out.append((b, len(part), ce, mse, ce + CONTRAST_WEIGHT * mse))
        return pd.DataFrame(
            out, columns=["batch_id", "n_rows", "loss_ce", "loss_mse", "loss"]
        )

    grouped = pairs.select(
        F.col(batch).cast("long").alias(batch),
        order,
        *cols,
        F.floor(F.col(batch) / BATCHES_PER_GROUP).alias("_g"),
    ).groupBy("_g")
    return grouped.applyInPandas(
        losses,
        "batch_id long, n_rows long, loss_ce double, loss_mse double, loss double",
    )


def compare_methods(
    queries: DataFrame, methods: Mapping[str, Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """Hits of several methods side by side, told apart by ``method``."""
    out = None
    for name, run in methods.items():
        hits = run(queries).select(
            F.lit(name).alias("method"), "query_id", "doc_id", "score", "rank"
        )
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        raise ValueError("no methods given")
    return out
