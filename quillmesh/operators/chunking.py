"""Text -> chunk rows. Each text is cut inside its own row: one scan, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import inline_rows, let, sentences, ws_tokens

CHUNK_SIZE = 1024
CHUNK_OVERLAP = 20
LEVEL_SIZES = (2048, 512, 128)
SUB_SIZES = (128, 256, 512)


def _starts(n: Column, size: int, overlap: int) -> Column:
    """Start offsets such that every chunk after the first adds something new."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    last = F.greatest(n - F.lit(1 + overlap), F.lit(0))
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(size - overlap))).otherwise(
        F.array().cast("array<int>")
    )


def _token_chunks(tokens: Column, size: int, overlap: int) -> Column:
    return F.transform(
        _starts(F.size(tokens), size, overlap),
        lambda s, i: F.struct(
            i.cast("long").alias("pos"),
            F.array_join(F.slice(tokens, s + 1, F.lit(size)), " ").alias("text"),
            F.least(F.lit(size), F.size(tokens) - s).cast("long").alias("n_tokens"),
        ),
    )


def chunk_tokens(
    df: DataFrame,
    key: str,
    col: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Fixed-size token windows: ``key, pos, text, n_tokens``."""
    chunks = let(ws_tokens(col), lambda t: _token_chunks(t, size, overlap))
    return inline_rows(df, [key], chunks, "pos")


def chunk_chars(
    df: DataFrame,
    key: str,
    col: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Fixed-size character windows: ``key, pos, text``."""
    text = F.col(col)
    chunks = F.transform(
        _starts(F.length(text), size, overlap),
        lambda s, i: F.struct(
            i.cast("long").alias("pos"),
            F.substring(text, s + 1, F.lit(size)).alias("text"),
        ),
    )
    return inline_rows(df, [key], chunks, "pos")


def chunk_hierarchical(
    df: DataFrame, key: str, col: str, sizes: Sequence[int] = LEVEL_SIZES
) -> DataFrame:
    """All levels in one pass: ``key, level, pos, parent_pos, text, n_tokens``.

    Sizes must divide their predecessor, so a chunk lies in exactly one parent.
    """
    for big, small in zip(sizes, sizes[1:]):
        if big % small:
            raise ValueError("each size must divide the one before")

    def tagged(level: int, ratio: int):
        parent = lambda pos: (
            F.floor(pos / F.lit(ratio)) if ratio else F.lit(None)
        )
        return lambda c: F.struct(
            F.lit(level).cast("long").alias("level"),
            c["pos"].alias("pos"),
            parent(c["pos"]).cast("long").alias("parent_pos"),
            c["text"].alias("text"),
            c["n_tokens"].alias("n_tokens"),
        )

    def levels(tokens: Column) -> Column:
        ratios = [0, *(big // small for big, small in zip(sizes, sizes[1:]))]
        return F.concat(
            *[
                F.transform(_token_chunks(tokens, size, 0), tagged(level, ratio))
                for level, (size, ratio) in enumerate(zip(sizes, ratios))
            ]
        )

    return inline_rows(df, [key], let(ws_tokens(col), levels), "pos")


def chunk_multi(
    df: DataFrame,
    key: str,
    col: str,
    sizes: Sequence[int] = SUB_SIZES,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Sub-chunks at several sizes plus the base node itself (size 0).

    ``key`` names the base node, which every sub-chunk row carries.
    """

    def sized(size: int):
        return lambda c: F.struct(
            F.lit(size).cast("long").alias("size"),
            c["pos"].alias("pos"),
            c["text"].alias("text"),
        )

    def all_sizes(tokens: Column) -> Column:
        parts = [
            F.transform(_token_chunks(tokens, size, overlap), sized(size))
            for size in sizes
        ]
        base = F.array(
            F.struct(
                F.lit(0).cast("long").alias("size"),
                F.lit(0).cast("long").alias("pos"),
                F.col(col).alias("text"),
            )
        )
        return F.concat(*parts, base)

    return inline_rows(df, [key], let(ws_tokens(col), all_sizes), "pos")


def sentence_window(df: DataFrame, key: str, col: str, k: int = 3) -> DataFrame:
    """Sentence rows with ``window``: up to ``k`` neighbours on either side."""

    def windows(sents: Column) -> Column:
        return F.transform(
            sents,
            lambda s, i: F.struct(
                i.cast("long").alias("pos"),
                s.alias("sentence"),
                F.array_join(
                    F.slice(
                        sents,
                        F.greatest(i - k, F.lit(0)) + 1,
                        i - F.greatest(i - k, F.lit(0)) + k + 1,
                    ),
                    " ",
                ).alias("window"),
            ),
        )

    return inline_rows(df, [key], let(sentences(col), windows), "pos")
