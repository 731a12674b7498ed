"""Chunks that keep to the borders of a text: sentences, or separators level by level.

Texts become units in the JVM. Which units make a chunk follows from their lengths by a
running fold that starts anew where the budget is used up; only the lengths go through
Python, as Arrow arrays, and the fold takes one search per chunk. One scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import inline_rows, let, sentences, strip, ws_tokens
from quillmesh.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE

CHARS = 500
SEPARATORS = ("\n\n", "\n", " ")


def fold_units(lengths: np.ndarray, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first unit, units, length) of every chunk of some units of at most ``size``.

    A negative length starts a run; chunks keep to a run. A chunk takes units while they
    fit. The next one of the run begins with the most units at the end of it that have
    ``overlap`` together and leave room for the unit after them.
    """
    fresh, lengths = lengths < 0, np.abs(lengths.astype(np.int64))
    upto = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.append(np.flatnonzero(fresh[1:]) + 1, len(lengths))
    out, first = [], 0
    while first < len(lengths):
        stop = int(ends[np.searchsorted(ends, first, "right")])
        last = min(stop, int(np.searchsorted(upto, upto[first] + size, "right")) - 1)
        out.append((first, last - first, int(upto[last] - upto[first])))
        if last < stop:
            least = max(upto[last] - overlap, upto[last + 1] - size)
            first = max(first + 1, int(np.searchsorted(upto, least, "left")))
        else:
            first = stop
    return out


def _folded(lengths: Column, size: int, overlap: int) -> Column:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")

    @F.pandas_udf("array<struct<first:int,n:int,total:bigint>>")
    def fold(column: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None else fold_units(np.asarray(x), size, overlap) for x in column], dtype=object)

    return fold(lengths)


def chunk_sentences(df: DataFrame, key: str, col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Whole sentences up to ``size`` tokens: ``key, pos, text, n_tokens``.

    A longer sentence is cut every ``size`` tokens. A chunk begins with the last sentences
    of the one before that have at most ``overlap`` tokens. Sentences are joined by a
    blank. Null and blank texts give no chunk.
    """

    def cut(sentence: Column) -> Column:
        return let(
            F.struct(sentence.alias("s"), ws_tokens(sentence).alias("t")),
            lambda v: F.when(
                F.size(v["t"]) <= size, F.array(F.struct(v["s"].alias("text"), F.size(v["t"]).alias("n")))
            ).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size(v["t"]) - 1, F.lit(size)),
                    lambda i: F.struct(
                        F.array_join(F.slice(v["t"], i + 1, F.lit(size)), " ").alias("text"),
                        F.least(F.lit(size), F.size(v["t"]) - i).alias("n"),
                    ),
                )
            ),
        )

    units = df.select(key, F.flatten(F.transform(sentences(col), cut)).alias("_u"))
    folded = units.withColumn("_c", _folded(F.transform("_u", lambda u: u["n"]), size, overlap))
    chunks = F.transform(
        "_c",
        lambda c, i: F.struct(
            i.cast("long").alias("pos"),
            F.array_join(F.transform(F.slice("_u", c["first"] + 1, c["n"]), lambda u: u["text"]), " ").alias("text"),
            c["total"].alias("n_tokens"),
        ),
    )
    return inline_rows(folded, [key], chunks, "pos")


def _separated(pieces: Column, separator: str, size: int) -> Column:
    """Pieces over ``size`` split in front of a separator, the others as they are.

    What comes of a long piece is a run of its own, and so is what follows it.
    """

    def split(text: Column) -> Column:
        parts = F.transform(
            F.split(text, "\\Q" + separator + "\\E", -1),
            lambda x, j: F.when(j > 0, F.concat(F.lit(separator), x)).otherwise(x),
        )
        return F.transform(
            F.filter(parts, lambda x: x != ""), lambda x, j: F.struct(x.alias("text"), (j == 0).alias("fresh"))
        )

    return _levelled(pieces, split, size)


def _levelled(pieces: Column, split, size: int) -> Column:
    def level(v: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            behind = F.coalesce(F.length(F.get(v, i - 1)["text"]) > size, F.lit(False))
            same = F.array(F.struct(p["text"].alias("text"), (p["fresh"] | behind).alias("fresh")))
            return F.when(F.length(p["text"]) <= size, same).otherwise(split(p["text"]))

        return F.flatten(F.transform(v, one))

    return let(pieces, level)


def chunk_recursive(
    df: DataFrame, key: str, col: str, size: int = CHARS, overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
) -> DataFrame:
    """Chunks of at most ``size`` characters: ``key, pos, text``.

    Pieces that are too long are split in front of the first separator, what is still too
    long in front of the second, and so on, at last into windows of characters. Pieces of
    one split are merged up to ``size``, with ``overlap`` characters of whole pieces taken
    over from the chunk before. Chunks lose white space at both ends; blank ones go.
    """
    if 2 * overlap > size:
        raise ValueError("overlap must be at most half of size")
    step = size - overlap

    def windows(text: Column) -> Column:
        # Steps, each with the overlap from the next one; a last one that adds nothing goes.
        def build(v: Column) -> Column:
            n = F.size(v)
            last = F.when((n > 1) & (F.length(F.get(v, n - 1)) <= overlap), n - 1).otherwise(n)
            return F.transform(
                F.slice(v, F.lit(1), last),
                lambda x, i: F.struct(
                    F.concat(x, F.coalesce(F.substring(F.get(v, i + 1), 1, overlap), F.lit(""))).alias("text"),
                    F.lit(True).alias("fresh"),
                ),
            )

        return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0)), build)

    pieces = F.array(F.struct(F.col(col).alias("text"), F.lit(False).alias("fresh")))
    for separator in separators:
        pieces = _separated(pieces, separator, size)
    units = df.filter(F.length(col) > 0).select(key, _levelled(pieces, windows, size).alias("_u"))
    signed = F.transform("_u", lambda u: F.when(u["fresh"], -F.length(u["text"])).otherwise(F.length(u["text"])))
    folded = units.withColumn("_c", _folded(signed, size, overlap))
    texts = F.transform(
        "_c", lambda c: strip(F.array_join(F.transform(F.slice("_u", c["first"] + 1, c["n"]), lambda u: u["text"]), ""))
    )
    chunks = F.transform(
        F.filter(texts, lambda t: t != ""), lambda t, i: F.struct(i.cast("long").alias("pos"), t.alias("text"))
    )
    return inline_rows(folded, [key], chunks, "pos")
