"""Text expressions: tokens, sentences with offsets, pattern matches with offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\r\f"
SENTENCE_BREAK = r"(?<=[.!?\n])\s+"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim every ASCII white-space character, not only blanks."""
    return F.btrim(as_col(c), F.lit(SPACE))


def ws_tokens(c: str | Column) -> Column:
    """Tokens between runs of white space; blank text gives an empty array."""
    return F.filter(F.split(strip(c), r"\s+"), lambda t: t != "")


def word_terms(c: str | Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that nested lambdas reuse it.

    An outer expression named inside a lambda body is evaluated once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold_starts(lens: Column) -> Column:
    """Running sums of ``lens`` before each element, and the sum of all."""
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        lens,
        init,
        lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"])).alias("starts"),
        ),
    )


#: Elements of one fold. A fold copies its array at every step, so longer arrays are
#: summed in blocks.
FOLD = 256


def _running_offsets(parts: Column, gaps: Column) -> Column:
    """Start offset of every part, where ``gaps[i]`` lies between parts i and i+1."""
    lens = F.zip_with(
        parts, gaps, lambda p, g: F.length(p) + F.coalesce(F.length(g), F.lit(0))
    )

    def in_blocks(own: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(own) - 1) / FOLD).cast("int")),
            lambda k: _fold_starts(F.slice(own, k * FOLD + 1, F.lit(FOLD))),
        )
        return let(
            blocks,
            lambda b: F.flatten(
                F.zip_with(
                    b,
                    _fold_starts(F.transform(b, lambda x: x["at"]))["starts"],
                    lambda x, at: F.transform(x["starts"], lambda start: start + at),
                )
            ),
        )

    return let(
        lens,
        lambda own: F.when(F.size(own) <= FOLD, _fold_starts(own)["starts"]).otherwise(in_blocks(own)),
    )


def match_spans(c: str | Column, pattern: str, entity: str) -> Column:
    """All matches of ``pattern`` as ``array<struct<entity_type,start,end>>``.

    Spark returns match text but no offsets; splitting by the same pattern gives
    the text between matches, and the two interleave to the whole string. Texts
    without a match stop after one look.
    """
    text = as_col(c)

    def build(v: Column) -> Column:
        begins = F.zip_with(
            v["gap"],
            _running_offsets(v["gap"], v["hit"]),
            lambda p, s: s + F.length(p),
        )
        spans = F.zip_with(
            v["hit"],
            begins,
            lambda h, b: F.struct(
                F.lit(entity).alias("entity_type"),
                b.alias("start"),
                (b + F.length(h)).alias("end"),
            ),
        )
        return F.filter(spans, lambda s: s["end"].isNotNull())

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.split(text, pattern, -1).alias("gap"),
    )
    empty = F.array().cast("array<struct<entity_type:string,start:int,end:int>>")
    return F.when(F.rlike(text, F.lit(pattern)), let(parts, build)).otherwise(empty)


def sentence_spans(c: str | Column) -> Column:
    """Sentences as ``array<struct<text,start,end>>``; blank pieces are dropped."""
    text = as_col(c)

    def build(v: Column) -> Column:
        spans = F.zip_with(
            v["piece"],
            _running_offsets(v["piece"], v["gap"]),
            lambda p, s: F.struct(
                strip(p).alias("text"), s.alias("start"), (s + F.length(p)).alias("end")
            ),
        )
        return F.filter(spans, lambda s: s["text"] != "")

    parts = F.struct(
        F.split(text, SENTENCE_BREAK, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(SENTENCE_BREAK), F.lit(0)).alias("gap"),
    )
    return let(parts, build)


def inline_rows(df, keep, rows: Column, key: str):
    """Columns of an array of structs, one row per entry.

    The plain generators add a filter on the array's size below themselves, which
    computes a costly array twice; the outer form does not, and its row for an
    empty array is recognised by a null in ``key``.
    """
    return df.select(*keep, F.inline_outer(rows)).filter(F.col(key).isNotNull())


def sentences(c: str | Column) -> Column:
    """Sentence texts without offsets."""
    cut = F.transform(F.split(as_col(c), SENTENCE_BREAK, -1), strip)
    return F.filter(cut, lambda s: s != "")
