"""Personal-data detection, masking and sentence risk, one projection per step.

Every operator works row by row inside the JVM: no shuffle, and texts of any
length are processed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import (
    as_col,
    inline_rows,
    let,
    match_spans,
    sentence_spans,
    strip,
    ws_tokens,
)

# Entity names with their patterns, in detection order.
PII_PATTERNS = {
    "EMAIL_ADDRESS": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+",
    "PHONE_NUMBER": r"\+?\d[\d\s-]{6,}\d",
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,16}\b",
}

# Words that raise the risk of a sentence.
RISK_KEYWORDS = [
    "password",
    "secret",
    "confidential",
    "ssn",
    "social security",
    "credit card",
    "bank account",
    "private",
    "classified",
]

# A phone pattern also matches most SSNs and cards, so the longer forms go first.
MASK_ORDER = ["EMAIL_ADDRESS", "CREDIT_CARD", "US_SSN", "PHONE_NUMBER"]

RISK_THRESHOLD = 0.45
THRESHOLD_BOUNDS = (0.25, 0.85)
REDACTED = "<REDACTED>"

SPAN_TYPE = "array<struct<entity_type:string,start:int,end:int>>"


def pii_spans(col: str | Column, entities: Sequence[str] | None = None) -> Column:
    """Spans of all patterns in detection order; blank text gives none."""
    text = as_col(col)
    names = [e for e in PII_PATTERNS if entities is None or e in entities]
    if not names:
        return F.array().cast(SPAN_TYPE)
    found = F.concat(*[match_spans(text, PII_PATTERNS[e], e) for e in names])
    return F.when(strip(text) == "", F.array().cast(SPAN_TYPE)).otherwise(
        found.cast(SPAN_TYPE)
    )


def detect_pii(df: DataFrame, col: str, out: str = "pii") -> DataFrame:
    return df.withColumn(out, pii_spans(col))


def pii_counts(df: DataFrame, col: str) -> DataFrame:
    """One count column per entity, without building spans."""
    return df.select(
        "*",
        *[
            F.regexp_count(F.col(col), F.lit(p)).cast("long").alias(e.lower())
            for e, p in PII_PATTERNS.items()
        ],
    )


def select_entities(
    spans: str | Column, allowed: Sequence[str], keep_all: bool = False
) -> Column:
    """Keep the allowed entity types, or every type when ``keep_all`` is set."""
    spans = as_col(spans)
    if keep_all:
        return spans
    return F.filter(spans, lambda s: s["entity_type"].isin(list(allowed)))


def mask_text(
    col: str | Column,
    tags: bool = True,
    passthrough: Sequence[str] = (),
    placeholder: str = REDACTED,
) -> Column:
    """Replace matches by ``<ENTITY>`` or a placeholder.

    Where spans overlap, the first entity in ``MASK_ORDER`` owns the text.
    """
    out = as_col(col)
    for entity in MASK_ORDER:
        if entity in passthrough:
            continue
        tag = f"<{entity}>" if tags else placeholder
        out = F.regexp_replace(out, F.lit(PII_PATTERNS[entity]), F.lit(tag))
    return out


def mask_pii(
    df: DataFrame,
    col: str,
    tags: bool = True,
    passthrough: Sequence[str] = (),
    out: str = "masked_text",
) -> DataFrame:
    return df.withColumn(out, mask_text(col, tags, passthrough))


def split_sentences(df: DataFrame, col: str) -> DataFrame:
    """One row per sentence with its position and offsets."""
    kept = [c for c in df.columns if c != col]
    rows = F.transform(
        sentence_spans(col),
        lambda s, i: F.struct(
            i.cast("long").alias("position"),
            s["text"].alias("sentence"),
            s["start"].cast("long").alias("start"),
            s["end"].cast("long").alias("end"),
        ),
    )
    return inline_rows(df, kept, rows, "position")


def sentence_risk(
    sent: Column,
    spans: Column,
    query_terms: Column | None = None,
    keywords: Column | Sequence[str] = tuple(RISK_KEYWORDS),
) -> Column:
    """Risk in [0, 1] of one sentence struct.

    Share of personal characters + 0.2 per keyword present + up to 0.3 for
    digits + up to 0.2 for words shared with the query.
    """
    text = sent["text"]
    covered = F.aggregate(
        spans,
        F.lit(0),
        lambda acc, s: acc
        + F.greatest(
            F.lit(0),
            F.least(sent["end"], s["end"]) - F.greatest(sent["start"], s["start"]),
        ),
    )
    pii_part = covered / F.greatest(F.lit(1), sent["end"] - sent["start"])
    if not isinstance(keywords, Column):
        keywords = F.array(*[F.lit(w.lower()) for w in keywords]).cast("array<string>")
    found = F.filter(keywords, lambda w: F.contains(F.lower(text), w))
    word_part = F.size(found) * F.lit(0.2)
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    digit_part = F.least(
        F.lit(0.3), digits / F.greatest(F.lit(1), F.length(text)) * F.lit(0.3)
    )
    risk = pii_part + word_part + digit_part
    if query_terms is not None:
        shared = F.size(
            F.filter(ws_tokens(text), lambda t: F.array_contains(query_terms, F.lower(t)))
        )
        risk = risk + F.when(
            F.size(query_terms) > 0, F.least(F.lit(0.2), shared / F.size(query_terms))
        ).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), risk)


def query_terms(col: str | Column) -> Column:
    """Distinct lower-cased words of a query; null gives an empty array."""
    return F.array_distinct(ws_tokens(F.lower(F.coalesce(as_col(col), F.lit("")))))


def scored_sentences(
    col: str | Column,
    query: str | Column | None = None,
    keywords: Sequence[str] = tuple(RISK_KEYWORDS),
    spans: Column | None = None,
) -> Column:
    """``array<struct<text,start,end,risk>>`` for one text."""
    text = as_col(col)
    spans = pii_spans(text) if spans is None else spans
    # Most texts hold no keyword, so sentences are tested against the text's own.
    words = F.array(*[F.lit(w.lower()) for w in keywords]).cast("array<string>")
    present = let(
        F.lower(text), lambda low: F.filter(words, lambda w: F.contains(low, w))
    )
    bound = [spans.alias("sp"), present.alias("kw"), sentence_spans(text).alias("ss")]
    if query is not None:
        bound.append(query_terms(query).alias("qt"))

    def with_risk(v: Column) -> Column:
        terms = v["qt"] if query is not None else None
        return F.transform(
            v["ss"],
            lambda s: F.struct(
                s["text"].alias("text"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                sentence_risk(s, v["sp"], terms, v["kw"]).alias("risk"),
            ),
        )

    return let(F.struct(*bound), with_risk)


def _keep_rule(threshold: Column, preserve: int):
    return lambda s, i: (s["risk"] < threshold) | (i < F.lit(preserve))


def _as_threshold(threshold: float | str | Column) -> Column:
    if isinstance(threshold, (int, float)):
        return F.lit(float(threshold))
    return as_col(threshold)


def erase_high_risk(
    df: DataFrame,
    col: str,
    threshold: float | str | Column = RISK_THRESHOLD,
    preserve: int = 1,
    query: str | None = None,
    keywords: Sequence[str] = tuple(RISK_KEYWORDS),
    drop: bool = True,
    keep_columns: bool = False,
) -> DataFrame:
    """Drop sentences at or above the threshold, keeping the first ``preserve``.

    Adds ``kept_text``, ``removed_count``, ``kept_count``, ``average_risk`` and
    ``max_risk``; the original text stands where nothing would be left.
    """
    limit = _as_threshold(threshold)
    rule = _keep_rule(limit, preserve if drop else 1 << 30)
    base = df.withColumn("_pii", pii_spans(col))
    base = base.withColumn(
        "_sent", scored_sentences(col, query, keywords, F.col("_pii"))
    ).withColumn("_kept", F.filter("_sent", rule))
    n = F.size("_sent")
    joined = F.array_join(F.transform("_kept", lambda s: s["text"]), " ")
    total = F.aggregate("_sent", F.lit(0.0), lambda a, s: a + s["risk"])
    out = base.select(
        "*",
        F.when(joined == "", F.col(col)).otherwise(joined).alias("kept_text"),
        (n - F.size("_kept")).cast("long").alias("removed_count"),
        F.size("_kept").cast("long").alias("kept_count"),
        F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("average_risk"),
        F.coalesce(
            F.array_max(F.transform("_sent", lambda s: s["risk"])), F.lit(0.0)
        ).alias("max_risk"),
        F.transform(
            F.filter("_sent", lambda s, i: ~rule(s, i)), lambda s: s["text"]
        ).alias("removed_sentences"),
    )
    return out if keep_columns else out.drop("_pii", "_sent", "_kept")


def privacy_metadata(df: DataFrame, col: str, kept: str, masked: str) -> DataFrame:
    """Densities, ratios and character counts from the columns of the erasure step."""
    chars = F.aggregate("_pii", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    touched = F.greatest(F.lit(1), F.col("removed_count") + F.col("kept_count"))
    return df.select(
        "*",
        F.size("_pii").cast("long").alias("pii_count"),
        (chars / F.greatest(F.lit(1), F.length(col))).alias("pii_density"),
        (F.col("removed_count") / touched).alias("removal_ratio"),
        F.length(col).cast("long").alias("original_characters"),
        F.length(kept).cast("long").alias("sanitized_characters"),
        F.length(masked).cast("long").alias("anonymized_characters"),
    )


def sanitize(
    df: DataFrame,
    col: str,
    query: str | None = None,
    threshold: float | str | Column = RISK_THRESHOLD,
    preserve: int = 1,
    tags: bool = True,
    passthrough: Sequence[str] = (),
    keywords: Sequence[str] = tuple(RISK_KEYWORDS),
    drop: bool = True,
) -> DataFrame:
    """Detect, erase risky sentences, mask what is left, and describe the result.

    Masking looks for patterns in the shortened text, so tags always sit on the
    data they hide.
    """
    erased = erase_high_risk(
        df, col, threshold, preserve, query, keywords, drop, keep_columns=True
    )
    masked = erased.withColumn(
        "masked_text", mask_text("kept_text", tags, passthrough)
    )
    described = privacy_metadata(masked, col, "kept_text", "masked_text")
    return described.withColumnRenamed("_pii", "pii").drop("_sent", "_kept")


def text_to_vector(col: str | Column, n: int = 256) -> Column:
    """First ``n`` UTF-8 bytes scaled to [0, 1], padded with zeros."""
    pairs = F.regexp_extract_all(
        F.hex(F.substring(F.encode(as_col(col), "UTF-8"), 1, n)), F.lit(".."), F.lit(0)
    )
    values = F.transform(
        pairs, lambda h: F.conv(h, 16, 10).cast("double") / F.lit(255.0)
    )
    return let(
        values, lambda v: F.concat(v, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(v)))
    )


def erasure_rows(df: DataFrame, key: str, col: str, **kwargs) -> DataFrame:
    """One row per sentence with its risk, for inspection."""
    rows = F.transform(
        scored_sentences(col, **kwargs),
        lambda s, i: F.struct(
            i.cast("long").alias("position"),
            s["text"].alias("sentence"),
            s["risk"].alias("risk"),
        ),
    )
    return inline_rows(df, [key], rows, "position")


def span_rows(df: DataFrame, key: str, col: str) -> DataFrame:
    """One row per detected span: ``key, entity_type, start, end``."""
    return inline_rows(df, [key], pii_spans(col), "start")
