"""Query routing, prompt rendering and response shaping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import as_col

# Domain words; a tie goes to the domain named first.
DOMAIN_KEYWORDS = {
    "financial": [
        "revenue",
        "profit",
        "earnings",
        "stock",
        "investment",
        "financial",
        "fiscal",
        "balance sheet",
        "income statement",
        "cash flow",
        "EBITDA",
        "ROI",
        "market cap",
        "dividend",
    ],
    "technical": [
        "algorithm",
        "code",
        "programming",
        "API",
        "database",
        "architecture",
        "deployment",
        "testing",
        "debug",
    ],
    "legal": [
        "contract",
        "law",
        "regulation",
        "compliance",
        "policy",
        "agreement",
        "terms",
        "legal",
        "litigation",
    ],
}
RETRIEVER_TYPES = ["default", "financial", "technical", "legal", "general"]

# Wording that decides how a question is rewritten.
SUBQUERY_WORDS = [" and ", " compare ", " respectively", " both ", " list and"]
STEPBACK_STARTS = ["how ", "why ", "explain ", "in what way"]

# Fixed value: a hyphen, a name, then one character outside the Han range.
NAME_PATTERN = "-(.*?)[^一-龥]"

# Default prompt bodies; callers may pass their own table of templates.
PROMPTS = {
    "qa": "Context:\n{context}\n\nAnswer from the context only.\nQuestion: {query_str}\nAnswer:",
    "hyde": "Write a short passage that would answer the question.\nQuestion: {query_str}\nPassage:",
    "stepback": "State a more general question behind this one.\nQuestion: {query_str}\nGeneral question:",
    "subquestion": "Tools:\n{tools_str}\n\nSplit the question into parts that one tool each can answer.\nQuestion: {query_str}",
}


def _hits(text: Column, words: Sequence[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w.lower())).cast("int")
    return total


def route_query(df: DataFrame, col: str, preference: str | None = None) -> DataFrame:
    """Add ``detected_domain``, ``retriever_type``, ``confidence``.

    The domain with the most keywords found wins. A valid user choice overrides
    it with confidence 1; otherwise the default retriever serves at 0.8.
    """
    scored = df
    for name, words in DOMAIN_KEYWORDS.items():
        scored = scored.withColumn(f"_{name}", _hits(F.lower(F.col(col)), words))
    names = [f"_{n}" for n in DOMAIN_KEYWORDS]
    best = F.greatest(*names)
    domain = F.when(best == 0, F.lit("default"))
    for name in DOMAIN_KEYWORDS:
        domain = domain.when(F.col(f"_{name}") == best, F.lit(name))
    out = scored.withColumn("detected_domain", domain).drop(*names)
    if preference is None:
        chosen = F.lit(False)
        pref = F.lit(None).cast("string")
    else:
        pref = F.col(preference)
        chosen = F.coalesce(pref.isin(RETRIEVER_TYPES), F.lit(False))
    return out.select(
        "*",
        F.when(chosen, pref).otherwise(F.lit("default")).alias("retriever_type"),
        F.when(chosen, F.lit(1.0)).otherwise(F.lit(0.8)).alias("confidence"),
    )


def transform_mode(col: str | Column) -> Column:
    """``subquery``, ``stepback`` or ``hyde`` for one question."""
    q = F.lower(as_col(col))
    compound = F.lit(False)
    for w in SUBQUERY_WORDS:
        compound = compound | F.contains(q, F.lit(w))
    opening = F.lit(False)
    for w in STEPBACK_STARTS:
        opening = opening | F.startswith(q, F.lit(w))
    return (
        F.when(compound, F.lit("subquery"))
        .when(opening, F.lit("stepback"))
        .otherwise(F.lit("hyde"))
    )


def choose_transform(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("transform_mode", transform_mode(col))


def render_template(template: str | Column, fields: Mapping[str, str | Column]) -> Column:
    """Fill ``{name}`` slots of a template with columns.

    The template is cut at its slots once, so a slot's name inside a value stays.
    """
    text = F.lit(template) if isinstance(template, str) else template
    slots = "|".join(re.escape("{" + name + "}") for name in fields)
    if not slots:
        return text
    names = F.regexp_extract_all(text, F.lit(f"({slots})"), F.lit(1))
    between = F.split(text, slots, -1)
    values = F.create_map(*[x for name, v in fields.items() for x in (F.lit("{" + name + "}"), as_col(v))])
    filled = F.transform(names, lambda slot, i: F.concat(values[slot], F.get(between, i + 1)))
    # A null value makes the whole text null, as it would in a concatenation.
    whole = F.concat(F.get(between, F.lit(0)), F.array_join(filled, ""))
    return F.when(~F.exists(filled, lambda x: x.isNull()), whole)


def render_prompts(
    df: DataFrame,
    mode: str,
    fields: Mapping[str, str | Column],
    templates: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``prompt``: the template named by column ``mode``, filled per row."""
    bodies = PROMPTS if templates is None else templates
    body = F.lit(None).cast("string")
    for name, text in bodies.items():
        body = F.when(F.col(mode) == name, F.lit(text)).otherwise(body)
    return df.withColumn("prompt", render_template(body, fields))


def ensemble_prompt(answers: Column, head: str, tail: str) -> Column:
    """Numbered sources between a head and a tail, one prompt per answer list."""
    numbered = F.transform(
        answers,
        lambda a, i: F.concat(
            F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), a, F.lit("\n\n")
        ),
    )
    return F.concat(F.lit(head), F.array_join(numbered, ""), F.lit(tail))


def append_original(df: DataFrame, generated: str, original: str) -> DataFrame:
    return df.withColumn(
        "rewritten", F.concat_ws(" ", F.col(generated), F.col(original))
    )


def extract_name(col: str | Column) -> Column:
    """First run after ``-`` up to the first character outside the Han range.

    Null where the text has no such run.
    """
    text = as_col(col)
    return F.when(
        F.rlike(text, F.lit(NAME_PATTERN)),
        F.btrim(F.regexp_extract(text, NAME_PATTERN, 1), F.lit("-")),
    )


def check_titles(df: DataFrame, title: str, text: str, suffix: str) -> DataFrame:
    return df.select(
        "*",
        F.endswith(F.col(title), F.lit(suffix)).alias("has_suffix"),
        F.concat(F.col(title), F.col(text)).alias("title_text"),
    )


def shape_sources(
    hits: DataFrame, n: int = 5, chars: int = 500, federated: bool = False
) -> DataFrame:
    """First ``n`` hits per query with shortened text.

    Federated replies carry no comparable score, so it is derived from the rank.
    """
    score = (
        F.lit(0.9) - F.lit(0.05) * (F.col("rank") - 1) if federated else F.col("score")
    )
    return (
        hits.filter(F.col("rank") <= n)
        .withColumn("score", score)
        .withColumn("text", F.substring("text", 1, chars))
    )
