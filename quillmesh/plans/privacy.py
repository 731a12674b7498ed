"""Privacy and query-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions.positions import bucket_positions
from quillmesh.operators import privacy, routing
from quillmesh.plans.common import query

_P = privacy.PII_PATTERNS
_SQL_PATTERNS = "(VALUES " + ", ".join(f"({i}, '{e}', '{p}')" for i, (e, p) in enumerate(_P.items())) + ") AS pats(ord, entity_type, p)"
_SQL_MASK = "{text}"
for _e in privacy.MASK_ORDER:
    _SQL_MASK = f"regexp_replace({_SQL_MASK}, '{_P[_e]}', '<{_e}>', 'g')"
_MASK_TEXT = _SQL_MASK.replace("{text}", "text")
_SQL_WORDS = " + ".join(
    f"CASE WHEN contains(lower(sentence), '{w}') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"
    for w in privacy.RISK_KEYWORDS
)
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"


def sql_spans(src: str, key: str) -> str:
    """CTE body: spans of every pattern with offsets."""
    one = " UNION ALL ".join(
        f"SELECT {key}, {i} AS ord, '{e}' AS entity_type, "
        f"regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS parts "
        f"FROM {src}"
        for i, (e, p) in enumerate(_P.items())
    )
    return f"""
SELECT {key}, entity_type, i,
  (list_sum(list_transform(parts[1:i], lambda x: length(x)))
   + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS "start",
  length(hits[i])::BIGINT AS len
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM ({one}))"""


def sql_sentences(src: str, key: str) -> str:
    """CTE body: trimmed non-blank sentences with offsets and positions."""
    return f"""
SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS position, sentence, s0 AS "start", s1 AS "end"
FROM (
  SELECT {key}, i, trim(body, {_WS}) AS sentence,
    (sum(gap + length(body)) OVER (PARTITION BY {key} ORDER BY i) - length(body))::BIGINT AS s0,
    (sum(gap + length(body)) OVER (PARTITION BY {key} ORDER BY i))::BIGINT AS s1
  FROM (
    SELECT {key}, i,
      CASE WHEN i = 1 THEN 0 ELSE strpos(piece, chr(2)) - 1 END AS gap,
      CASE WHEN i = 1 THEN piece ELSE substr(piece, strpos(piece, chr(2)) + 1) END AS body
    FROM (
      SELECT {key}, i, pieces[i] AS piece
      FROM (SELECT {key}, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM (
        SELECT {key}, string_split(regexp_replace(text, '([.!?\\n])(\\s+)', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(1)) AS pieces
        FROM {src})))))
WHERE sentence <> ''"""


def sql_risk(src: str, key: str, query_terms: bool) -> str:
    """CTE list ending in ``risky``: one row per sentence with its risk."""
    shared = ""
    if query_terms:
        shared = """ + CASE WHEN len(qt) > 0 THEN least(0.2::DOUBLE,
      len(list_filter(string_split_regex(sentence, '\\s+'), lambda t: t <> '' AND list_contains(qt, lower(t))))::DOUBLE / len(qt)) ELSE 0.0::DOUBLE END"""
        terms = f"""list_distinct(list_filter(string_split_regex(lower(query), '\\s+'), lambda t: t <> '')) AS qt"""
    else:
        terms = "NULL AS qt"
    return f"""
spans AS ({sql_spans(src, key)}),
sents AS ({sql_sentences(src, key)}),
covered AS (
  SELECT s.{key}, s.position, sum(greatest(0, least(s."end", p."start" + p.len) - greatest(s."start", p."start"))) AS c
  FROM sents s JOIN spans p ON s.{key} = p.{key} GROUP BY ALL),
terms AS (SELECT {key}, {terms} FROM {src}),
risky AS (
  SELECT s.{key}, s.position, s.sentence,
    least(1.0::DOUBLE, coalesce(c.c, 0)::DOUBLE / greatest(1, s."end" - s."start") + ({_SQL_WORDS})
      + least(0.3::DOUBLE, len(regexp_extract_all(sentence, '[0-9]'))::DOUBLE / greatest(1, length(sentence)) * 0.3::DOUBLE){shared}) AS risk
  FROM sents s LEFT JOIN covered c ON s.{key} = c.{key} AND s.position = c.position
  JOIN terms t ON s.{key} = t.{key})"""


def sql_sanitized(src: str, key: str, query_terms: bool = False, limit: str = "0.45::DOUBLE") -> str:
    masked = _SQL_MASK.replace("{text}", "kept_text")
    return f"""{sql_risk(src, key, query_terms)},
kept AS (
  SELECT {key}, count(*) AS n, count(*) FILTER (risk < {limit} OR position < 1) AS k,
    avg(risk) AS ar, max(risk) AS mr,
    string_agg(sentence, ' ' ORDER BY position) FILTER (risk < {limit} OR position < 1) AS kt
  FROM risky GROUP BY {key}),
pii AS (SELECT {key}, count(*) AS c, sum(len) AS chars FROM spans GROUP BY {key}),
done AS (
  SELECT d.{key}, d.text, coalesce(nullif(kt, ''), d.text) AS kept_text, coalesce(n - k, 0) AS removed_count, coalesce(k, 0) AS kept_count,
    coalesce(ar, 0.0) AS average_risk, coalesce(mr, 0.0) AS max_risk, coalesce(p.c, 0) AS pii_count,
    coalesce(p.chars, 0)::DOUBLE / greatest(1, length(d.text)) AS pii_density
  FROM {src} d LEFT JOIN kept USING ({key}) LEFT JOIN pii p USING ({key})),
sanitized AS (
  SELECT {key}, {masked} AS masked_text, removed_count, kept_count, pii_count,
    round(average_risk, 6) AS average_risk, round(max_risk, 6) AS max_risk, round(pii_density, 6) AS pii_density,
    round(removed_count::DOUBLE / greatest(1, removed_count + kept_count), 6) AS removal_ratio,
    length(text) AS original_characters, length(kept_text) AS sanitized_characters,
    length({masked}) AS anonymized_characters
  FROM done)"""


SANITIZED = [
    "masked_text",
    "removed_count",
    "kept_count",
    "pii_count",
    "average_risk",
    "max_risk",
    "pii_density",
    "removal_ratio",
    "original_characters",
    "sanitized_characters",
    "anonymized_characters",
]


def sanitized_columns(df, key):
    rounded = {"average_risk", "max_risk", "pii_density", "removal_ratio"}
    return df.select(
        key, *[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in SANITIZED]
    )


@query(
    "privacy_pii_counts",
    "SELECT doc_id, "
    + ", ".join(
        f"len(regexp_extract_all(text, '{p}')) AS {e.lower()}" for e, p in _P.items()
    )
    + " FROM documents",
)
def pii_counts(read):
    docs = read("documents").select("doc_id", "text")
    return privacy.pii_counts(docs, "text").drop("text")


@query(
    "privacy_pii_spans",
    f"""WITH spans AS ({sql_spans("documents", "doc_id")})
SELECT doc_id, entity_type, "start", "start" + len AS "end" FROM spans""",
)
def pii_spans(read):
    docs = read("documents").select("doc_id", "text")
    found = privacy.span_rows(docs, "doc_id", "text")
    return found.select(
        "doc_id",
        "entity_type",
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
    )


@query(
    "privacy_select_entities",
    f"""WITH spans AS ({sql_spans("documents", "doc_id")})
SELECT doc_id, count(*) AS n_all, count(*) FILTER (entity_type IN ('EMAIL_ADDRESS', 'US_SSN')) AS n_allowed
FROM spans GROUP BY doc_id""",
)
def select_entities(read):
    docs = privacy.detect_pii(read("documents").select("doc_id", "text"), "text")
    return docs.select(
        "doc_id",
        F.size(privacy.select_entities("pii", [], keep_all=True)).cast("long").alias("n_all"),
        F.size(privacy.select_entities("pii", ["EMAIL_ADDRESS", "US_SSN"]))
        .cast("long")
        .alias("n_allowed"),
    ).filter("n_all > 0")


@query(
    "privacy_mask_pii",
    f"SELECT doc_id, {_MASK_TEXT} AS masked_text FROM documents",
)
def mask_pii(read):
    docs = read("documents").select("doc_id", "text")
    return privacy.mask_pii(docs, "text").drop("text")


_REDACT = "text"
for _e in ("CREDIT_CARD", "US_SSN", "PHONE_NUMBER"):
    _REDACT = f"regexp_replace({_REDACT}, '{_P[_e]}', '<REDACTED>', 'g')"


@query(
    "privacy_mask_placeholder_passthrough",
    f"SELECT doc_id, {_REDACT} AS masked_text FROM documents",
)
def mask_placeholder(read):
    docs = read("documents").select("doc_id", "text")
    return privacy.mask_pii(
        docs, "text", tags=False, passthrough=["EMAIL_ADDRESS"]
    ).drop("text")


@query(
    "privacy_split_sentences",
    f"""WITH sents AS ({sql_sentences("documents", "doc_id")})
SELECT doc_id, position, sentence, "start", "end" FROM sents""",
)
def split_sentences(read):
    return privacy.split_sentences(read("documents").select("doc_id", "text"), "text")


@query(
    "privacy_sentence_risk",
    f"""WITH {sql_risk("documents", "doc_id", False)}
SELECT doc_id, position, round(risk, 6) AS risk FROM risky""",
)
def sentence_risk(read):
    rows = privacy.erasure_rows(read("documents"), "doc_id", "text")
    return rows.select("doc_id", "position", F.round("risk", 6).alias("risk"))


@query(
    "privacy_erase_high_risk",
    f"""WITH {sql_sanitized("documents", "doc_id", limit="0.2::DOUBLE")}
SELECT doc_id, kept_text, removed_count, kept_count, round(average_risk, 6) AS average_risk, round(max_risk, 6) AS max_risk FROM done""",
)
def erase_high_risk(read):
    docs = read("documents").select("doc_id", "text")
    out = privacy.erase_high_risk(docs, "text", threshold=0.2)
    return out.select(
        "doc_id",
        "kept_text",
        "removed_count",
        "kept_count",
        F.round("average_risk", 6).alias("average_risk"),
        F.round("max_risk", 6).alias("max_risk"),
    )


@query(
    "privacy_sanitize",
    f"WITH {sql_sanitized('documents', 'doc_id')} SELECT * FROM sanitized",
)
def sanitize(read):
    docs = read("documents").select("doc_id", "text")
    return sanitized_columns(privacy.sanitize(docs, "text"), "doc_id")


SQL_PAIRS = """
pairs AS (
  SELECT conv_id * 1000 + turn AS pair_id, conv_id, turn, text AS question, nxt AS answer
  FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole
        FROM conversations WHERE role IN ('user', 'assistant')
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nrole = 'assistant')"""


def dialogue_pairs(read):
    """User turns with the assistant turn that follows them.

    Turns of other roles in between don't count. Those that do are numbered without
    gaps, in buckets, so the next turn is an equality join and a conversation of any
    length spreads over all tasks.
    """
    spoken = read("conversations").filter("role in ('user', 'assistant')")
    bucket = F.floor(F.col("turn") / 4096)
    turns = bucket_positions(spoken, ["conv_id"], bucket, [F.col("turn").asc()], "_at", None)
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", "_at", F.col("text").alias("question")
    )
    replied = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("_at") - 1).alias("_at"), F.col("text").alias("answer")
    )
    return asked.join(replied, ["conv_id", "_at"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
        "conv_id",
        "turn",
        "question",
        "answer",
    )


@query(
    "privacy_sanitize_with_query",
    f"""WITH {SQL_PAIRS}, src AS (SELECT pair_id, answer AS text, question AS query FROM pairs),
{sql_sanitized("src", "pair_id", True)} SELECT * FROM sanitized""",
)
def sanitize_with_query(read):
    pairs = dialogue_pairs(read)
    return sanitized_columns(
        privacy.sanitize(pairs, "answer", query="question"), "pair_id"
    )


@query(
    "privacy_text_to_vector",
    """WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
c AS (SELECT doc_id, h, unnest(range(0, 256)) AS i FROM b)
SELECT doc_id, i::BIGINT AS idx,
  round(CASE WHEN 2 * i < length(h) THEN ('0x' || substr(h, 2 * i + 1, 2))::INTEGER / 255.0 ELSE 0.0 END::DOUBLE, 6) AS value FROM c""",
)
def text_to_vector(read):
    docs = read("documents").select(
        "doc_id", F.posexplode(privacy.text_to_vector("text")).alias("idx", "value")
    )
    return docs.select(
        "doc_id", F.col("idx").cast("long").alias("idx"), F.round("value", 6).alias("value")
    )


def _sql_score(words):
    return " + ".join(f"contains(lower(text), '{w.lower()}')::INT" for w in words)


@query(
    "query_route",
    f"""WITH s AS (SELECT conv_id, turn, {", ".join(f"({_sql_score(w)}) AS {n}" for n, w in routing.DOMAIN_KEYWORDS.items())} FROM conversations)
SELECT conv_id, turn, CASE WHEN greatest(financial, technical, legal) = 0 THEN 'default'
  WHEN financial >= technical AND financial >= legal THEN 'financial'
  WHEN technical >= legal THEN 'technical' ELSE 'legal' END AS detected_domain,
  'default' AS retriever_type, 0.8::DOUBLE AS confidence FROM s""",
)
def route(read):
    return routing.route_query(read("conversations"), "text").select(
        "conv_id", "turn", "detected_domain", "retriever_type", "confidence"
    )


@query(
    "query_route_preference",
    """SELECT doc_id, CASE WHEN source = 'src1' THEN 'legal' WHEN lang = 'en' THEN 'default' ELSE 'default' END AS retriever_type,
  CASE WHEN source = 'src1' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM documents""",
)
def route_preference(read):
    docs = read("documents").withColumn(
        "pref", F.when(F.col("source") == "src1", "legal").otherwise("unknown")
    )
    return routing.route_query(docs, "text", "pref").select(
        "doc_id", "retriever_type", "confidence"
    )


_SQL_MODE = f"""CASE WHEN {" OR ".join(f"contains(lower(text), '{w}')" for w in routing.SUBQUERY_WORDS)} THEN 'subquery'
 WHEN {" OR ".join(f"starts_with(lower(text), '{w}')" for w in routing.STEPBACK_STARTS)} THEN 'stepback' ELSE 'hyde' END"""


@query(
    "query_choose_transform",
    f"SELECT item_id, {_SQL_MODE} AS transform_mode FROM benchmark",
)
def choose_transform(read):
    return routing.choose_transform(read("benchmark"), "text").drop("text")


_TEMPLATES = {
    "subquery": "Tools: {tools_str} Question: {query_str}",
    "stepback": "General form of: {query_str}",
    "hyde": "Passage for: {query_str}",
}


@query(
    "query_render_prompts",
    f"""SELECT item_id, CASE {_SQL_MODE} WHEN 'subquery' THEN 'Tools: corpus Question: ' || text
  WHEN 'stepback' THEN 'General form of: ' || text ELSE 'Passage for: ' || text END AS prompt FROM benchmark""",
)
def render_prompts(read):
    moded = routing.choose_transform(read("benchmark"), "text")
    return routing.render_prompts(
        moded, "transform_mode", {"tools_str": F.lit("corpus"), "query_str": "text"}, _TEMPLATES
    ).select("item_id", "prompt")


@query(
    "query_append_original",
    f"WITH {SQL_PAIRS} SELECT pair_id, answer || ' ' || question AS rewritten FROM pairs",
)
def append_original(read):
    return routing.append_original(dialogue_pairs(read), "answer", "question").select(
        "pair_id", "rewritten"
    )


@query(
    "query_extract_name",
    """SELECT page_id, CASE WHEN regexp_matches(url, '-(.*?)[^一-龥]') THEN trim(regexp_extract(url, '-(.*?)[^一-龥]', 1), '-') END AS name
FROM pages""",
)
def extract_name(read):
    return read("pages").select("page_id", routing.extract_name("url").alias("name"))


@query(
    "query_check_titles",
    """SELECT doc_id, ends_with(source, '1') AS has_suffix, source || text AS title_text FROM documents""",
)
def check_titles(read):
    return routing.check_titles(read("documents"), "source", "text", "1").select(
        "doc_id", "has_suffix", "title_text"
    )
