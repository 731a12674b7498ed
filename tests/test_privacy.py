import re

from pyspark.sql import functions as F

from quillmesh.functions.text import sentence_spans
from quillmesh.operators import aggregation, privacy, routing

TEXTS = [
    "Write to ann.b+c@mail.example.org now. Call +1 555-123-4567!\nBye.",
    "My ssn is 123-45-6789. The password is secret, keep it private. Fine day.",
    "Card 4111 1111 1111 1111 expires.  Second line\n\nthird? Yes.",
    "   ",
    "",
    "No data here",
    "1234567\n 8 crosses a break. Ok.",
    "Ünïcode näme@host.de x. Ärger 12345678 überall.",
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def brute_spans(text):
    if not text.strip():
        return []
    return [
        (e, m.start(), m.end())
        for e, p in privacy.PII_PATTERNS.items()
        for m in re.finditer(p, text, re.ASCII)
    ]


def brute_sentences(text):
    out, at = [], 0
    for m in list(re.finditer(privacy_break(), text)) + [None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            out.append((text[at:end].strip(), at, end))
        at = m.end() if m else end
    return out


def privacy_break():
    return r"(?<=[.!?\n])[ \t\n\r\f]+"


def brute_risk(sentence, spans, query):
    text, start, end = sentence
    inside = sum(max(0, min(end, b) - max(start, a)) for _, a, b in spans)
    risk = inside / max(1, end - start)
    risk += 0.2 * sum(w in text.lower() for w in privacy.RISK_KEYWORDS)
    risk += min(0.3, 0.3 * sum(c in "0123456789" for c in text) / len(text))
    terms = {t.lower() for t in query.split()}
    if terms:
        risk += min(0.2, sum(t.lower() in terms for t in text.split()) / len(terms))
    return min(1.0, risk)


def test_spans_match_regex(spark):
    rows = privacy.detect_pii(frame(spark), "text").collect()
    for r in rows:
        got = [(s.entity_type, s.start, s.end) for s in r.pii]
        assert got == brute_spans(r.text)


def test_sentences_match(spark):
    rows = privacy.split_sentences(frame(spark), "text").orderBy("id", "position").collect()
    for i, text in enumerate(TEXTS):
        got = [(r.sentence, r.start, r.end) for r in rows if r.id == i]
        assert got == brute_sentences(text)


def test_risk_and_erasure(spark):
    query = "is secret Call day"
    df = frame(spark).withColumn("q", F.lit(query))
    rows = privacy.sanitize(df, "text", query="q", threshold=0.3).collect()
    for r in rows:
        spans, sents = brute_spans(r.text), brute_sentences(r.text)
        risks = [brute_risk(s, spans, query) for s in sents]
        kept = [s[0] for i, s in enumerate(sents) if risks[i] < 0.3 or i == 0]
        assert r.kept_text == (" ".join(kept) or r.text)
        assert r.removed_count == len(sents) - len(kept)
        assert abs(r.average_risk - (sum(risks) / len(risks) if risks else 0)) < 1e-9
        assert abs(r.max_risk - max(risks, default=0)) < 1e-9
        density = sum(b - a for _, a, b in spans) / max(1, len(r.text))
        assert abs(r.pii_density - density) < 1e-9


def test_nothing_left_after_masking(spark):
    for r in privacy.mask_pii(frame(spark), "text").collect():
        assert brute_spans(r.masked_text) == []


def test_mask_options(spark):
    df = spark.createDataFrame([("a@b.co or 123-45-6789",)], "text string")
    row = privacy.mask_pii(df, "text").first()
    assert row.masked_text == "<EMAIL_ADDRESS> or <US_SSN>"
    row = privacy.mask_pii(df, "text", tags=False, passthrough=["EMAIL_ADDRESS"]).first()
    assert row.masked_text == "a@b.co or <REDACTED>"


def test_keep_all_when_dropping_is_off(spark):
    df = spark.createDataFrame([("Fine. password secret private.",)], "text string")
    row = privacy.erase_high_risk(df, "text", drop=False).first()
    assert row.removed_count == 0


def test_vector(spark):
    df = spark.createDataFrame([("é" * 3 + "a",), ("",), ("x" * 300,)], "text string")
    got = [r.v for r in df.select(privacy.text_to_vector("text").alias("v")).collect()]
    for text, v in zip(["é" * 3 + "a", "", "x" * 300], got):
        raw = [b / 255 for b in text.encode()][:256]
        assert v == raw + [0.0] * (256 - len(raw))


def test_threshold_is_clipped(spark):
    df = spark.createDataFrame(
        [(0.1, 0.0, 0.2, 10), (0.1, 0.5, 0.4, 30)],
        "pii_density double, removal_ratio double, average_risk double, anonymized_characters long",
    )
    row = aggregation.privacy_threshold(df).first()
    assert row.threshold == 0.25 and abs(row.average_risk - 0.35) < 1e-12
    empty = aggregation.privacy_threshold(df.filter("false")).first()
    assert empty.pii_density == 0.0 and empty.threshold == 0.25


def test_routing_ties_and_choice(spark):
    df = spark.createDataFrame(
        [("profit law", None), ("code and law code", None), ("hello", "legal"), ("hello", "bad")],
        "q string, pref string",
    )
    rows = routing.route_query(df, "q", "pref").collect()
    assert [r.detected_domain for r in rows] == ["financial", "technical", "default", "default"]
    assert [r.retriever_type for r in rows] == ["default", "default", "legal", "default"]
    assert [r.confidence for r in rows] == [0.8, 0.8, 1.0, 0.8]


def test_transform_mode_and_names(spark):
    df = spark.createDataFrame(
        [("How is it",), ("a and b",), ("In what way",), ("what",)], "q string"
    )
    got = [r[0] for r in df.select(routing.transform_mode("q")).collect()]
    assert got == ["stepback", "subquery", "stepback", "hyde"]
    df = spark.createDataFrame([("x-民法第1条",), ("none",)], "t string")
    assert [r[0] for r in df.select(routing.extract_name("t")).collect()] == ["民法第", None]


def test_offsets_of_long_texts(spark):
    """Spans fit the text on both sides of the fold's block size, and long texts finish."""
    texts = [" ".join(f"Word{k} no. {k}." + " " * (k % 3) for k in range(n)) for n in (0, 1, 127, 128, 129, 300, 100_000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for r in df.select("text", sentence_spans("text").alias("s")).collect():
        assert all(r.text[s.start : s.end].strip() == s.text for s in r.s)
        assert [s.text for s in r.s] == [p.strip() for p in re.split(r"(?<=[.!?\n])\s+", r.text) if p.strip()]
