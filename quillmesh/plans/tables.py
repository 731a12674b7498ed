"""Source formats, relational and feature-preparation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmesh.functions.positions import sorted_positions
from quillmesh.functions.text import sentences, ws_tokens
from quillmesh.operators import features, partitioning, relational
from quillmesh.plans.common import query
from quillmesh.plans.partitioning import sql_even, sql_pos
from quillmesh.plans.privacy import SQL_PAIRS, dialogue_pairs, sql_sentences
from quillmesh.plans.retrieval import sql_chunks, sql_tokens
from quillmesh.session import ensure_checkpoint_dir
from quillmesh.sources import corpus, reports, tables


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# ---------------------------------------------------------------- sources


def raw_corpus(read):
    """Every document as one nested JSON object: source -> sentences."""
    docs = read("documents").select("doc_id", "source", sentences("text").alias("s"))
    body = F.transform(
        "s",
        lambda x, i: F.struct(
            F.concat(F.lit("p"), i.cast("string")).alias("k"),
            F.struct(x.alias("page_content"), (F.col("doc_id") * 100000 + i).alias("index")).alias("v"),
        ),
    )
    return docs.select(
        F.to_json(F.create_map("source", F.map_from_entries(body))).alias("value"), "doc_id"
    )


@query(
    "source_corpus_flatten",
    f"""SELECT doc_id * 100000 + position AS id, '' AS title, sentence AS text FROM ({sql_sentences("documents", "doc_id")})""",
)
def corpus_flatten(read):
    parsed = raw_corpus(read).select(F.from_json("value", corpus.PASSAGES).alias("p"))
    return corpus.flatten_corpus(parsed, "p")


@query(
    "source_corpus_written",
    f"""SELECT doc_id * 100000 + position AS id, '' AS title, sentence AS text FROM ({sql_sentences("documents", "doc_id")})""",
)
def corpus_written(read):
    """The flat corpus as a reader finds it after it was written as JSON lines."""
    flat = corpus_flatten(read)
    spark = flat.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quillmesh-{uuid.uuid4().hex}"
    corpus.write_corpus(flat, path)
    return spark.read.schema("id bigint, title string, text string").json(path)


@query(
    "source_corpus_first_passages",
    f"""SELECT id, '' AS title, text FROM (SELECT doc_id, position, doc_id * 100000 + position AS id, sentence AS text FROM ({sql_sentences("documents", "doc_id")}))""",
)
def corpus_first(read):
    """The reader's path, which reads all passages unless a limit is asked for."""
    parsed = raw_corpus(read).select("doc_id", F.from_json("value", corpus.PASSAGES).alias("p"))
    return corpus.flatten_corpus(parsed, "p", "doc_id")


def qa_items(read):
    """Dialogue pairs in the layout of the question file."""
    pairs = dialogue_pairs(read)
    refs = sentences("answer")
    ids = F.transform(
        F.slice(refs, F.lit(1), F.greatest(F.size(refs) - 1, F.lit(1))),
        lambda x, i: F.col("pair_id") * 1000 + i,
    )
    return pairs.select(
        "pair_id",
        F.struct(
            "question",
            F.when(F.col("turn") == 0, F.lit("")).otherwise(F.col("answer")).alias("answer"),
            refs.alias("reference"),
            ids.alias("reference_idx"),
        ).alias("key_content"),
        F.struct(
            F.concat(F.lit("conv"), F.col("conv_id")).alias("doc_name"),
            F.concat(F.lit("turn"), F.col("turn")).alias("question_type"),
        ).alias("other_info"),
    )


_SQL_REFS = f"""{SQL_PAIRS}, src AS (SELECT pair_id, answer AS text FROM pairs),
se AS ({sql_sentences("src", "pair_id")}), cnt AS (SELECT pair_id, count(*) AS c FROM se GROUP BY ALL),
refs AS (SELECT pair_id * 1000 + position AS id, 'conv' || pair_id // 1000 AS title, sentence AS text FROM se JOIN cnt USING (pair_id) WHERE position < greatest(c - 1, 1))"""


@query("source_qa_references", f"WITH {_SQL_REFS} SELECT id, title, text FROM refs")
def qa_references(read):
    return corpus.explode_references(qa_items(read))


@query(
    "source_qa_load",
    f"""WITH {SQL_PAIRS}, src AS (SELECT pair_id, answer AS text FROM pairs), cnt AS (SELECT pair_id, count(*) AS c FROM ({sql_sentences("src", "pair_id")}) GROUP BY ALL)
SELECT question, answer, 'conv' || conv_id AS doc_name, 'turn' || turn AS question_type, coalesce(c, 0) AS n_refs FROM pairs LEFT JOIN cnt USING (pair_id) WHERE turn <> 0 AND answer <> ''""",
)
def qa_load(read):
    return corpus.load_qa(qa_items(read)).select(
        "question", "answer", "doc_name", "question_type",
        F.size("reference").cast("long").alias("n_refs"),
    )


@query(
    "source_build_corpus",
    f"""WITH {_SQL_REFS} SELECT id, title, text FROM refs
UNION ALL SELECT doc_id * 100000 + position AS id, '' AS title, sentence AS text FROM ({sql_sentences("documents", "doc_id")})""",
)
def build_corpus(read):
    return relational.build_corpus(corpus_flatten(read), qa_references(read))


@query(
    "source_multihop_load",
    f"""WITH tk AS ({sql_tokens("documents", "doc_id")}), se AS ({sql_sentences("documents", "doc_id")}), sl AS (SELECT doc_id, count(*) AS c FROM se GROUP BY ALL),
tt AS (SELECT doc_id, 0 AS p, toks[1] AS title, c FROM tk JOIN sl USING (doc_id) UNION ALL SELECT doc_id, 1, toks[-1], 1 FROM tk JOIN sl USING (doc_id)),
fi AS (SELECT title, min(doc_id * 1048576 + p) AS k, arg_min(c, doc_id * 1048576 + p) AS c FROM tt GROUP BY title)
SELECT title, row_number() OVER (ORDER BY k) - 1 AS title_id, coalesce(sum(c) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start", c AS n_sentences FROM fi""",
)
def multihop_load(read):
    docs = read("documents").select(
        "doc_id", ws_tokens("text").alias("t"), sentences("text").alias("s")
    ).filter(F.size("s") > 0)
    items = docs.select(
        "doc_id",
        F.struct(
            F.array(F.element_at("t", 1), F.element_at("t", -1)).alias("title"),
            F.array(F.col("s"), F.array(F.lit("tail"))).alias("sentences"),
        ).alias("context"),
    )
    out = corpus.load_multihop(items, "doc_id")
    return out.select(
        "title", "title_id", "start", F.size("sentences").cast("long").alias("n_sentences")
    )


@query(
    "source_delimited_ratings",
    "SELECT o_custkey AS user_id, o_orderkey AS item_id, o_totalprice AS rating FROM orders",
)
def delimited(read):
    lines = read("orders").select(
        F.concat_ws("::", "o_custkey", "o_orderkey", "o_totalprice").alias("line")
    )
    return tables.parse_delimited(lines, "line", "::", "user_id long, item_id long, rating double")


@query(
    "source_ucr_rows",
    "SELECT vec_id, label::BIGINT AS label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, len(embedding) AS n_values FROM embeddings",
)
def ucr(read):
    lines = read("embeddings").select(
        "vec_id",
        F.concat_ws(
            " ",
            (F.col("label") + 1).cast("string"),
            F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " "),
        ).alias("line"),
    )
    rows = tables.parse_ucr(lines, "line", "vec_id")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "vec_id", "label", F.round(total, 5).alias("total"), F.size("values").cast("long").alias("n_values")
    )


_ASSIGN = f"(SELECT o_orderkey, {sql_even('5')} AS client_id FROM {sql_pos('orders', 'o_orderkey')})"


def order_clients(read):
    return partitioning.split_iid(read("orders").select("o_orderkey"), "o_orderkey", 5)


@query(
    "source_assignment_lists",
    f"""SELECT client_id, o_orderkey // 65536 AS part, count(*) AS n_rows, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS rows_text FROM {_ASSIGN} GROUP BY ALL""",
)
def assignment_lists(read):
    lists = tables.assignment_lists(order_clients(read), "o_orderkey")
    return lists.select(
        "client_id",
        "part",
        F.size("data").cast("long").alias("n_rows"),
        F.array_join(F.transform("data", lambda x: x.cast("string")), ",").alias("rows_text"),
    )


@query("source_assignment_roundtrip", f"SELECT o_orderkey, client_id FROM {_ASSIGN}")
def assignment_roundtrip(read):
    lists = tables.assignment_lists(order_clients(read), "o_orderkey")
    return tables.explode_assignment(lists, "o_orderkey")


@query(
    "source_run_records",
    """SELECT 'run' || o_orderkey AS run_id, o_orderpriority AS seed, 'price' AS name, 0 AS round, o_totalprice AS value FROM orders WHERE starts_with('run' || o_orderkey, 'run1')
UNION ALL SELECT 'run' || o_orderkey, o_orderpriority, 'price', 1, o_totalprice / 2 FROM orders WHERE starts_with('run' || o_orderkey, 'run1')
UNION ALL SELECT 'run' || o_orderkey, o_orderpriority, 'key', 0, o_custkey::DOUBLE FROM orders WHERE starts_with('run' || o_orderkey, 'run1')""",
)
def run_records(read):
    raw = read("orders").select(
        F.concat(F.lit("run"), F.col("o_orderkey")).alias("file"),
        F.to_json(
            F.struct(
                F.create_map(F.lit("seed"), "o_orderpriority").alias("option"),
                F.create_map(
                    F.lit("price"),
                    F.array(F.col("o_totalprice"), F.col("o_totalprice") / 2),
                    F.lit("key"),
                    F.array(F.col("o_custkey").cast("double")),
                ).alias("metrics"),
            )
        ).alias("value"),
    )
    runs = tables.parse_runs(raw, "value", "file", ["run1"])
    long = tables.run_metrics(runs)
    return long.join(runs.select("run_id", tables.option("seed").alias("seed")), "run_id")


@query(
    "sink_report_lines",
    """SELECT event_type || ': ' || printf('%.4f', avg(value)) || ', valid number : ' || count(value) AS value FROM events GROUP BY event_type""",
)
def report_lines(read):
    stats = read("events").groupBy(F.col("event_type").alias("metric")).agg(
        F.avg("value").alias("mean"), F.count("value").alias("n_valid")
    )
    return reports.report_lines(stats)


def chat_messages(read):
    """Messages with privacy figures taken from the texts."""
    digits = F.regexp_count("text", F.lit("[0-9]"))
    return read("conversations").select(
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("content"),
        F.concat(F.lit("t"), F.col("turn")).alias("timestamp"),
        (digits > 0).alias("privacy_applied"),
        digits.alias("pii_detected"),
        F.pmod("turn", F.lit(3)).cast("int").alias("sentences_removed"),
        (F.length("text") / 100.0 * (F.col("turn") % 2)).alias("response_time"),
    )


_SQL_CHAT = """(SELECT conv_id, turn, role, text AS content, 't' || turn AS timestamp, len(regexp_extract_all(text, '[0-9]')) > 0 AS privacy_applied,
 len(regexp_extract_all(text, '[0-9]')) AS pii_detected, (turn % 3)::INT AS sentences_removed, length(text) / 100.0::DOUBLE * (turn % 2) AS response_time FROM conversations)"""


@query(
    "sink_chat_markdown",
    f"""SELECT conv_id, turn, '## ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ' (' || timestamp || ')' || chr(10) || content || chr(10)
 || CASE WHEN role = 'assistant' AND privacy_applied THEN chr(10) || '**Privacy Stats:**' || chr(10) || '- PII Detected: ' || pii_detected || chr(10) || '- Sentences Removed: ' || sentences_removed || chr(10) ELSE '' END
 || chr(10) || '---' || chr(10) || chr(10) AS value FROM {_SQL_CHAT}""",
)
def chat_markdown(read):
    return reports.chat_lines(chat_messages(read), "markdown")


@query(
    "sink_chat_json",
    "SELECT conv_id, turn, role, text AS content FROM conversations",
)
def chat_json(read):
    lines = reports.chat_lines(chat_messages(read).select("conv_id", "turn", "role", "content"))
    back = lines.select("conv_id", "turn", F.from_json("value", "role string, content string").alias("m"))
    return back.select("conv_id", "turn", "m.role", "m.content")


# ---------------------------------------------------------------- relational


@query(
    "join_gold_ids",
    """WITH w AS (SELECT DISTINCT l_orderkey AS qa_id, l_suppkey AS title FROM lineitem),
t AS (SELECT s_suppkey AS title, s_nationkey AS doc_id FROM supplier WHERE s_acctbal > 0)
SELECT qa_id, title, doc_id FROM w JOIN t USING (title) WHERE qa_id NOT IN (SELECT qa_id FROM w WHERE title NOT IN (SELECT title FROM t))""",
)
def gold_ids(read):
    qa = read("lineitem").groupBy(F.col("l_orderkey").alias("qa_id")).agg(
        F.collect_set("l_suppkey").alias("titles")
    )
    known = read("supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("title"), F.col("s_nationkey").alias("doc_id")
    )
    return relational.gold_ids(qa, known)


@query(
    "join_filter_links",
    """WITH u AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal > 0)
SELECT o_custkey AS trustor, o_orderkey AS trustee FROM orders WHERE o_custkey IN (SELECT user_id FROM u) AND o_orderkey IN (SELECT user_id FROM u)""",
)
def filter_links(read):
    users = read("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    links = read("orders").select(
        F.col("o_custkey").alias("trustor"), F.col("o_orderkey").alias("trustee")
    )
    return relational.filter_links(links, users)


@query(
    "join_client_rows",
    f"SELECT o_orderkey, client_id, o_totalprice FROM orders JOIN {_ASSIGN} a USING (o_orderkey)",
)
def client_rows(read):
    data = read("orders").select("o_orderkey", "o_totalprice")
    return relational.client_rows(data, order_clients(read), "o_orderkey")


@query(
    "join_option_grid",
    """SELECT a.o_orderpriority AS priority, b.o_orderstatus AS status, c.event_type FROM (SELECT DISTINCT o_orderpriority FROM orders) a,
(SELECT DISTINCT o_orderstatus FROM orders) b, (SELECT DISTINCT event_type FROM events) c""",
)
def option_grid(read):
    kinds = read("events").agg(F.collect_set("event_type")).scalar()
    lists = read("orders").agg(
        F.collect_set("o_orderpriority").alias("priority"),
        F.collect_set("o_orderstatus").alias("status"),
    ).withColumn("event_type", kinds)
    return relational.option_grid(lists, ["priority", "status", "event_type"])


# ---------------------------------------------------------------- features


@query(
    "feature_minmax",
    """SELECT p_partkey, round((p_size - a) / (b - a)::DOUBLE, 6) AS p_size, round((trunc(p_retailprice) - c) / (d - c)::DOUBLE, 6) AS p_retailprice
FROM part, (SELECT min(p_size) AS a, max(p_size) AS b, min(trunc(p_retailprice)) AS c, max(trunc(p_retailprice)) AS d FROM part)""",
)
def minmax(read):
    rows = read("part").select("p_partkey", "p_size", "p_retailprice")
    scaled = features.minmax(rows, ["p_size", "p_retailprice"], as_int=True)
    return scaled.select("p_partkey", *r6("p_size", "p_retailprice"))


@query(
    "feature_binarize",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem",
)
def binarize(read):
    out = features.binarize(read("lineitem"), "l_returnflag", "R")
    return out.select("l_orderkey", "l_linenumber", "label")


@query(
    "feature_one_hot",
    """WITH k AS (SELECT list_sort(list(DISTINCT v)) AS k FROM (SELECT o_orderpriority AS v FROM orders UNION SELECT c_mktsegment FROM customer))
SELECT o_orderkey, array_to_string(list_transform(k, lambda v: CASE WHEN v = o_orderpriority THEN 1 ELSE 0 END), '') AS code FROM orders, k""",
)
def one_hot(read):
    rows = read("orders").select("o_orderkey", "o_orderpriority")
    other = read("customer").select(F.col("c_mktsegment").alias("o_orderpriority"))
    out = features.one_hot(rows, ["o_orderpriority"], other)
    code = F.array_join(F.transform("o_orderpriority_onehot", lambda x: x.cast("string")), "")
    return out.select("o_orderkey", code.alias("code"))


@query(
    "feature_recode",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 99999999 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey > 0 THEN 1 ELSE c_nationkey END AS c_nationkey FROM customer""",
)
def recode(read):
    rows = read("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return features.recode(
        rows,
        [
            ("c_acctbal", F.col("c_acctbal") < 0, 99999999.0),
            ("c_nationkey", F.col("c_nationkey") > 0, 1),
        ],
    )


@query(
    "feature_reindex",
    f"SELECT o_orderkey, pos AS user_index FROM orders JOIN {sql_pos('(SELECT DISTINCT o_custkey FROM orders)', 'o_custkey')} USING (o_custkey)",
)
def reindex(read):
    rows = read("orders").select("o_orderkey", "o_custkey")
    return features.reindex(rows, "o_custkey", out="user_index").drop("o_custkey")


SQL_SERIES = """hr AS (SELECT event_type AS sensor, (epoch(date_trunc('hour', ts)) // 3600)::BIGINT AS h, avg(round(value * 100)::BIGINT) AS value FROM events GROUP BY ALL),
sr AS (SELECT sensor, row_number() OVER (PARTITION BY sensor ORDER BY h) - 1 AS t, value FROM hr)"""


def series(read):
    """Mean value per hour and event type; hours without events are skipped."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    hourly = read("events").groupBy(F.col("event_type").alias("sensor"), hour.alias("h")).agg(
        # Cents add up exactly in any order.
        F.avg(F.round(F.col("value") * 100).cast("long")).alias("value")
    )
    placed = sorted_positions(hourly, ["h"], ["sensor"], "t", None)
    return placed.select("sensor", "t", "value")


@query(
    "feature_normalize_global",
    f"WITH {SQL_SERIES} SELECT sensor, t, round(value / (SELECT max(value) FROM sr), 6) AS value FROM sr",
)
def normalize_global(read):
    return features.normalize_series(series(read), 1).select("sensor", "t", *r6("value"))


@query(
    "feature_normalize_sensor",
    f"WITH {SQL_SERIES} SELECT sensor, t, round(value / max(abs(value)) OVER (PARTITION BY sensor), 6) AS value FROM sr",
)
def normalize_sensor(read):
    return features.normalize_series(series(read), 2).select("sensor", "t", *r6("value"))


@query(
    "feature_series_windows",
    f"""WITH {SQL_SERIES}, w AS (SELECT sensor, t, value AS y, list(value) OVER (PARTITION BY sensor ORDER BY t ROWS BETWEEN 35 PRECEDING AND 12 PRECEDING) AS x, (SELECT max(t) + 1 FROM sr) AS n FROM sr)
SELECT sensor, t, y, array_to_string(list_transform(x, lambda v: floor(v * 8)::BIGINT::VARCHAR), ' ') AS x_text, CASE WHEN t < floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS part FROM w WHERE len(x) = 24""",
)
def series_windows(read):
    out = features.series_windows(series(read), 24, 12, width=128)
    text = F.array_join(F.transform("x", lambda v: F.floor(v * 8).cast("string")), " ")
    return out.select("sensor", "t", "y", text.alias("x_text"), "part")


@query(
    "feature_lm_sequences",
    f"""WITH tk AS (SELECT item_id, unnest(toks) AS tok, unnest(range(0, len(toks))) AS i FROM ({sql_tokens("benchmark", "item_id")})),
g AS (SELECT tok, row_number() OVER (ORDER BY item_id, i) - 1 AS p, count(*) OVER () AS n FROM tk),
w AS (SELECT p, n, list(tok) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s FROM g)
SELECT p AS "start", array_to_string(s[1:5], ' ') AS x_text, array_to_string(s[2:6], ' ') AS y_text FROM w WHERE p % 2 = 0 AND p < n - 6""",
)
def lm_sequences(read):
    out = features.lm_sequences(read("benchmark"), "item_id", "text", 5, 2, block=256)
    return out.select(
        F.col("start").cast("long").alias("start"),
        F.array_join("x", " ").alias("x_text"),
        F.array_join("y", " ").alias("y_text"),
    )
