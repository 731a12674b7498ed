"""Parameter, metric and run-analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions.positions import sorted_positions
from quillmesh.operators import aggregation, privacy, run_analysis
from quillmesh.plans.common import query
from quillmesh.plans.privacy import SQL_PAIRS, dialogue_pairs, sql_sanitized
from quillmesh.plans.tables import _SQL_CHAT, chat_messages


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def r9(*names):
    """Means of two-decimal values over 2^k rows tie at six digits."""
    return [F.round(n, 9).alias(n) for n in names]


# ---------------------------------------------------------------- parameters

# One client per label: its parameters are the summed vectors of the label.
SQL_PARAMS = """vec AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
pa AS (SELECT label AS client_id, 'layer' || (i - 1) // 16 AS layer, (i - 1) % 16 AS idx, avg(x) AS value FROM vec GROUP BY ALL),
vo AS (SELECT label AS client_id, count(*) AS n FROM embeddings GROUP BY ALL UNION ALL SELECT 99, 25),
sh AS (SELECT client_id, n::DOUBLE / sum(n) OVER () AS p, count(*) OVER () AS nc FROM vo),
old AS (SELECT layer, idx, min(value) AS value FROM pa GROUP BY ALL)"""


def params(read):
    rows = read("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy(
        F.col("label").alias("client_id"),
        F.concat(F.lit("layer"), F.floor(F.col("i") / 16)).alias("layer"),
        F.pmod("i", F.lit(16)).cast("long").alias("idx"),
    ).agg(F.avg(F.col("x").cast("double")).alias("value"))


def volumes(read):
    """Rows per client, with one client that sent nothing."""
    emb = read("embeddings")
    held = emb.groupBy(F.col("label").alias("client_id")).agg(F.count(F.lit(1)).alias("n"))
    absent = emb.agg(F.lit(99).alias("client_id"), F.lit(25).cast("long").alias("n"))
    return held.unionByName(absent)


def old_params(read):
    return params(read).groupBy("layer", "idx").agg(F.min("value").alias("value"))


@query(
    "params_uniform",
    f"WITH {SQL_PARAMS} SELECT layer, idx, round(avg(value), 6) AS value FROM pa GROUP BY ALL",
)
def uniform(read):
    return aggregation.aggregate_params(params(read)).select("layer", "idx", *r6("value"))


@query(
    "params_weighted_scale",
    f"WITH {SQL_PARAMS} SELECT layer, idx, round(sum(p * value) * any_value(nc) / count(*), 6) AS value FROM pa JOIN sh USING (client_id) GROUP BY ALL",
)
def weighted_scale(read):
    out = aggregation.aggregate_params(params(read), "weighted_scale", volumes(read))
    return out.select("layer", "idx", *r6("value"))


@query(
    "params_weighted_com",
    f"""WITH {SQL_PARAMS}, s AS (SELECT layer, idx, sum(p * value) AS pv, sum(p) AS p FROM pa JOIN sh USING (client_id) GROUP BY ALL)
SELECT layer, idx, round((1 - p) * value + pv, 6) AS value FROM s JOIN old USING (layer, idx)""",
)
def weighted_com(read):
    out = aggregation.aggregate_params(
        params(read), "weighted_com", volumes(read), old_params(read)
    )
    return out.select("layer", "idx", *r6("value"))


@query(
    "params_weighted",
    f"WITH {SQL_PARAMS} SELECT layer, idx, round(sum(p * value) / sum(p), 6) AS value FROM pa JOIN sh USING (client_id) GROUP BY ALL",
)
def weighted(read):
    out = aggregation.aggregate_params(params(read), "weighted", volumes(read))
    return out.select("layer", "idx", *r6("value"))


@query(
    "params_drop_nan_clients",
    f"""WITH {SQL_PARAMS}, b AS (SELECT client_id, layer, idx, CASE WHEN client_id = 3 AND idx = 5 THEN 'nan'::DOUBLE ELSE value END AS value FROM pa)
SELECT client_id, layer, idx, round(value, 6) AS value FROM b WHERE client_id NOT IN (SELECT client_id FROM b WHERE isnan(value))""",
)
def drop_nan(read):
    hurt = params(read).withColumn(
        "value",
        F.when((F.col("client_id") == 3) & (F.col("idx") == 5), F.lit(float("nan"))).otherwise(F.col("value")),
    )
    return aggregation.drop_nan_clients(hurt).select("client_id", "layer", "idx", *r6("value"))


def _two(read):
    mean = aggregation.aggregate_params(params(read))
    return mean, old_params(read)


_SQL_TWO = f"{SQL_PARAMS}, m AS (SELECT layer, idx, avg(value) AS value FROM pa GROUP BY ALL)"

for _op, _sign in {"add": "+", "sub": "-", "mul": "*", "div": "/"}.items():

    def _run(read, op=_op):
        a, b = _two(read)
        return aggregation.param_op(a, b, op).select("layer", "idx", *r6("value"))

    query(
        f"params_{_op}",
        f"WITH {_SQL_TWO} SELECT layer, idx, round(m.value {_sign} old.value, 6) AS value FROM m JOIN old USING (layer, idx)",
    )(_run)


@query(
    "params_scale",
    f"WITH {_SQL_TWO} SELECT layer, idx, round(value * 0.5::DOUBLE, 6) AS value FROM m",
)
def scale(read):
    out = aggregation.param_map(_two(read)[0], lambda v: v * 0.5)
    return out.select("layer", "idx", *r6("value"))


@query(
    "params_sum",
    f"WITH {SQL_PARAMS} SELECT layer, idx, round(sum(value), 6) AS value FROM pa GROUP BY ALL",
)
def param_sum(read):
    return aggregation.param_sum(params(read)).select("layer", "idx", *r6("value"))


@query(
    "params_norm",
    f"WITH {SQL_PARAMS} SELECT client_id, round(sqrt(sum(value ** 2)), 6) AS norm FROM pa GROUP BY ALL",
)
def norm(read):
    return aggregation.param_norm(params(read), by=["client_id"]).select("client_id", *r6("norm"))


@query(
    "params_dot",
    f"WITH {_SQL_TWO} SELECT round(sum(m.value * old.value), 6) AS dot FROM m JOIN old USING (layer, idx)",
)
def dot(read):
    return aggregation.param_dot(*_two(read)).select(*r6("dot"))


@query(
    "params_cosine",
    f"WITH {_SQL_TWO} SELECT round(sum(m.value * old.value) / (sqrt(sum(m.value ** 2)) * sqrt(sum(old.value ** 2))), 6) AS cosine FROM m JOIN old USING (layer, idx)",
)
def cosine(read):
    return aggregation.param_cosine(*_two(read)).select(*r6("cosine"))


@query(
    "params_count",
    f"WITH {SQL_PARAMS} SELECT client_id, count(value) AS n_params FROM pa GROUP BY ALL",
)
def count(read):
    return aggregation.param_count(params(read), ["client_id"])


@query(
    "params_proximal",
    f"WITH {SQL_PARAMS} SELECT client_id, round(0.05::DOUBLE * sum((pa.value - old.value) ** 2), 6) AS distance FROM pa JOIN old USING (layer, idx) GROUP BY client_id",
)
def proximal(read):
    out = aggregation.proximal(params(read), old_params(read), 0.1)
    return out.select("client_id", *r6("distance"))


# ---------------------------------------------------------------- roll-ups


@query(
    "rollup_privacy_threshold",
    f"""WITH {sql_sanitized("documents", "doc_id")},
s AS (SELECT sum(pii_density * anonymized_characters) / sum(anonymized_characters) AS pii_density, sum(removal_ratio * anonymized_characters) / sum(anonymized_characters) AS removal_ratio,
  sum(average_risk * anonymized_characters) / sum(anonymized_characters) AS average_risk FROM sanitized)
SELECT round(pii_density, 4) AS pii_density, round(removal_ratio, 4) AS removal_ratio, round(average_risk, 4) AS average_risk, round(greatest(0.25::DOUBLE, least(0.85::DOUBLE, pii_density)), 4) AS threshold FROM s""",
)
def threshold(read):
    out = aggregation.privacy_threshold(
        privacy.sanitize(read("documents").select("doc_id", "text"), "text")
    )
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query(
    "rollup_client_metrics",
    """WITH d AS (SELECT (event_id // 1000)::BIGINT AS round, event_type AS metric, user_id % 7 AS client_id, avg(round(value * 100)::BIGINT) AS value, count(*) AS n FROM events GROUP BY ALL)
SELECT round, metric, round(sum(value * n) / sum(n), 6) AS weighted_mean, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
 array_to_string(list_transform(list(value ORDER BY client_id), lambda v: floor(v * 8)::BIGINT::VARCHAR), ' ') AS values_text FROM d GROUP BY round, metric""",
)
def client_metrics(read):
    rows = read("events").groupBy(
        F.floor(F.col("event_id") / 1000).alias("round"),
        F.col("event_type").alias("metric"),
        F.pmod("user_id", F.lit(7)).alias("client_id"),
    ).agg(F.avg(F.round(F.col("value") * 100).cast("long")).alias("value"), F.count(F.lit(1)).alias("n"))
    out = aggregation.rollup_metrics(rows)
    text = F.array_join(F.transform("values", lambda v: F.floor(v * 8).cast("string")), " ")
    return out.select("round", "metric", *r6("weighted_mean", "mean", "std"), text.alias("values_text"))


@query(
    "rollup_valid_mean",
    "SELECT event_type AS metric, round(avg(value) FILTER (value < 15), 6) AS mean, count(*) FILTER (value < 15) AS n_valid FROM events GROUP BY ALL",
)
def valid_mean(read):
    rows = read("events").select(
        F.col("event_type").alias("metric"), "value", (F.col("value") < 15).alias("ok")
    )
    return aggregation.valid_mean(rows, "value", "ok").select("metric", *r6("mean"), "n_valid")


@query(
    "rollup_category_averages",
    """WITH b AS (SELECT l_returnflag, round(l_quantity)::BIGINT AS l_quantity, round(l_discount * 100)::BIGINT AS l_discount, round(l_tax * 100)::BIGINT AS l_tax FROM lineitem),
a AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM b GROUP BY ALL
UNION ALL SELECT NULL, count(*), avg(l_quantity), avg(l_discount), avg(l_tax) FROM b)
SELECT l_returnflag, n, 'l_quantity' AS metric, round(l_quantity, 6) AS mean FROM a UNION ALL SELECT l_returnflag, n, 'l_discount', round(l_discount, 6) FROM a UNION ALL SELECT l_returnflag, n, 'l_tax', round(l_tax, 6) FROM a""",
)
def category(read):
    # Whole numbers add up exactly in any order.
    rows = read("lineitem").select(
        "l_returnflag",
        F.round("l_quantity").cast("long").alias("l_quantity"),
        F.round(F.col("l_discount") * 100).cast("long").alias("l_discount"),
        F.round(F.col("l_tax") * 100).cast("long").alias("l_tax"),
    )
    out = aggregation.category_averages(
        rows, "l_returnflag", ["l_quantity", "l_discount", "l_tax"]
    )
    return out.select("l_returnflag", "n", "metric", *r6("mean"))


_CHAT_AGG = """count(*) AS total_messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages,
 coalesce(sum(pii_detected) FILTER (role = 'assistant'), 0)::BIGINT AS total_pii_detected, coalesce(sum(sentences_removed) FILTER (role = 'assistant'), 0)::BIGINT AS total_sentences_removed,
 round(coalesce(avg(response_time) FILTER (role = 'assistant' AND response_time <> 0), 0), 6) AS avg_response_time, count(*) FILTER (role = 'assistant' AND privacy_applied) AS privacy_applied_count"""


@query("rollup_chat_stats", f"SELECT {_CHAT_AGG} FROM {_SQL_CHAT}")
def chat_stats(read):
    out = aggregation.chat_stats(chat_messages(read))
    return out.withColumn("avg_response_time", F.round("avg_response_time", 6))


@query(
    "rollup_chat_stats_by_conversation",
    f"SELECT conv_id, {_CHAT_AGG} FROM {_SQL_CHAT} GROUP BY conv_id",
)
def chat_stats_by(read):
    out = aggregation.chat_stats(chat_messages(read), ["conv_id"])
    return out.withColumn("avg_response_time", F.round("avg_response_time", 6))


@query(
    "rollup_merge_privacy",
    f"""WITH {SQL_PAIRS}, src AS (SELECT pair_id, question AS text FROM pairs), {sql_sanitized("src", "pair_id").replace("sanitized AS", "sq AS")},
src2 AS (SELECT pair_id, answer AS text FROM pairs), """
    + sql_sanitized("src2", "pair_id")
    .replace("spans", "spans2").replace("sents", "sents2").replace("covered", "covered2")
    .replace("terms AS", "terms2 AS").replace("JOIN terms", "JOIN terms2").replace("risky", "risky2")
    .replace("kept AS", "kept2 AS").replace("JOIN kept", "JOIN kept2").replace("pii AS (", "pii2 AS (").replace("JOIN pii p", "JOIN pii2 p")
    .replace("done AS", "done2 AS").replace("FROM done", "FROM done2").replace("sanitized AS", "sa AS")
    + " SELECT pair_id, sq.pii_count + sa.pii_count AS n_entities, round((sq.pii_density + sa.pii_density) / 2, 5) AS pii_density FROM sq JOIN sa USING (pair_id)",
)
def merge_privacy(read):
    pairs = dialogue_pairs(read)
    q = privacy.sanitize(pairs.select("pair_id", "question"), "question")
    a = privacy.sanitize(pairs.select("pair_id", "answer"), "answer")
    out = aggregation.merge_privacy(q, a, "pair_id")
    return out.select(
        "pair_id",
        F.size("pii").cast("long").alias("n_entities"),
        F.round("pii_density", 5).alias("pii_density"),
    )


# ---------------------------------------------------------------- runs

# A run is a user: rounds are its events in time order.
SQL_RUNS = """me AS (SELECT user_id AS run_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS round, value, (event_id % 97)::DOUBLE AS other FROM events),
ru AS (SELECT DISTINCT user_id AS run_id, (user_id % 10)::VARCHAR AS seed, (user_id // 10)::VARCHAR AS lr, (20 + user_id % 5)::INT AS num_rounds, (user_id % 4)::INT AS eval_interval FROM events)"""


def metric(read):
    rows = read("events").select("user_id", "ts", "event_id", "value")
    placed = sorted_positions(rows, ["ts", "event_id"], ["user_id"], "round", None)
    return placed.select(
        F.col("user_id").alias("run_id"),
        "round",
        "value",
        F.pmod("event_id", F.lit(97)).cast("double").alias("other"),
    )


def runs(read):
    ids = read("events").select(F.col("user_id").alias("run_id")).distinct()
    text = {
        "seed": F.col("run_id") % 10,
        "lr": F.floor(F.col("run_id") / 10),
        "num_rounds": 20 + F.col("run_id") % 5,
        "eval_interval": F.col("run_id") % 4,
    }
    entries = []
    for k, v in text.items():
        entries += [F.lit(k), v.cast("string")]
    return ids.withColumn("option", F.create_map(*entries))


@query(
    "runs_filter",
    f"WITH {SQL_RUNS} SELECT run_id FROM ru WHERE seed IN ('1', '3', '5') AND lr::DOUBLE < 9 AND num_rounds = 21",
)
def filter_runs(read):
    kept = run_analysis.filter_runs(
        runs(read), {"seed": ["1", "3", "5"], "lr": "<9", "num_rounds": 21}
    )
    return kept.select("run_id")


@query(
    "runs_round_axis",
    f"""WITH {SQL_RUNS}, a AS (SELECT run_id, 0 AS round FROM ru UNION ALL SELECT run_id, unnest(range(eval_interval, num_rounds + 1, eval_interval)) FROM ru WHERE eval_interval > 0)
SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY round) - 1)::BIGINT AS pos, round::BIGINT AS round FROM a""",
)
def round_axis(read):
    out = run_analysis.round_axis(runs(read))
    return out.select("run_id", *[F.col(c).cast("long").alias(c) for c in ("pos", "round")])


@query(
    "runs_stats",
    f"""WITH {SQL_RUNS} SELECT run_id, min(value) AS min_value, max(value) AS max_value, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS std_value, round(avg(value), 6) AS mean_value, arg_max(value, round) AS final_value FROM me GROUP BY ALL""",
)
def stats(read):
    out = run_analysis.run_stats(metric(read))
    return out.select("run_id", "min_value", "max_value", *r6("variance", "std_value", "mean_value"), "final_value")


@query(
    "runs_optimal_x_by_y",
    f"WITH {SQL_RUNS} SELECT run_id, other AS x, round FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value, round) AS r FROM me) WHERE r = 1",
)
def optimal(read):
    return run_analysis.optimal_x_by_y(metric(read), "other", "value")


@query(
    "runs_optimal_x_by_y_max",
    f"WITH {SQL_RUNS} SELECT run_id, value AS x, round FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY other DESC, round) AS r FROM me) WHERE r = 1",
)
def optimal_max(read):
    return run_analysis.optimal_x_by_y(metric(read), "value", "other", "max")


_SQL_GROUP = "'eval_interval=' || eval_interval || ',lr=' || lr || ',num_rounds=' || num_rounds"


@query(
    "runs_group_curves",
    f"WITH {SQL_RUNS} SELECT {_SQL_GROUP} AS group_key, round, count(*) AS n_runs, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM me JOIN ru USING (run_id) GROUP BY ALL",
)
def curves(read):
    out = run_analysis.group_runs(metric(read), runs(read))
    return out.select("group_key", "round", "n_runs", *r6("mean"), "low", "high")


_SQL_BEST = f"{SQL_RUNS}, be AS (SELECT run_id, min(value) AS v, arg_min(other, (value, round)) AS o FROM me GROUP BY ALL)"


@query(
    "runs_group_optimal",
    f"""WITH {_SQL_BEST}, g AS (SELECT lr, avg(v) AS mean, stddev_pop(v) AS std FROM be JOIN ru USING (run_id) GROUP BY ALL)
SELECT 'lr=' || lr AS group_key, round(mean, 6) AS mean, round(std, 6) AS std, printf('%.4f ± %.4f', mean, std) AS text FROM g""",
)
def group_best(read):
    out = run_analysis.group_optimal(
        metric(read), runs(read), ignore=["seed", "num_rounds", "eval_interval"]
    )
    return out.select("group_key", *r6("mean", "std"), "text")


@query(
    "runs_group_optimal_x_by_y",
    f"""WITH {_SQL_BEST}, g AS (SELECT lr, avg(o) AS mean, stddev_pop(o) AS std FROM be JOIN ru USING (run_id) GROUP BY ALL)
SELECT 'lr=' || lr AS group_key, round(mean, 6) AS mean, round(std, 6) AS std FROM g""",
)
def group_best_x(read):
    out = run_analysis.group_optimal(
        metric(read), runs(read), "min", "other", "value", ["seed", "num_rounds", "eval_interval"]
    )
    return out.select("group_key", *r6("mean", "std"))


@query(
    "runs_table",
    f"""WITH {SQL_RUNS} SELECT run_id, min(value) AS lowest, round(avg(other), 6) AS mean_other, arg_max(value, round) AS last, arg_min(other, (value, round)) AS at_best FROM me GROUP BY ALL""",
)
def table(read):
    out = run_analysis.run_table(
        metric(read),
        [
            {"stat": "min", "x": "value", "name": "lowest"},
            {"stat": "mean", "x": "other", "name": "mean_other"},
            {"stat": "final", "x": "value", "name": "last"},
            {"stat": "optimal", "x": "other", "y": "value", "name": "at_best"},
        ],
        sort="lowest",
    )
    return out.withColumn("mean_other", F.round("mean_other", 6))


@query(
    "runs_early_stop",
    f"""WITH {SQL_RUNS}, b AS (SELECT *, min(value) OVER (PARTITION BY run_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM me),
u AS (SELECT *, max(CASE WHEN pb IS NULL OR value < pb THEN round END) OVER (PARTITION BY run_id ORDER BY round) AS lu FROM b)
SELECT run_id, min(round) AS stop_round FROM u WHERE round - lu >= 8 GROUP BY run_id""",
)
def early_stop(read):
    return run_analysis.early_stop(metric(read), 8, -1, width=16)


@query(
    "runs_best_config",
    f"""WITH {SQL_RUNS}, be AS (SELECT run_id, value, round FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value, round) AS r FROM me) WHERE r = 1)
SELECT run_id, seed, lr, value, round FROM be JOIN ru USING (run_id) ORDER BY value, run_id LIMIT 1""",
)
def best_config(read):
    out = run_analysis.best_config(metric(read), runs(read))
    return out.select(
        "run_id", F.col("option")["seed"].alias("seed"), F.col("option")["lr"].alias("lr"), "value", "round"
    )


@query(
    "runs_smooth",
    f"""WITH {SQL_RUNS}, w AS (SELECT run_id, round, value, list_sort(list(value) OVER (PARTITION BY run_id ORDER BY round ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS s,
 avg(value) OVER (PARTITION BY run_id ORDER BY round ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean, avg(value) OVER (PARTITION BY run_id ORDER BY round) AS gm FROM me)
SELECT run_id, round, value, s[(len(s) - 1) // 2 + 1] AS median, round(mean, 9) AS mean, s[-1] AS "max", round(gm, 9) AS global_mean FROM w""",
)
def smooth(read):
    out = run_analysis.smooth(metric(read), 20, width=32)
    return out.select("run_id", "round", "value", "median", *r9("mean"), "max", *r9("global_mean"))


@query(
    "runs_last_dist",
    f"""WITH {SQL_RUNS}, n AS (SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'acc_dist' ELSE 'acc' END AS name, round, value FROM me)
SELECT run_id, name, round, value FROM n WHERE name = 'acc' UNION ALL SELECT run_id, name, max(round), arg_max(value, round) FROM n WHERE name = 'acc_dist' GROUP BY run_id, name""",
)
def last_dist(read):
    named = metric(read).withColumn(
        "name", F.when(F.col("run_id") % 2 == 0, "acc_dist").otherwise("acc")
    )
    return run_analysis.last_dist(named)
