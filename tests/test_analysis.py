import numpy as np
import pytest

from quillmesh.operators import aggregation, features, relational, run_analysis


def params(spark, rows):
    return spark.createDataFrame(rows, "client_id int, layer string, idx int, value double")


def volumes(spark, rows):
    return spark.createDataFrame(rows, "client_id int, n long")


def test_weighted_modes(spark):
    p = params(spark, [(0, "a", 0, 2.0), (1, "a", 0, 4.0)])
    v = volumes(spark, [(0, 1), (1, 1), (2, 1), (3, 1)])
    old = params(spark, [(9, "a", 0, 1.0)]).drop("client_id")
    run = lambda m: aggregation.aggregate_params(p, m, v, old).first().value
    assert run("weighted_com") == 2.0
    assert run("weighted_scale") == 3.0
    assert run("weighted") == 3.0
    assert run("uniform") == 3.0


def test_nan_clients(spark):
    p = params(spark, [(0, "a", 0, 2.0), (1, "a", 0, float("nan")), (1, "a", 1, 1.0)])
    assert [r.client_id for r in aggregation.drop_nan_clients(p).collect()] == [0]
    lost = aggregation.drop_nan_clients(p.filter("client_id = 1"))
    with pytest.raises(Exception, match="every client holds a NaN"):
        lost.collect()


def test_norm_of_odd_powers(spark):
    p = params(spark, [(0, "a", 0, -1.0), (0, "a", 1, 3.0)])
    assert aggregation.param_norm(p, 1.0).first()["norm"] == 4.0
    assert abs(aggregation.param_norm(p, 3.0).first()["norm"] - 28 ** (1 / 3)) < 1e-12


def test_filter_runs(spark):
    df = spark.createDataFrame(
        [("r1", {"lr": "0.05", "algo": "fedavg", "seed": "1"}), ("r2", {"lr": "0.5", "algo": "fedprox"}), ("r3", {"algo": "fedavg"})],
        "run_id string, option map<string,string>",
    )
    names = lambda c: [r.run_id for r in run_analysis.filter_runs(df, c).collect()]
    assert names({"lr": "<0.1"}) == ["r1"]
    assert names({"algo": ["fedavg"]}) == ["r1", "r3"]
    assert names({"lr": 0.5}) == ["r2"]
    assert names({"algo": "fedprox"}) == ["r2"]
    assert names({"algo": ["fedavg"], "lr": ">=0.05"}) == ["r1"]
    assert names({"lr": [0.5, 0.05]}) == ["r1", "r2"]


def stop_round(values, patience, sign):
    best, count = None, 0
    for i, v in enumerate(values):
        s = sign * v
        if np.isnan(s):
            return i
        if best is None:
            best = s
        elif s <= best:
            count += 1
            if count >= patience:
                return i
        else:
            best, count = s, 0
    return None


@pytest.mark.parametrize("sign", [1, -1])
def test_early_stop(spark, sign):
    rng = np.random.default_rng(2)
    runs = {i: np.round(rng.random(60), 1) for i in range(12)}
    runs[3][7] = np.nan
    runs[4] = np.linspace(0, 1, 60)
    rows = [(i, t, float(v)) for i, vs in runs.items() for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run_id int, round int, value double")
    got = {r.run_id: r.stop_round for r in run_analysis.early_stop(df, 5, sign, width=8).collect()}
    want = {i: stop_round(v, 5, sign) for i, v in runs.items()}
    assert got == {i: s for i, s in want.items() if s is not None}


def test_round_axis_and_groups(spark):
    runs = spark.createDataFrame(
        [(i, {"num_rounds": "7", "eval_interval": str(e), "seed": str(i), "lr": "1"}) for i, e in enumerate((3, 3, 0))],
        "run_id int, option map<string,string>",
    )
    axis = run_analysis.round_axis(runs).collect()
    assert [r["round"] for r in axis if r.run_id == 0] == [0, 3, 6]
    assert [r["round"] for r in axis if r.run_id == 2] == [0]
    metric = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (2, 0, 9.0)], "run_id int, round int, value double")
    got = run_analysis.group_runs(metric, runs).orderBy("mean").collect()
    assert [(r.n_runs, r.mean, r.low, r.high) for r in got] == [(2, 2.0, 1.0, 3.0), (1, 9.0, 9.0, 9.0)]
    best = run_analysis.group_optimal(metric, runs).orderBy("mean").first()
    assert best.text == "2.0000 ± 1.0000"


def test_series_and_sequences(spark):
    n, w, h = 60, 5, 3
    data = [(t, s, float(100 * s + t)) for s in range(2) for t in range(n)]
    df = spark.createDataFrame(data, "t long, sensor int, value double")
    got = features.series_windows(df, w, h, width=16).collect()
    assert len(got) == 2 * (n - w - h + 1)
    for r in got:
        assert r.x == [100.0 * r.sensor + v for v in range(r.t - h - w + 1, r.t - h + 1)]
        assert r.y == 100.0 * r.sensor + r.t and r.part == ("train" if r.t < 48 else "test")
    texts = ["a b c", "", "d", "e f g h i j k l m n o p", "q r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    stream = " ".join(texts).split()
    for stride in (1, 3):
        rows = features.lm_sequences(docs, "id", "text", 4, stride, block=4).orderBy("start").collect()
        want = [stream[i : i + 5] for i in range(0, len(stream) - 5, stride)]
        assert [r.x + [r.y[-1]] for r in rows] == want
        assert all(r.x[1:] == r.y[:-1] for r in rows)


def test_features(spark):
    df = spark.createDataFrame([(1, "b", 1.9), (2, "a", 5.2)], "id int, c string, v double")
    assert [r.v for r in features.minmax(df, ["v"], as_int=True).orderBy("id").collect()] == [0.0, 1.0]
    other = spark.createDataFrame([("z",)], "c string")
    got = features.one_hot(df, ["c"], other).orderBy("id").collect()
    assert [r.c_onehot for r in got] == [[0, 1, 0], [1, 0, 0]]
    assert sorted(r.id for r in features.reindex(df, "id").collect()) == [0, 1]


def test_gold_and_grid(spark):
    qa = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "x"])], "qa_id int, titles array<string>")
    titles = spark.createDataFrame([("a", 10), ("b", 11)], "title string, doc_id int")
    got = {(r.qa_id, r.doc_id) for r in relational.gold_ids(qa, titles).collect()}
    assert got == {(1, 10), (1, 11)}
    opts = spark.createDataFrame([([1, 2], ["x", "y", "z"])], "a array<int>, b array<string>")
    assert relational.option_grid(opts, ["a", "b"]).count() == 6


def test_rollups(spark):
    df = spark.createDataFrame(
        [(0, "acc", 1, 0.5, 10), (0, "acc", 2, 1.0, 30)], "round int, metric string, client_id int, value double, n long"
    )
    row = aggregation.rollup_metrics(df).first()
    assert row.weighted_mean == 0.875 and row.mean == 0.75 and row.std == 0.25
    assert row["values"] == [0.5, 1.0]
    cat = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", None)], "c string, m double")
    got = {r.c: (r.n, r["mean"]) for r in aggregation.category_averages(cat, "c", ["m"]).collect()}
    assert got == {"x": (2, 2.0), "y": (1, None), None: (3, 2.0)}
