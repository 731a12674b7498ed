import gzip
import json

from pyspark.sql import functions as F

from quillmesh.sources import corpus, reports, tables


def test_corpus_files(spark, tmp_path):
    raw = {f"d{i}": {f"p{j}": {"page_content": f"text {i}-{j}", "index": i * 10 + j} for j in range(3)} for i in range(4)}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    rows = corpus.read_corpus(spark, str(tmp_path / "c.json")).collect()
    assert [(r.id, r.text) for r in rows][:4] == [(0, "text 0-0"), (1, "text 0-1"), (2, "text 0-2"), (10, "text 1-0")]
    few = corpus.read_corpus(spark, str(tmp_path / "c.json"), 5).collect()
    assert sorted(r.id for r in few) == [0, 1, 2, 10, 11]
    items = [
        {"key_content": {"question": "q", "answer": "a", "reference": ["r1", "r2", "r3"], "reference_idx": [7, 8]}, "other_info": {"doc_name": "n", "question_type": "t1"}},
        {"key_content": {"question": "q2", "answer": "", "reference": [], "reference_idx": []}, "other_info": {"doc_name": "m", "question_type": "t2"}},
    ]
    (tmp_path / "qa.json").write_text(json.dumps(items))
    qa = corpus.read_qa(spark, str(tmp_path / "qa.json"))
    refs = corpus.explode_references(qa)
    assert sorted((r.id, r.title, r.text) for r in refs.collect()) == [(7, "n", "r1"), (8, "n", "r2")]
    assert [r.question_type for r in corpus.load_qa(qa).collect()] == ["t1"]
    out = str(tmp_path / "out")
    corpus.write_corpus(refs, out)
    assert spark.read.json(out).count() == 2


def test_multihop(spark):
    df = spark.createDataFrame(
        [(0, (["A", "B"], [["a1", "a2"], ["b1"]])), (1, (["B", "C"], [["other"], ["c1", "c2", "c3"]])), (2, (["D"], [["d"]]))],
        "id long, context struct<title:array<string>,sentences:array<array<string>>>",
    )
    got = corpus.load_multihop(df, "id").orderBy("title_id").collect()
    assert [(r.title, r.title_id, r.start, len(r.sentences)) for r in got] == [("A", 0, 0, 2), ("B", 1, 2, 1), ("C", 2, 3, 3), ("D", 3, 6, 1)]


def test_delimited(spark, tmp_path):
    (tmp_path / "r.dat").write_text("1::20::5::99\n2::30::4::98\n")
    schema = "user_id long, item_id long, rating int, ts long"
    got = tables.read_table(spark, str(tmp_path / "r.dat"), "::", schema).collect()
    assert [(r.user_id, r.item_id, r.rating) for r in got] == [(1, 20, 5), (2, 30, 4)]
    (tmp_path / "h.csv").write_text("a;b\n1; 2\n")
    row = tables.read_table(spark, str(tmp_path / "h.csv"), ";", "a int, b int", header=True).first()
    assert (row.a, row.b) == (1, 2)
    with gzip.open(tmp_path / "s.txt.gz", "wt") as f:
        f.write("1.5,2.5\n3.5,4.5\n")
    assert tables.read_table(spark, str(tmp_path / "s.txt.gz"), ",", "x double, y double").count() == 2
    (tmp_path / "u.tsv").write_text("1 0.5 0.25\n3\t1e-1 2\n")
    got = tables.read_ucr(spark, str(tmp_path / "u.tsv")).collect()
    assert [(r.label, r["values"]) for r in got] == [(0, [0.5, 0.25]), (2, [0.1, 2.0])]


def test_assignment(spark, tmp_path):
    a = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("long").alias("client_id"))
    want = {(r.row_id, r.client_id) for r in a.collect()}
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        tables.write_assignment(a, path, fmt=fmt)
        back = tables.read_assignment(spark, path, fmt=fmt)
        assert {(r.row_id, r.client_id) for r in back.collect()} == want
        assert tables.read_assignment(spark, path, fmt=fmt, clients=[1]).count() == 67


def test_runs(spark, tmp_path):
    for name, seed in (("fedavg_M1", 1), ("fedavg_M2", 2), ("other", 3)):
        rec = {"option": {"seed": str(seed)}, "metrics": {"loss": [1.0, 0.5]}}
        (tmp_path / f"{name}.json").write_text(json.dumps(rec, indent=1))
    runs = tables.read_runs(spark, str(tmp_path), ["fedavg"])
    assert runs.count() == 2
    rows = tables.run_metrics(runs, ["loss"]).collect()
    assert sorted((r["round"], r.value) for r in rows) == [(0, 1.0), (0, 1.0), (1, 0.5), (1, 0.5)]


def test_reports(spark, tmp_path):
    m = spark.createDataFrame([("f1", 0.5, 4), ("x", None, 0)], "metric string, mean double, n_valid long")
    reports.write_report(m, str(tmp_path / "rep"))
    assert {r.value for r in spark.read.text(str(tmp_path / "rep")).collect()} == {"f1: 0.5000, valid number : 4", "x: 0, valid number : 0"}
    chat = spark.createDataFrame(
        [(1, 0, "user", "hi", "t0", None, None, None), (1, 1, "assistant", "yo", "t1", True, 2, 1)],
        "conv_id int, turn int, role string, content string, timestamp string, privacy_applied boolean, pii_detected int, sentences_removed int",
    )
    reports.export_chat(chat, str(tmp_path / "md"), "markdown")
    lines = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert "## User (t0)" in lines and "- PII Detected: 2" in lines
    reports.export_chat(chat, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 2
