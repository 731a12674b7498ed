"""The pipeline against brute-force versions of its stages, one after the other."""

import test_jaccard_join
import test_line_dedup
import test_packing
import test_quality
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quillmesh.llm import line_dedup, quality

FOLDER = "/root/testdata/sf0.001"


def repeats(texts, length=400):
    raw = [t.encode() for t in texts]
    seen, out = {}, []
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    model = quality.fit_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality.judge_quality(docs, model).collect()}
    step = 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(step)))
        docs = spark.read.parquet(str(tmp_path / str(step)))
        step += 1
        got = {r.doc_id: r.text for r in docs.collect()}
        before = {i: r if isinstance(r, str) else r.text for i, r in rows.items()}
        if name == "quality_rules":
            want = {}
            for i, t in before.items():
                n, _, _, _, repeated = test_quality.brute(t)
                if n >= 10 and 100 * repeated <= 20 * n and score[i] >= 0.5:
                    want[i] = t
            sources = {r.doc_id: r.source for r in docs.collect()}
        elif name == "line_dedup":
            cut = test_line_dedup.brute([(i, sources[i], t) for i, t in before.items()], line_dedup.RATIO, line_dedup.MIN_PAGES)
            want = {i: t for i, _, t, _, _ in cut}
        elif name == "jaccard_join":
            want = {i: before[i] for i, _, c in test_jaccard_join.brute(list(before.items())) if c == i}
        else:
            want = dict(zip(before, repeats(list(before.values()))))
        assert got == want, name
        assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
        rows = got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    test_packing.check(packed, rows)


def test_run_equals_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, "s", 5), (1, "a b c " * 40, None, None), (None, "\n".join(f"l{k} x y z" for k in range(9)), "s", 1), (2, "", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, FOLDER)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).count()


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
