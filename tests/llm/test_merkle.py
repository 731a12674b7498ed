import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import merkle
from quillmesh.llm.merkle import Parent, fold_leaves, leaf, manifest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + fan]) for k in range(0, len(out[-1]), fan)])
    return out


def brute(rows, fan=16):
    """rows: (id, source, lang, n_chars, text) -> {(id, leaf): result}, tree by tree."""
    by_source = {}
    for r in rows:
        changed = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
        by_source.setdefault(r[1], []).append((r[0], H(*map(field, r)), H(*map(field, changed))))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in by_source[s]], fan)
    top = levels([trees[s][-1][0] for s in sources], fan)
    out = []
    for k, s in enumerate(sources):
        for p, (doc, own, now) in enumerate(by_source[s]):
            siblings = []
            for tree, at in ((trees[s], p), (top, k)):
                for level in tree[:-1]:
                    run = level[at // fan * fan : at // fan * fan + fan]
                    slot = at % fan
                    siblings += run[:slot] + run[slot + 1 :]
                    now = H(*run[:slot], now, *run[slot + 1 :])
                    at //= fan
            root = top[-1][0]
            out.append((doc, own, trees[s][-1][0], root, H(*siblings), now, now == root))
    return out


def folded(docs, fan=16, depth=3):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    own = lambda text: leaf("doc_id", "source", "lang", "n_chars", text)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, own(F.translate("text", upper, lower)))
    return fold_leaves(manifest(docs, "source", "doc_id", own("text"), ["doc_id"], changed, fan, depth))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(spark, rows, **more):
    got = [tuple(r) for r in folded(spark.createDataFrame(rows, SCHEMA), **more).collect()]
    return sorted(got, key=str)


def test_fold_resumes_the_state_of_the_slot():
    children = [H(str(i)).encode() for i in range(5)]
    parent = Parent(children)
    assert parent.digest.decode() == H(*(c.decode() for c in children))
    for slot in range(5):
        other = [*children[:slot], b"f" * 64, *children[slot + 1 :]]
        assert parent.fold(slot, b"f" * 64).decode() == H(*(c.decode() for c in other))
        assert parent.fold(slot, children[slot]) == parent.digest


@pytest.mark.parametrize("fan,depth", [(16, 3), (2, 1), (3, 2)])
def test_trees_equal_brute_force(spark, fan, depth):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "en", i, f"Text {i} ABC") for i in range(60)]
    rows += [(100, "lone", None, None, None), (101, "É", "de", 3, "ÄBC"), (102, "é", "de", 3, "")]
    rows += [(5, "s2", "en", 5, "Text 5 ABC"), (5, "s2", "en", 9, "other"), (None, "s1", None, 1, "No id"), (None, None, None, None, None)]
    assert rows_of(spark, rows, fan=fan, depth=depth) == sorted(brute(rows, fan), key=str)


def test_one_row_is_its_root(spark):
    rows = [(7, "a", "en", 1, "x")]
    got = rows_of(spark, rows)
    assert got == brute(rows) and got[0][1] == got[0][2] == got[0][3]
    assert got[0][4] == hashlib.sha256(b"").hexdigest()


def test_a_source_of_one_run_more(spark):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(17)]
    assert rows_of(spark, rows) == sorted(brute(rows), key=str)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en", 1, "T", 2, 3, "x")], SCHEMA + ", pos int, n int, digest string")
    found = manifest(docs, "source", "doc_id", leaf("doc_id", "text"), ["doc_id", "pos", "digest"])
    assert fold_leaves(found).columns[:3] == ["doc_id", "pos", "digest"]
    assert fold_leaves(found).first()["verified"]
    none = manifest(docs.limit(0), "source", "doc_id", leaf("doc_id", "text"), ["doc_id"])
    assert none.root is None and fold_leaves(none).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in merkle.op12(spark, folder).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert {r[-1] for r in got} == {True, False}
