import random
from collections import Counter, defaultdict

import pytest

from quillmesh.llm import line_dedup as L

BLANK = " \t\r\x0b\x0c"


def brute(rows, ratio, least):
    pages, seen = Counter(s for _, s, _ in rows), defaultdict(Counter)
    for _, s, t in rows:
        seen[s].update({x.strip(BLANK) for x in (t or "").split("\n")} - {""})
    bad = {s: {x for x, n in c.items() if n >= least and n > ratio * pages[s]} for s, c in seen.items()}
    out = []
    for i, s, t in rows:
        if t is None:
            out.append((i, s, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if x.strip(BLANK) not in bad[s]]
        out.append((i, s, "\n".join(kept), sum(x.strip(BLANK) != "" for x in lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("broadcast", [10**6, -1])
def test_brute_force(spark, broadcast):
    rng = random.Random(4)
    pool = ["menu", " menu\t", "home", "", " ", "é ü", "a\rb", "footer\r", "x" * 2000]
    rows = [(i, rng.choice(["s", "s", "s", "t", None, ""]), "\n".join(rng.choice([*pool, f"own {i} {k}"]) for k in range(rng.randint(1, 9)))) for i in range(300)]
    rows += [(1, "s", None), (2, "one", "menu\nhome"), (2, "one", "menu\nhome"), (3, "u", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    for ratio, least in ((0.3, 5), (0.2, 1), (0.9, 2)):
        got = L.drop_boilerplate(docs, ratio=ratio, min_pages=least, broadcast_lines=broadcast)
        assert Counter(map(tuple, got.collect())) == Counter(brute(rows, ratio, least))
    assert got.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"]
    assert L.drop_boilerplate(docs.limit(0), broadcast_lines=broadcast).count() == 0


def test_other_columns(spark):
    docs = spark.createDataFrame([(1, "m", "a", 7)], "`_lines` int, `n_lines` string, text string, source int")
    out = L.drop_boilerplate(docs)
    assert [tuple(r) for r in out.collect()] == [(1, "m", "a", 7, 1, 0)] and out.columns[4:] == ["n_lines_", "n_dropped"]


def test_small_sites_lose_what_most_of_their_pages_share(spark):
    rows = [(1, "two", "menu\nown a"), (2, "two", "menu\nown b"), (3, "one", "menu\nonly page")]
    rows += [(10 + k, "ten", f"menu\npage {k}" if k < 4 else f"page {k}") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r["doc_id"]: r["text"] for r in L.drop_boilerplate(docs).collect()}
    assert out == {1: "own a", 2: "own b", 3: "menu\nonly page"} | {10 + k: f"page {k}" for k in range(10)}
