"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate of its site if more than a given share of the site's pages
contain it. Lines are counted as 128-bit hashes, per page once, with a partial sum in
every task, so that a site with a third of all pages is no hot key. A site has at most
(mean lines of a page / ratio) such lines; they come back as one array per site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import free_names, query, table
from quillmesh.session import cut_lineage

#: A line on more than this share of its site's pages goes, if other pages have it too:
#: what one page alone has is its own text, however few pages its site has.
RATIO = 0.1
MIN_PAGES = 2
#: Boilerplate lines (16 bytes each, besides the site's name) that are broadcast at most.
BROADCAST_LINES = 100_000
#: Parts of a site in the join that is used beyond.
SALT = 64
_BLANK = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    own = F.btrim(line, F.lit(_BLANK))
    return F.struct(F.xxhash64(own).alias("a"), F.xxhash64(F.lit(1), own).alias("b"))


def _not_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK)) != ""


def boilerplate_lines(
    docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(site, lines): the keys of every site's boilerplate lines, as an array."""
    pages = docs.select(docs[site].alias("_site"), docs[text].alias("_text"))
    totals = pages.groupBy("_site").agg(F.count(F.lit(1)).alias("_pages"))
    lines = F.filter(F.split("_text", "\n"), _not_blank)
    each = pages.select("_site", F.explode(F.array_distinct(F.transform(lines, _key))).alias("_line"))
    counts = each.groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_pages)
    found = counts.join(totals, counts["_site"].eqNullSafe(totals["_site"])).filter(
        F.col("_n") > F.lit(ratio) * F.col("_pages")
    )
    return found.groupBy(counts["_site"]).agg(F.collect_list("_line").alias("_lines"))


def drop_boilerplate(
    docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``docs`` without boilerplate lines, and ``n_lines`` and ``n_dropped`` per row.

    Lines are the parts between newlines, compared without blanks at their ends; blank
    lines are never counted nor dropped and count in neither figure. Each row is a page,
    repeated rows count as often as they occur. Rows without a site form one site; a
    null text stays null with no lines, a text of boilerplate only becomes what its
    blank lines leave. Other columns, whatever their names, come back unchanged; a
    result whose name they have already gets underscores added.
    """
    found = cut_lineage(boilerplate_lines(docs, site, text, ratio, min_pages))
    n = found.agg(F.sum(F.size("_lines"))).first()[0] or 0  # one number
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    left = docs.select(row.alias("_row"), docs[site].alias("_at"))
    if n <= broadcast_lines:
        both = left.join(F.broadcast(found), left["_at"].eqNullSafe(found["_site"]), "left")
    else:
        left = left.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(SALT)))
        parts = found.withColumn("_salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALT)])))
        same = left["_at"].eqNullSafe(parts["_site"]) & (left["_part"] == parts["_salt"])
        both = left.join(parts, same, "left")
    place = docs.columns.index(text)
    lines = F.split(F.col(f"_row.c{place}"), "\n")
    known = F.coalesce("_lines", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    stays = F.filter(lines, lambda x: ~(_not_blank(x) & F.array_contains(known, _key(x))))
    cut = both.select("_row", lines.alias("_all"), stays.alias("_stays"))
    own = [F.col(f"_row.c{i}").alias(c) if i != place else F.array_join("_stays", "\n").alias(c) for i, c in enumerate(docs.columns)]
    count = F.coalesce(F.size(F.filter("_all", _not_blank)), F.lit(0)).cast("long")
    gone = F.coalesce(F.size("_all") - F.size("_stays"), F.lit(0)).cast("long")
    n_lines, n_dropped = free_names(docs.columns, ["n_lines", "n_dropped"])
    return cut.select(*own, F.greatest(count, F.lit(0)).alias(n_lines), F.greatest(gone, F.lit(0)).alias(n_dropped))


ORACLE = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
each AS (SELECT source, unnest(list_distinct([trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) FOR x IN ls])) AS line FROM pages),
counts AS (SELECT source, line, count(*) AS n FROM each WHERE line <> '' GROUP BY ALL HAVING count(*) >= {MIN_PAGES}),
found AS (SELECT c.source, list(line) AS boiler FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
          WHERE n > CAST({RATIO} AS DOUBLE) * pages GROUP BY c.source),
cut AS (SELECT doc_id, p.source, ls,
          [x FOR x IN ls IF NOT list_contains(coalesce(boiler, []), trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))] AS stays
        FROM pages p LEFT JOIN found f ON p.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, source, array_to_string(stays, chr(10)) AS text,
       CAST(len([x FOR x IN ls IF trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '']) AS BIGINT) AS n_lines,
       CAST(len(ls) - len(stays) AS BIGINT) AS n_dropped
FROM cut"""


@query("op2_line_dedup", ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", "n_lines", "n_dropped")
