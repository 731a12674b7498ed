"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles' hashes, ordered by hash. With similarity
0.8 two sets share at least ``need = ceil(0.8 n)`` shingles, hence at least ``l`` within
their first ``n - need + l``, for every ``l`` up to ``need``. What a document's shingles
cost, by the number of documents that have them in their longest prefix, decides on l:

1. lengthened: with l shared shingles in a prefix that has f frequent ones, l - f rare
   ones are shared. The prefix grows to the l with the most, and as many are required.
2. hot: no l leaves ``MATCHES`` rare ones, as in large groups of copies. All shingles of
   the longest prefix count, and its whole surplus of shared ones is required.

Pairs with a lengthened member are found by rare shingles only, hot pairs among hot
documents alone, so a frequent passage never meets all documents that hold it.

Candidates are not listed pair by pair. Documents are clustered by one of their more
frequent shingles and their size; a document meets a cluster of a like size if it shares
as many shingles with the cluster as a link would take. Of documents with the same set
one stands for all, the others hang on it. The sets of two such clusters, in blocks of
bounded shingles and documents, are compared by exact intersections, and every block
passes on a forest of its links.
Membership filters of fixed size only keep shingles without a partner from the
exchanges; all decisions that need counts are made on exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import free_names, map_arrow, query, table
from quillmesh.llm.shingles import SHINGLE, shingle_sets
from quillmesh.llm.store import components, is_member, membership, stored

#: Similarity as a fraction: 100 * shared >= PERCENT * union.
PERCENT = 80
#: A shingle in more prefixes than this is frequent.
FREQUENT = 32
MATCHES = 2
#: Ratio of two classes of set sizes, as a multiple of the largest ratio that a link allows.
CLASS = 1.01
#: Shingles of one side of a block.
BLOCK = 150_000
#: Documents of one side of a block: a block's tables have documents x documents cells.
BLOCK_DOCS = 2000
_SET_BYTES = 6


def need(n, percent: int = PERCENT):
    """Shingles that a set of n shares with any partner at least."""
    return -(-n * percent // 100)


def longest(n: int) -> int:
    """The largest l that a document of n shingles lengthens its prefix by."""
    return 1 + max(n // 10, 3)


def surplus(n: int, percent: int = PERCENT) -> int:
    """An l that every partner of a set of n can also reach."""
    least = need(n, percent)  # the smallest partner's size
    return max(1, min(longest(least), need(least, percent)))


class Prefixes:
    """Which shingles of a sorted set its document puts forward."""

    def __init__(self, percent: int):
        self.percent = percent

    def extended(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        return h[: min(n, n - need(n, self.percent) + longest(n))] if n else h

    def rare_shared(self, n: int, frequent: np.ndarray) -> int:
        """Rare shingles that a link takes, by the best l; ``frequent`` is of ``extended``."""
        upto = np.cumsum(frequent)[n - need(n, self.percent) :][: surplus(n, self.percent)]
        return int((np.arange(1, len(upto) + 1) - upto).max())


def _postings(docs: DataFrame, pick, schema: str) -> DataFrame:
    """Rows that ``pick(set)`` (column arrays, or None) gives for every text, with the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            who, cols, rows = [], [], 0
            for i, h in shingle_sets(batch.column("_text"), size):
                got = pick(h)
                if got is None:
                    continue
                who.append(np.full(len(got[0]), ids[i]))
                cols.append(got)
                rows += len(got[0])
                if rows > 200_000:
                    yield build(who, cols)
                    who, cols, rows = [], [], 0
            if cols:
                yield build(who, cols)

    def build(who: list, cols: list) -> pa.RecordBatch:
        own = [np.concatenate(who).astype(np.int64), *(np.concatenate(c) for c in zip(*cols))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in own], names)

    size = SHINGLE
    names = [x.split()[0] for x in schema.split(", ")]
    return map_arrow(docs, run, schema)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def candidate_rows(docs: DataFrame, percent: int, frequent: int) -> DataFrame:
    """(id, kind, space, n, size, wanted, key, weight, df): the shingles by which documents meet.

    ``docs`` has ``_id`` (bigint, not null) and ``_text``. Shingles that are in the same
    documents stand for one another: the smallest comes with their number as weight.
    """
    share = docs.sparkSession.sparkContext.broadcast
    p = Prefixes(percent)
    postings = _postings(docs, lambda h: (_signed(p.extended(h)),) if len(h) else None, "id bigint, token bigint")
    who = F.xxhash64("id")
    # The sum tells lists apart in which repeated ids cancel out.
    digest = F.xxhash64(F.bit_xor(who), F.sum(F.pmod(who, F.lit(1 << 31))))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), digest.alias("list")).filter("df > 1")
    often = F.col("df") > frequent
    # All shingles of a list are in each of its documents, so no array outgrows a text.
    lists = stored(
        shared.groupBy("list", "df").agg(
            F.min("token").alias("token"), F.count(F.lit(1)).alias("weight"),
            F.collect_list(F.when(often, F.col("token"))).alias("tokens"),
        ).withColumn("often", often)
    )
    rare = share(membership(lists.filter("not often"), F.col("token")))
    hot = share(membership(lists.filter("often"), F.col("token")))
    frequent_ = share(membership(lists.select(F.explode("tokens").alias("token")), F.col("token")))

    def put_forward(h):
        if not len(h):
            return None
        long = p.extended(h)
        wanted = p.rare_shared(len(h), is_member(frequent_.value, long))
        kind = 1 if wanted >= MATCHES else 2
        tokens = [long[is_member(rare.value, long)]]
        if kind == 2:
            tokens.append(long[is_member(hot.value, long)])
        flat = np.concatenate(tokens)
        if not len(flat):
            return None
        m = len(flat)
        space = np.repeat(np.arange(1, len(tokens) + 1, dtype=np.int8), [len(x) for x in tokens])
        size = int(np.log(len(h)) / np.log(CLASS * 100 / percent))
        return (_signed(flat), space, *(np.full(m, x, np.int32) for x in (kind, len(h), size, max(wanted, 1))))

    rows = _postings(docs, put_forward, "id bigint, token bigint, space tinyint, kind int, n int, size int, wanted int")
    # Space 1 holds rare shingles, space 2 frequent ones.
    known = lists.select("token", "weight", "df", F.when(F.col("often"), 2).otherwise(1).cast("tinyint").alias("space"))
    return rows.join(known, ["token", "space"]).withColumn("key", F.xxhash64("space", "token")).drop("token")


def _meetings(rows: DataFrame, percent: int) -> DataFrame:
    """(id, n, lo, hi, side): documents and the pairs of clusters in which they are compared."""
    who = ["id", "kind", "size"]
    # The smallest key among the more frequent half: members of a group mostly agree on
    # it, so that a group has few clusters. The array is no longer than the prefix.
    sorted_ = F.sort_array(F.collect_list(F.struct("df", "key")), asc=False)
    own = rows.groupBy(*who).agg(sorted_.alias("all"))
    half = F.slice("all", 1, F.ceil(F.size("all") / 2).cast("int"))
    least_key = F.array_min(F.transform(half, lambda x: x["key"]))
    own = own.select(*who, F.xxhash64(least_key, "kind", "size").alias("cluster"))
    rows = stored(rows.drop("df").join(own, who))
    there = rows.select(
        "key", F.col("cluster").alias("other"), F.col("kind").alias("other_kind"), F.col("size").alias("other_size")
    ).distinct()
    part = lambda *spaces: F.sum(F.when(F.col("space").isin(*spaces), F.col("weight")).otherwise(0))
    # Classes of sizes that a link allows are neighbours.
    met = rows.join(there, "key").filter("abs(size - other_size) <= 1").groupBy(*who, "cluster", "other", "other_kind")
    met = met.agg(part(1).alias("rare"), part(1, 2).alias("all"), F.min("n").alias("n"), F.min("wanted").alias("wanted"))
    least = F.ceil(F.col("n") * percent / F.lit(100)).cast("int")
    again = F.ceil(least * percent / F.lit(100)).cast("int")
    hot = F.greatest(F.lit(1), F.least(F.lit(1) + F.greatest(F.floor(least / 10).cast("int"), F.lit(3)), again))
    both_hot = (F.col("kind") == 2) & (F.col("other_kind") == 2)
    enough = F.when(both_hot, F.col("all") >= hot).otherwise(F.col("rare") >= F.col("wanted"))
    return met.filter(enough).select(
        "id", "n", F.least("cluster", "other").alias("lo"), F.greatest("cluster", "other").alias("hi"),
        F.when(F.col("cluster") > F.col("other"), 1).otherwise(0).alias("side"),
    )


def _blocks(met: DataFrame, block: int) -> DataFrame:
    """(id, lo, hi, i, j, side): each pair of clusters in blocks of about ``block`` shingles
    and ``BLOCK_DOCS`` documents a side at most."""
    # A document counts as many shingles as its share of a block's documents, if it has fewer.
    cost = F.greatest(F.col("n") / block, F.lit(1 / BLOCK_DOCS))
    size = met.groupBy("lo", "hi").agg(
        *(F.count_if(F.col("side") == s).alias(f"c{s}") for s in (0, 1)),
        *(F.ceil(F.coalesce(F.sum(F.when(F.col("side") == s, cost)), F.lit(0.0))).cast("int").alias(f"b{s}") for s in (0, 1)),
    )
    size = size.filter("(lo = hi and c0 > 1) or (c0 > 0 and c1 > 0)")
    both = met.join(size, ["lo", "hi"])
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int")
    both = both.withColumn("own", own)
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    within = F.transform(
        F.sequence(F.lit(0), F.col("b0") - 1),
        lambda k: pair(F.least(k, F.col("own")), F.greatest(k, F.col("own")), F.when(k < F.col("own"), 1).otherwise(0)),
    )
    across = F.when(
        F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.col("b1") - 1), lambda k: pair(F.col("own"), k, F.lit(0)))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("b0") - 1), lambda k: pair(k, F.col("own"), F.lit(1))))
    places = F.when(F.col("lo") == F.col("hi"), within).otherwise(across)
    return both.select("id", "lo", "hi", F.explode(places).alias("p")).select("id", "lo", "hi", "p.i", "p.j", "p.side")


def pack_set(h: np.ndarray) -> bytes:
    """A set as 48 bits of each hash."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _SET_BYTES :].tobytes()


def unpack_set(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // _SET_BYTES, 8), np.uint8)
    wide[:, 8 - _SET_BYTES :] = np.frombuffer(raw, np.uint8).reshape(-1, _SET_BYTES)
    return wide.view(">u8").ravel().astype(np.int64)


def links(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT, columns: int = 4096):
    """(i, j) of all pairs of a left and a right set with 100 * shared >= percent * union."""
    sizes = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    flat = np.concatenate([*left, *right])
    values, index, count = np.unique(flat, return_inverse=True, return_counts=True)
    wanted = count[index] > 1
    place = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))[wanted]
    col = place[index[wanted]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    total = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, total, columns):
        x, y = np.searchsorted(col, [a, a + columns])
        width = min(columns, total - a)
        cells = np.zeros((len(left) + len(right), width), np.float32)
        cells[row[x:y], col[x:y] - a] = 1
        shared += cells[: len(left)] @ cells[len(left) :].T
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    return np.nonzero(100 * shared.astype(np.float64) >= percent * union.astype(np.float64))


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the links of one block."""
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    roots = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(roots, label, ids)
    moved = roots[label] != ids
    return ids[moved], roots[label][moved]


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links of every block, as (a, b) with b the smallest document that a hangs on there."""

    def close(key, parts: list[list]) -> pa.RecordBatch:
        alone = key[0] == key[1] and key[2] == key[3]
        if not parts[0] or not alone and not parts[1]:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        ids = np.array([r[0] for side in parts for r in side], np.int64)
        one, two = ([unpack_set(r[1]) for r in side] for side in parts)
        i, j = links(one, one if alone else two, percent)
        j = j if alone else j + len(one)
        a, b = _forest(ids, i, j)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, [[], []]
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("lo", "hi", "i", "j", "side", "id", "set")]
            for *key, side, who, raw in zip(*cols):
                if key != now:
                    if now is not None:
                        yield close(now, parts)
                    now, parts = key, [[], []]
                parts[side].append((who, raw))
        if now is not None:
            yield close(now, parts)

    keys = ["lo", "hi", "i", "j"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return map_arrow(dealt.select(*keys, "side", "id", "set"), run, "a bigint, b bigint")


def _twins(met: DataFrame, plain: DataFrame) -> DataFrame:
    """(id, rep): documents of one text that have the set of ``rep``, a smaller one, as well."""
    wanted = plain.sparkSession.sparkContext.broadcast(membership(met.select("id"), F.col("id")))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(is_member(wanted.value, ids.astype(np.int64).view(np.uint64))))
            ids = batch.column("_id").to_pylist()
            who, raw = [], []
            for i, h in shingle_sets(batch.column("_text")):
                if len(h):
                    who.append(ids[i])
                    raw.append(xxhash.xxh3_128_digest(h.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(raw, pa.binary())], ["id", "digest"])

    # Rows of one id with different texts are one document, which no other one stands for.
    each = map_arrow(plain, digests, "id bigint, digest binary").groupBy("id")
    own = stored(each.agg(F.count(F.lit(1)).alias("texts"), F.min("digest").alias("digest")).filter("texts = 1").drop("texts"))
    reps = own.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return stored(own.join(reps, "digest").filter("id <> rep").select("id", "rep"))


def link_components(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", percent: int = PERCENT, frequent: int = FREQUENT,
    block: int = BLOCK,
) -> DataFrame:
    """(node, component) of every document with a link to another one."""
    plain = docs.select(docs[row_id].cast("long").alias("_id"), docs[text].alias("_text")).filter("_id is not null and _text is not null")
    met = stored(_meetings(candidate_rows(plain, percent, frequent), percent))
    twins = _twins(met, plain)
    blocks = stored(_blocks(stored(met.join(twins, "id", "left_anti")), block))
    wanted = docs.sparkSession.sparkContext.broadcast(membership(blocks.select("id"), F.col("id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(is_member(wanted.value, ids.astype(np.int64).view(np.uint64))))
            ids = batch.column("_id").to_pylist()
            who, raw = [], []
            for i, h in shingle_sets(batch.column("_text")):
                who.append(ids[i])
                raw.append(pack_set(h))
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(raw, pa.binary())], ["id", "set"])

    known = map_arrow(plain, sets, "id bigint, set binary").filter(F.length("set") > 0)
    links_ = _compare(blocks.join(known, "id"), percent)
    return components(links_.unionByName(twins.select(F.col("id").alias("a"), F.col("rep").alias("b"))))


def near_duplicates(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", percent: int = PERCENT, frequent: int = FREQUENT,
    block: int = BLOCK,
) -> DataFrame:
    """``row_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, its own included. A null
    text, or one without words, has no shingles and no links. A null id has a null
    component and no links; other rows of one id are one document, linked to all that
    any of its texts is linked to. Other columns are not read; an empty table gives no
    rows. ``frequent`` and ``block`` change the cost, not the result.
    """
    found = link_components(docs, row_id, text, percent, frequent, block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(h) for _, h in shingle_sets(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64())], ["_id", "n_shingles"])

    own = docs.select(docs[row_id].cast("long").alias("_id"), docs[text].alias("_text"))
    sizes = map_arrow(own, count, "_id bigint, n_shingles bigint")
    out = sizes.join(found, sizes["_id"] == found["node"], "left")
    return out.select(F.col("_id").alias(row_id), "n_shingles", F.coalesce("component", "_id").alias("component_id"))


def one_of_each(docs: DataFrame, row_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its component.

    Of several rows of one id the one with the smallest text hash stays; rows with a
    null id all stay.
    """
    found = link_components(docs, row_id, text, percent)
    gone = found.filter("node <> component").select(F.col("node").alias("_node"))
    left = docs.join(gone, docs[row_id].cast("long") == gone["_node"], "left_anti")
    rn = free_names(docs.columns, ["_rn"])[0]
    null = F.when(F.col(row_id).isNull(), F.xxhash64(text))
    w = Window.partitionBy(F.col(row_id), null).orderBy(F.xxhash64(text))
    first = left.withColumn(rn, F.row_number().over(w)).filter((F.col(rn) == 1) | F.col(row_id).isNull())
    return first.select(*docs.columns)


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents
  UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM (SELECT node AS doc_id, min(other) AS least_id FROM reach GROUP BY node) LEFT JOIN sizes USING (doc_id)"""


@query("op3_jaccard_join", ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
