"""Merkle manifest of a table: a tree of SHA-256 digests per group, and one over the groups.

Leaves of a group stand in order; runs of ``FAN`` nodes become their parent until one
node is left. The tree is built in spans of ``FAN ** DEPTH`` consecutive nodes, each in
one task: the roots of the spans are the nodes of the next table, so a group of any size
is a few tables, each some thousand times smaller than the one before. Within a task
every parent retains a copy of its hash state before each child's slot. To fold a changed
leaf, the state of its slot goes on with the replacement and the siblings to the right;
what stands to the left is never hashed again. Above a span, all its leaves have the same
slots, whose states are made once per span from the stored siblings.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmesh.functions.positions import sorted_positions
from quillmesh.llm.common import free_names, map_arrow, query, table
from quillmesh.llm.store import stored

FAN = 16
#: Levels that one task builds; a span has FAN ** DEPTH nodes at most.
DEPTH = 3
_NODE = "grp string, pos bigint, n bigint, digest binary"
_PATH = "array<struct<left:binary,right:binary>>"


class Parent:
    """A node over a run of children, by their hex digests in ASCII.

    ``before[i]`` is the state that has seen the children to the left of slot ``i``.
    """

    __slots__ = ("before", "children", "digest")

    def __init__(self, children: Sequence[bytes]):
        state, self.before = hashlib.sha256(), []
        self.children = b"".join(children)
        for child in children:
            self.before.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def left(self, slot: int) -> bytes:
        return self.children[: 64 * slot]

    def right(self, slot: int) -> bytes:
        return self.children[64 * slot + 64 :]

    def fold(self, slot: int, child: bytes) -> bytes:
        """Digest with another child in a slot."""
        return resume(self.before[slot], child, self.right(slot))


def resume(state, child: bytes, right: bytes) -> bytes:
    now = state.copy()
    now.update(child)
    now.update(right)
    return now.hexdigest().encode()


def build(nodes: Sequence[bytes], fan: int, levels: int | None) -> list[list[Parent]]:
    """Parents level by level: ``levels`` of them, or until one node is left."""
    out: list[list[Parent]] = []
    while len(out) < levels if levels is not None else len(nodes) > 1:
        out.append([Parent(nodes[k : k + fan]) for k in range(0, len(nodes), fan)])
        nodes = [p.digest for p in out[-1]]
    return out


def _spans(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[list[tuple]]:
    """Rows of one (grp, span) after the other, as tuples of ``columns``."""
    key, held = None, []
    for batch in batches:
        keys = zip(batch.column("grp").to_pylist(), batch.column("span").to_pylist())
        for own, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in columns))):
            if own != key and held:
                yield held
                held = []
            key = own
            held.append(row)
    if held:
        yield held


def _dealt(df: DataFrame) -> DataFrame:
    """Spans whole and in order within partitions. A span has a bounded number of rows."""
    return df.repartition("grp", "span").sortWithinPartitions("grp", "span", "pos")


def _levels(n: int, fan: int, depth: int) -> int | None:
    """A group of several spans has all levels of each; a group in one ends at its root."""
    return depth if n > fan**depth else None


def ascend(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> list[DataFrame]:
    """``nodes`` (grp, pos, n, digest), the roots of its spans, those of their spans ...

    ``n`` is the number of nodes of a group. The last table has one row per group.
    """
    size = fan**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _spans(batches, ("grp", "span", "n", "digest")):
            grp, span, n, _ = rows[0]
            top = build([r[3].hex().encode() for r in rows], fan, _levels(n, fan, depth))
            digest = bytes.fromhex(top[-1][0].digest.decode()) if top else rows[0][3]
            out.append((grp, span, -(-n // size), digest))
        cols = list(zip(*out)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["grp", "pos", "n", "digest"])

    tables = [nodes]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        spans = tables[-1].select("grp", F.expr(f"pos div {size}").alias("span"), "pos", "n", "digest")
        tables.append(stored(map_arrow(_dealt(spans), run, _NODE)))
    return tables


def descend(tables: list[DataFrame], paths: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """Paths of the nodes of ``tables[0]``, given those of the last table's nodes.

    A path (grp, pos, path, subroot, root) has the siblings to the left and to the right
    of each level, from the node up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _spans(batches, ("grp", "pos", "n", "digest", "path", "subroot", "root")):
            (grp, _, _, _, above, subroot, root), rows = rows[0], rows[1:]
            top = build([r[3].hex().encode() for r in rows], fan, _levels(rows[0][2], fan, depth))
            held = []
            for slot in range(len(rows)):
                own = []
                for level in top:
                    own.append({"left": level[slot // fan].left(slot % fan), "right": level[slot // fan].right(slot % fan)})
                    slot //= fan
                held.append(own + above)
            n = len(rows)
            kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
            cols = [pa.array([grp] * n, pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array(held, kind)]
            cols += [pa.array([x] * n, pa.binary()) for x in (subroot, root)]
            yield pa.RecordBatch.from_arrays(cols, ["grp", "pos", "path", "subroot", "root"])

    for nodes in tables[-2::-1]:
        both = _with_paths(nodes, paths, [], fan**depth)
        paths = stored(map_arrow(both, run, f"grp string, pos bigint, path {_PATH}, subroot binary, root binary"))
    return paths


def _with_paths(nodes: DataFrame, paths: DataFrame, more: Sequence[str], size: int) -> DataFrame:
    """Nodes by span, the span's own path first, as a row of its own at -1."""
    own = nodes.select("grp", F.expr(f"pos div {size}").alias("span"), "pos", "n", "digest", *more)
    first = paths.select("grp", F.col("pos").alias("span"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
    return _dealt(own.unionByName(first, allowMissingColumns=True))


@dataclass
class Manifest:
    """``leaves``: grp, pos, n, digest, changed and the kept columns as ``k0`` ... ``paths``:
    the way from each span of leaves to the root. ``subroots``: (grp, digest), the group
    behind a plus sign, or empty for null. ``root`` in hex; null for an empty table."""

    leaves: DataFrame
    paths: DataFrame
    subroots: DataFrame
    root: str | None
    keep: list[str]
    fan: int
    depth: int


def field(name: str | Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = (F.col(name) if isinstance(name, str) else name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: str | Column) -> Column:
    """Digest of a row's fields, concatenated."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def manifest(
    rows: DataFrame, group: str, order: str, digest: Column, keep: Sequence[str] = (), changed: Column | None = None,
    fan: int = FAN, depth: int = DEPTH,
) -> Manifest:
    """Trees over ``rows`` by ``group``, in ascending ``order`` (nulls first, ties by
    digest, so that repeated rows have one result), and one over the groups (null first,
    by bytes). ``changed`` is the digest of a row that is to be folded in its place, null
    where nothing changes. Only named columns are read. Leaves and the tables above them
    are stored in the checkpoint folder.
    """
    own = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    change = (changed if changed is not None else F.lit(None)).cast("binary")
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    named = rows.select(own.alias("grp"), F.col(order).alias("ord"), digest.alias("digest"), change.alias("changed"), *kept)
    leaves = sorted_positions(named, ["ord", "digest", "changed"], ["grp"], "pos", "n")
    below = ascend(leaves, fan, depth)
    subroots = below[-1].select("grp", "digest")
    top = sorted_positions(subroots, ["grp"], [], "pos", "n")
    top = stored(top.select(F.lit("").alias("grp"), "pos", "n", "digest", F.col("grp").alias("of")))
    above = ascend(top, fan, depth)
    root = above[-1].select("digest").first()
    value = F.lit(bytes(root[0]) if root else None).cast("binary")
    start = above[-1].select("grp", "pos", F.array().cast(_PATH).alias("path"), value.alias("subroot"), value.alias("root"))
    ways = descend(above, start, fan, depth).select("pos", "path", "root").join(top.select("pos", "of", "digest"), "pos")
    ways = ways.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    # Down to the spans of leaves; where the leaves are the last table, a row is a span.
    paths = descend(below[1:], ways, fan, depth) if len(below) > 1 else ways
    return Manifest(leaves, paths, subroots, bytes(root[0]).hex() if root else None, list(keep), fan, depth)


def fold_leaves(found: Manifest) -> DataFrame:
    """For every leaf its kept columns, leaf, subroot, root, proof_sha256, folded_root (all
    hex) and verified: the root that follows from its changed digest (the leaf itself
    where there is none) and its siblings, and whether it is the manifest's.

    The proof is the digest of all siblings from the leaf's run up to the root's.
    """
    fan, depth = found.fan, found.depth
    kinds = [found.leaves.schema[f"k{i}"].dataType for i in range(len(found.keep))]
    arrow = [to_arrow_type(k) for k in kinds]
    inside = [f"k{i}" for i in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _spans(batches, ("n", "digest", "path", "subroot", "root", "changed", *inside)):
            (_, _, path, subroot, root, *_), rows = rows[0], rows[1:]
            leaves = [r[1].hex().encode() for r in rows]
            levels = build(leaves, fan, _levels(rows[0][0], fan, depth))
            above = [(hashlib.sha256(x["left"]), x["right"]) for x in path]
            tail = b"".join(x["left"] + x["right"] for x in path)
            root, subroot = root.hex(), subroot.hex()
            proofs, folded = [], []
            for slot, (now, r) in enumerate(zip(leaves, rows)):
                siblings = hashlib.sha256()
                if r[5] is not None:
                    now = r[5].hex().encode()
                for level in levels:
                    parent, at = level[slot // fan], slot % fan
                    siblings.update(parent.left(at))
                    siblings.update(parent.right(at))
                    now = parent.fold(at, now)
                    slot //= fan
                siblings.update(tail)
                for state, right in above:
                    now = resume(state, now, right)
                proofs.append(siblings.hexdigest())
                folded.append(now.decode())
            n = len(rows)
            cols = [pa.array([r[6 + i] for r in rows], kind) for i, kind in enumerate(arrow)]
            text = [[x.decode() for x in leaves], [subroot] * n, [root] * n, proofs, folded]
            cols += [*(pa.array(c, pa.string()) for c in text), pa.array([x == root for x in folded])]
            yield pa.RecordBatch.from_arrays(cols, [*inside, *(f"r{i}" for i in range(6))])

    rows = _with_paths(found.leaves, found.paths, ["changed", *inside], fan**depth)
    head = [f"{c} {k.simpleString()}" for c, k in zip(inside, kinds)]
    out = map_arrow(rows, run, ", ".join([*head, *(f"r{i} string" for i in range(5)), "r5 boolean"]))
    names = free_names(found.keep, ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return out.select(
        *(F.col(c).alias(k) for c, k in zip(inside, found.keep)), *(F.col(f"r{i}").alias(c) for i, c in enumerate(names))
    )


#: Levels of the SQL that checks the query, within a source and above all sources.
_SQL_LEVELS, _SQL_TOP = 6, 4


def _sql() -> str:
    """The tree level by level over all rows, and the fold of every row."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}), 4294967295)"
    hashed = lambda text: "sha256(concat({}))".format(
        ", ".join(
            f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({v} AS VARCHAR)), ':', {v}) END"
            for c, v in [("doc_id", "doc_id"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars"), ("text", text)]
        )
    )
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""WITH l AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE concat('+', source) END AS grp, {hashed("text")} AS leaf,
            CASE WHEN {crc} % 5 = 0 THEN {hashed(folded)} ELSE {hashed("text")} END AS changed FROM documents)""",
        """o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS p,
            row_number() OVER () AS id FROM l)""",
        "n0 AS MATERIALIZED (SELECT grp, p, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM o)",
        "f0 AS MATERIALIZED (SELECT id, grp, p, changed AS h, '' AS proof FROM o)",
    ]
    k = 0

    def level() -> None:
        nonlocal k
        one = "CASE WHEN max(n.n) = 1 THEN any_value(n.h) ELSE sha256(string_agg(n.h, '' ORDER BY n.p)) END"
        parts.append(
            f"n{k + 1} AS MATERIALIZED (SELECT grp, p // 16 AS p, {one} AS h, (max(n.n) + 15) // 16 AS n FROM n{k} n GROUP BY grp, p // 16)"
        )
        swap = "string_agg(CASE WHEN n.p = f.p THEN f.h ELSE n.h END, '' ORDER BY n.p)"
        rest = "string_agg(CASE WHEN n.p = f.p THEN '' ELSE n.h END, '' ORDER BY n.p)"
        parts.append(
            f"""f{k + 1} AS MATERIALIZED (SELECT f.id, any_value(f.grp) AS grp, any_value(f.p // 16) AS p,
            CASE WHEN max(n.n) = 1 THEN any_value(f.h) ELSE sha256({swap}) END AS h, any_value(f.proof) || {rest} AS proof
            FROM f{k} f JOIN n{k} n ON f.grp = n.grp AND f.p // 16 = n.p // 16 GROUP BY f.id)"""
        )
        k += 1

    for _ in range(_SQL_LEVELS):
        level()
    sub = k
    parts.append(
        f"n{k + 1} AS MATERIALIZED (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS p, h, count(*) OVER () AS n, grp AS source FROM n{k})"
    )
    parts.append(
        f"f{k + 1} AS MATERIALIZED (SELECT f.id, '' AS grp, n.p, f.h, f.proof FROM f{k} f JOIN n{k + 1} n ON f.grp = n.source)"
    )
    k += 1
    for _ in range(_SQL_TOP):
        level()
    return ", ".join(parts) + (
        f""" SELECT o.doc_id, o.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM o JOIN f{k} f ON o.id = f.id JOIN n{sub} s ON o.grp = s.grp CROSS JOIN n{k} r"""
    )


@query("op12_merkle", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what folding tampered texts gives."""
    docs = table(spark, sf_dir, "documents")
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaf_of = lambda text: leaf("doc_id", "source", "lang", "n_chars", text)
    changed = F.when(tampered, leaf_of(F.translate("text", upper, lower)))
    return fold_leaves(manifest(docs, "source", "doc_id", leaf_of("text"), ["doc_id"], changed))
