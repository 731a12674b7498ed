"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so it
grows with its text, sketches of parts merge by union, and the containment of a short
text in a very long one can be estimated. A text none of whose hashes is low enough
keeps its smallest one, marked, as a stand-in that gives way when sketches merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import map_arrow, query, table
from quillmesh.llm.shingles import SHINGLE, shingle_sets

#: One of so many hashes is kept.
SCALE = 8
_MARK = "~"


def sketch(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct hashes that stay; the smallest if none is low enough."""
    limit = np.uint64((1 << 64) // scale - 1)
    kept = hashes[: np.searchsorted(hashes, limit, "right")]
    return kept if len(kept) else hashes[:1]


def to_text(kept: np.ndarray, scale: int = SCALE) -> str:
    """16 hex digits per hash, ascending; a stand-in is marked by a tilde."""
    mark = _MARK if len(kept) and int(kept[0]) >= (1 << 64) // scale else ""
    return mark + kept.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint.removeprefix(_MARK)), ">u8").astype(np.uint64)


def merge(a: str, b: str) -> str:
    """The fingerprint of two texts' shingles together."""
    low = [x for x in (a, b) if x and not x.startswith(_MARK)]
    both = [from_text(x) for x in (low or [x for x in (a, b) if x])]
    kept = np.unique(np.concatenate(both)) if both else np.zeros(0, np.uint64)
    return to_text(kept) if low else (_MARK + to_text(kept[:1]).removeprefix(_MARK) if len(kept) else "")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two texts without words are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprint_documents(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", n: int = SHINGLE, scale: int = SCALE
) -> DataFrame:
    """``row_id``, ``n_chars`` and ``fingerprint`` of every row, without a shuffle.

    A null or empty text, or one of white space only, has an empty fingerprint.
    """
    kind = docs.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [to_text(sketch(h, scale), scale) for _, h in shingle_sets(batch.column("_text"), n)]
            chars = pa.compute.fill_null(pa.compute.utf8_length(batch.column("_text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), chars, pa.array(own, pa.string())], [row_id, "n_chars", "fingerprint"]
            )

    schema = f"`{row_id}` {kind}, n_chars bigint, fingerprint string"
    return map_arrow(docs.select(docs[row_id].alias("_id"), docs[text].alias("_text")), run, schema)


def with_next(docs: DataFrame, row_id: str, text: str, buckets: int | None = None) -> DataFrame:
    """Rows dealt out and sorted so that every row's successor follows it.

    The ids' range is cut into buckets at ids that occur; the first rows of a bucket
    also go, as lookahead (``_own`` false), to the end of the bucket before, and the
    first of all to the end of the last. Any cut points give the same successors. Rows
    of one id are ordered by a hash of their text, null ids come first.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(docs[row_id].alias("_id"))
    ranged = ids.repartitionByRange(buckets, F.col("_id").asc_nulls_first())
    heads = ranged.groupBy(F.spark_partition_id().alias("_p")).agg(F.min("_id").alias("_id"), F.count_if(F.col("_id").isNull()).alias("_n"))
    found = heads.collect()  # one row per bucket
    bounds = sorted({r["_id"] for r in found if r["_id"] is not None})
    nulls = any(r["_n"] for r in found)
    rows = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_h"))
    if bounds:
        # How many bounds are not above the id, by halving.
        cuts, low = F.lit(bounds), F.lit(0)
        for k in range(len(bounds).bit_length() - 1, -1, -1):
            ahead = low + F.lit(1 << k)
            rows = rows.withColumn("_at", F.when((ahead <= len(bounds)) & (F.get(cuts, ahead - 1) <= F.col("_id")), ahead).otherwise(low))
            low = F.col("_at")
        head = F.get(cuts, F.col("_at") - 1) == F.col("_id")
        first = F.col("_id").isNull() if nulls else F.col("_id") == F.lit(bounds[0])
    else:
        rows, head, first = rows.withColumn("_at", F.lit(0)), F.lit(False), F.lit(True)
    place = lambda at, own, wrap: F.struct(at.alias("at"), F.lit(own).alias("own"), F.lit(wrap).alias("wrap"))
    before = F.col("_at") > (0 if nulls else 1)
    places = F.array_compact(
        F.array(
            place(F.col("_at"), True, False),
            F.when(head & before, place(F.col("_at") - 1, False, False)),
            F.when(first, place(F.lit(len(bounds)), False, True)),
        )
    )
    dealt = rows.withColumn("_place", F.explode(places)).select(
        "_id", "_text", "_h", F.col("_place.at").alias("_at"), F.col("_place.own").alias("_own"), F.col("_place.wrap").alias("_wrap")
    )
    order = [F.col("_at"), F.col("_wrap"), F.col("_id").asc_nulls_first(), F.col("_h")]
    # As many partitions as the session has; their buckets follow one another.
    return dealt.repartition("_at").sortWithinPartitions(*order)


def compare_edited(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", n: int = SHINGLE, scale: int = SCALE
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first
    as many (or all) of the next row's text, in ascending ``row_id``, after the last
    the first. A null text is empty; a table of one row is its own successor; an empty
    table gives no rows. Each text is shuffled once.
    """
    kind = docs.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            kept = [sketch(h, scale) for _, h in shingle_sets(batch.column("_text"), n)]
            rows = list(zip(batch.column("_id").to_pylist(), texts, kept, batch.column("_at").to_pylist(), batch.column("_own").to_pylist()))
            if waiting is not None:
                rows.insert(0, waiting)
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[4] and a[3] == b[3]]
            if rows:
                waiting = rows[-1]
            edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
            column = pa.array(edited, pa.large_string())
            new = [sketch(h, scale) for _, h in shingle_sets(column, n)]
            out = [
                pa.array([a[0] for a, _ in pairs], batch.column("_id").type),
                pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([to_text(a[2], scale) for a, _ in pairs], pa.string()),
                pa.array([to_text(s, scale) for s in new], pa.string()),
                pa.array([likeness(a[2], s) for (a, _), s in zip(pairs, new)], pa.float64()),
                pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(out, [row_id, *names])

    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = ["bigint", "string", "string", "string", "double", "double"]
    schema = ", ".join([f"`{row_id}` {kind}", *(f"{c} {k}" for c, k in zip(names, kinds))])
    dealt = with_next(docs, row_id, text)
    return map_arrow(dealt.select("_id", "_text", "_at", "_own"), run, schema)


@query("op4_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_edited(table(spark, sf_dir, "documents"))
