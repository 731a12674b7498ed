"""Registry and task helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Rows of one Arrow batch at most, so that a batch of long texts fits in a worker.
BATCH_ROWS = 2000
#: Bytes of one at most, up to its last row; the JVM and the worker hold a few each.
BATCH_BYTES = 2 << 20
#: Text bytes that a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``.

    Workers go on to tasks of other operators, so each task ends by giving the memory
    that it freed back to the system.
    """

    def task(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim()

    conf = df.sparkSession.conf
    rows, size = (f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes"))
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if _bytes(conf.get(size)) > BATCH_BYTES:
        conf.set(size, str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def _bytes(setting: str) -> int:
    """A size as Spark's settings write it: ``4096``, ``64m``, ``67108864b``."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def trim() -> None:
    """Return the C allocator's free pages, where the system's library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def free_names(taken, wanted) -> list[str]:
    """``wanted``, with an underscore added to each until no name in ``taken`` is the same
    (in any case, as Spark compares names)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def task_cache(key: str, make: Callable[[], object]):
    """An object that lives on in the Python worker until a task of another kind runs.

    Functions travel by value, so their own globals are new in every task. Keys of one
    kind have the part before a colon in common.
    """
    name = "_quillmesh_llm_cache"
    store = sys.modules.setdefault(name, types.SimpleNamespace(kept={})).kept
    if key not in store:
        kind = key.partition(":")[0]
        for other in [k for k in store if k.partition(":")[0] != kind]:
            del store[other]
        store[key] = make()
    return store[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; nulls are empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``size`` bytes of text: first, last + 1, bytes, starts."""
    data, starts = utf8(column)
    n, i = len(starts) - 1, 0
    while i < n:
        j = int(np.searchsorted(starts, starts[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        i = j
