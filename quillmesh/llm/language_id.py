"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound as the product
of its letters' vectors, each permuted by its place; a text's vector bundles (sums) the
vectors of its n-grams, a language's those of its texts. A text gets the language whose
prototype has the largest cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import map_arrow, query, slices, table, task_cache

DIM = 1024
N = 3
#: Letter vectors. Letters beyond Latin, Greek and Cyrillic share them by a hash.
SYMBOLS = 4096
_DIRECT = 0x530
_SEED = 977
#: Text vectors are summed as whole numbers of this fraction, so that the sum does not
#: depend on the order of tasks.
_UNIT = float(1 << 20)
_DENSE = 1 << 22
UNKNOWN = "und"


def _symbol_table() -> np.ndarray:
    """Symbol of every code point; 0 for all that is no letter."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = 1 + c if c < _DIRECT else 1 + _DIRECT + (c * 2654435761 >> 7) % (SYMBOLS - _DIRECT - 1)
    return out


def _letter_vectors(dim: int, n: int) -> list[np.ndarray]:
    """For every place in an n-gram, the letter vectors permuted for it."""
    rng = np.random.default_rng(_SEED)
    letters = (rng.integers(0, 2, (SYMBOLS, dim), dtype=np.int8) * 2 - 1).astype(np.int8)
    return [np.roll(letters, n - 1 - k, axis=1) for k in range(n)]


def text_vectors(column: pa.Array, dim: int = DIM, n: int = N) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, vectors, has a letter) for runs of rows of a text column."""
    symbols = task_cache("language:symbols", _symbol_table)
    letters = task_cache(f"language:letters:{dim}:{n}", lambda: _letter_vectors(dim, n))
    for first, last, data, starts in slices(column):
        raw, m = data.tobytes(), last - first
        texts = [raw[starts[i] : starts[i + 1]].decode().lower() for i in range(m)]
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        own = symbols[code]
        row = np.repeat(np.arange(m), [len(t) + 1 for t in texts])
        lettered = np.bincount(row[own > 0], minlength=m) > 0
        stays = own > 0
        stays[1:] |= own[:-1] > 0  # a run of other characters is one gap
        own, row = own[stays].astype(np.int64), row[stays]
        # A gap before every text, so that first letters are seen as such.
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        own, row = np.insert(own, begin, 0), np.insert(row, begin, row[begin])
        used, own = np.unique(own, return_inverse=True) if len(own) else (own, own)
        vectors = np.zeros((m, dim), np.float32)
        if len(own) >= n:
            grams = np.zeros(len(own) - n + 1, np.int64)
            for k in range(n):
                grams = grams * len(used) + own[k : len(own) - n + 1 + k]
            inside = row[: len(grams)] == row[n - 1 :]
            grams, row = grams[inside], row[: len(inside)][inside]
            if len(used) ** n <= _DENSE:
                there = np.bincount(grams, minlength=len(used) ** n) > 0
                distinct = np.flatnonzero(there)
                index = (np.cumsum(there) - 1)[grams]
            else:
                distinct, index = np.unique(grams, return_inverse=True)
            for a in range(0, len(distinct), 16384):
                part = distinct[a : a + 16384]
                bound, rest = None, part.copy()
                for k in range(n - 1, -1, -1):
                    place = letters[k][used[rest % len(used)]]
                    bound = place if bound is None else bound * place
                    rest //= len(used)
                here = (index >= a) & (index < a + len(part)) if len(distinct) > 16384 else slice(None)
                cells = np.bincount(row[here] * len(part) + index[here] - a, minlength=m * len(part))
                vectors += cells.reshape(m, len(part)).astype(np.float32) @ bound.astype(np.float32)
        yield first, vectors, lettered


def fit_languages(
    docs: DataFrame, lang: str = "lang", text: str = "text", dim: int = DIM, n: int = N
) -> tuple[list[str], np.ndarray]:
    """Names and prototypes of the languages: the bundled unit vectors of their texts.

    Texts without a letter and rows without a language are left out. A task passes on
    one sum per language; only those of all languages reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("_lang").to_pylist(), object)
            for first, vectors, lettered in text_vectors(batch.column("_text"), dim, n):
                own = names[first : first + len(vectors)]
                norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
                unit = np.rint(vectors / np.maximum(norm, 1e-9)[:, None] * _UNIT).astype(np.int64)
                for name in set(own[lettered]):
                    got = unit[lettered & (own == name)].sum(0)
                    sums[name] = sums[name] + got if name in sums else got
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[x] for x in names], pa.list_(pa.int64()))], ["lang", "v"]
        )

    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    parts = map_arrow(known.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")), run, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("v")).orderBy("lang").collect()
    names = [r["lang"] for r in rows]
    matrix = np.array([[x["v"] for x in r["v"]] for r in rows], np.float64).reshape(-1, dim)
    return names, matrix / np.maximum(np.sqrt((matrix**2).sum(1)), 1e-9)[:, None]


def predict_languages(
    docs: DataFrame, model: tuple[Sequence[str], np.ndarray], row_id: str = "doc_id", text: str = "text",
    n: int = N,
) -> DataFrame:
    """``row_id``, ``lang_pred`` and ``score`` (the cosine, at least 0) of every row.

    ``und`` with score 0 for a null text, one without a letter, and for all if no
    language was learned. Ties go to the first name. Rows are independent: repeated
    rows and null ids come back as they are, nothing is shuffled.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    names, prototypes = list(model[0]), np.asarray(model[1], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred: list[str] = []
            scores = []
            for _, vectors, lettered in text_vectors(batch.column("_text"), prototypes.shape[1], n):
                v = vectors.astype(np.float64)
                cos = v @ prototypes.T / np.maximum(np.sqrt((v**2).sum(1)), 1e-9)[:, None]
                cos = np.round(cos, 9) if len(names) else np.zeros((len(v), 1))
                best = cos.argmax(1)
                known = lettered & bool(names)
                pred += [names[k] if ok else UNKNOWN for k, ok in zip(best, known)]
                scores.append(np.where(known, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0))
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(pred, pa.string()), pa.array(flat, pa.float64())],
                [row_id, "lang_pred", "score"],
            )

    schema = f"`{row_id}` {kind}, lang_pred string, score double"
    return map_arrow(docs.select(docs[row_id].alias("_id"), docs[text].alias("_text")), run, schema)


def held_out(row_id: str, folds: int, fold: int):
    """True where the id's crc32 falls in the fold; a null id does not."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string")) % folds == fold, F.lit(False))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds of ids."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(~held_out("doc_id", 4, 2)))
    out = predict_languages(docs, model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
