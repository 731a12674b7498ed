"""Answer quality against a reference text: ``pairs(pair_id, pred, ref)``.

Counts of n-grams and alignments along the whole text (longest common subsequence,
word edit distance) run in Arrow batches, in the task that has the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import word_terms, ws_tokens

SIDES = ("pred", "ref")


#: Symbols counted at once; bounds the arrays of a task.
SYMBOLS = 1 << 20


def letters(text: Column) -> Column:
    """The text without white space, whose characters are the tokens."""
    return F.regexp_replace(text, r"\s+", "")


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of all texts as small numbers, the number of tokens per text, of values."""
    if pa.types.is_list(texts.type):
        sizes = np.diff(texts.offsets.to_numpy())
        coded = texts.flatten().dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), sizes, max(1, len(coded.dictionary))
    own = texts.to_pylist()
    points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
    used = np.zeros(0x110000, bool)
    used[points] = True
    number = np.cumsum(used) - 1
    return number[points], np.array([len(t) for t in own], np.int64), max(1, int(used.sum()))


def clipped_matches(pred: pa.ListArray, ref: pa.ListArray, longest: int) -> np.ndarray:
    """Matches, n-grams of ``pred`` and of ``ref``, as (3, longest, rows) for n from 1.

    Every row has a list of texts, whose n-grams are counted together. A gram is the
    number of the one before its last token with that token; where numbers get too large,
    those that occur are numbered anew, so different grams never meet.
    """
    rows = len(pred)
    codes, sizes, base = _symbols(pa.concat_arrays([pred.flatten(), ref.flatten()]))
    row = np.concatenate([np.repeat(np.arange(rows), np.diff(x.offsets.to_numpy())) for x in (pred, ref)])
    side = np.repeat([0, 1], [len(pred.flatten()), len(ref.flatten())])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # tokens up to the text's end
    owner = np.repeat(row * 2 + side, sizes)
    at, gram, top = np.arange(len(codes)), np.zeros(len(codes), np.int64), 1
    out = np.zeros((3, longest, rows), np.int64)
    for n in range(1, longest + 1):
        inside = left[at] >= n
        at, gram = at[inside], gram[inside]
        if top > (1 << 62) // (2 * rows * base):
            seen, gram = np.unique(gram, return_inverse=True)
            top = max(1, len(seen))
        gram = gram * base + codes[at + n - 1]
        top *= base
        own = owner[at]
        key = np.sort(gram * (2 * rows) + own)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(first, append=len(key))
        key = key[first]
        # The two sides of a gram of a row are neighbours.
        both = np.flatnonzero((key[1:] >> 1 == key[:-1] >> 1)) if len(key) else first
        met = np.minimum(count[both], count[both + 1]) if len(both) else count[:0]
        out[0, n - 1] = np.bincount((key[both] >> 1) % rows, met, rows)
        out[1:, n - 1] = np.bincount(own, minlength=2 * rows).reshape(rows, 2).T
    return out


def gram_counts(pairs: DataFrame, sorts: Sequence[tuple[Callable[[Column], Column], int]]) -> DataFrame:
    """``pair_id, matched, n_pred, n_ref``: arrays with clipped matches per order.

    A sort makes tokens of a text and has orders from 1 to its number; arrays hold the
    orders of all sorts one behind the other. Grams are counted within the task that has
    the texts, some texts at a time, so they neither travel nor become rows.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pairs.select("pair_id", "pred", "ref").repartition(parts, "pair_id")
    texts = placed.groupBy("pair_id").agg(*[F.collect_list(c).alias(c) for c in SIDES])
    tokens = texts.select(
        "pair_id", *[F.transform(c, make).alias(f"_{c}{i}") for i, (make, _) in enumerate(sorts) for c in SIDES]
    )
    longest = [n for _, n in sorts]
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def size(x: pa.ListArray) -> np.ndarray:
        """Tokens, about, up to each row's end."""
        texts = x.flatten()
        inner = np.diff(texts.offsets.to_numpy()) if pa.types.is_list(texts.type) else pc.utf8_length(texts).to_numpy()
        upto = np.append(0, np.cumsum(inner))
        offsets = x.offsets.to_numpy()
        return upto[offsets[1:] - offsets[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(k) for k in range(1, batch.num_columns)]
            block = sum(size(x) for x in sides) // SYMBOLS
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                # A slice keeps its parent's offsets, a taken array has its own.
                part = [x.take(pa.array(np.arange(a, b))) for x in sides]
                counts = np.concatenate(
                    [clipped_matches(part[2 * i], part[2 * i + 1], n) for i, n in enumerate(longest)], 1
                )
                ends = pa.array(np.arange(b - a + 1) * sum(longest), pa.int32())
                cols = [pa.ListArray.from_arrays(ends, pa.array(c.T.ravel())) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *cols], ["pair_id", "matched", "n_pred", "n_ref"]
                )

    listed = "array<bigint>"
    return tokens.mapInArrow(run, f"pair_id {kind}, matched {listed}, n_pred {listed}, n_ref {listed}")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _share(2 * p * r, p + r)


def rouge_n(pairs: DataFrame, orders: Sequence[int] = (1, 2)) -> DataFrame:
    """``rouge{n}_p/r/f1`` per pair."""
    counts = gram_counts(pairs, [(word_terms, max(orders))])
    cols = []
    for n in orders:
        m, np_, nr = (F.col(c)[n - 1] for c in ("matched", "n_pred", "n_ref"))
        p, r = _share(m, np_), _share(m, nr)
        cols += [
            p.alias(f"rouge{n}_p"),
            r.alias(f"rouge{n}_r"),
            _f1(p, r).alias(f"rouge{n}_f1"),
        ]
    return _all_pairs(pairs, counts.select("pair_id", *cols))


def _all_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs without any token score zero."""
    names = [c for c in scores.columns if c != "pair_id"]
    return pairs.select("pair_id").join(scores, "pair_id", "left").na.fill(0.0, names)


def chrf(pairs: DataFrame, words: int = 0, chars: int = 6, beta: float = 2.0) -> DataFrame:
    """chrF in [0, 1]; ``words=2`` gives chrF++.

    Precision and recall are means over the orders that both sides have.
    """
    counts = gram_counts(pairs, [(letters, chars), (ws_tokens, words)] if words else [(letters, chars)])
    both = [(F.col("n_pred")[i] > 0) & (F.col("n_ref")[i] > 0) for i in range(chars + words)]
    n = sum(x.cast("int") for x in both)

    def mean(c: str) -> Column:
        shares = [F.when(x, F.col("matched")[i] / F.col(c)[i]).otherwise(F.lit(0.0)) for i, x in enumerate(both)]
        return F.when(n > 0, sum(shares) / n)

    means = counts.select("pair_id", mean("n_pred").alias("_p"), mean("n_ref").alias("_r"))
    b2 = beta * beta
    score = _share((1 + b2) * F.col("_p") * F.col("_r"), b2 * F.col("_p") + F.col("_r"))
    return _all_pairs(pairs, means.select("pair_id", score.alias("chrf")))


def bleu(pairs: DataFrame, orders: int = 4) -> DataFrame:
    """Sentence BLEU with add-one smoothing of every order and brevity penalty."""
    ns = range(1, orders + 1)
    counts = gram_counts(pairs, [(word_terms, orders)])
    per = counts.select(
        "pair_id", *[F.col(c)[n - 1].alias(f"{c}{n}") for n in ns for c in ("matched", "n_pred", "n_ref")]
    )
    logs = F.lit(0.0)
    for n in ns:
        logs = logs + F.log((F.col(f"matched{n}") + 1) / (F.col(f"n_pred{n}") + 1))
    c, r = F.col("n_pred1"), F.col("n_ref1")
    penalty = F.exp(F.least(F.lit(0.0), 1 - r / c))
    score = F.when(c > 0, penalty * F.exp(logs / orders)).otherwise(F.lit(0.0))
    return _all_pairs(pairs, per.select("pair_id", score.alias("bleu")))


def meteor(pairs: DataFrame) -> DataFrame:
    """Exact-match METEOR: the k-th use of a word aligns with its k-th use.

    F-mean is ``10PR / (R + 9P)``, less ``0.5 * (chunks / matches)^3``.
    """

    def occurrences(side: str) -> DataFrame:
        rows = pairs.select("pair_id", F.posexplode(word_terms(side)).alias("pos", "token"))
        w = Window.partitionBy("pair_id", "token").orderBy("pos")
        return rows.withColumn("occ", F.row_number().over(w))

    p = occurrences("pred").withColumnRenamed("pos", "ppos")
    r = occurrences("ref").withColumnRenamed("pos", "rpos")
    met = p.join(r, ["pair_id", "token", "occ"])
    w = Window.partitionBy("pair_id").orderBy("ppos")
    same = (F.lag("ppos").over(w) == F.col("ppos") - 1) & (
        F.lag("rpos").over(w) == F.col("rpos") - 1
    )
    chunks = (
        met.withColumn("_new", F.when(same, 0).otherwise(1))
        .groupBy("pair_id")
        .agg(F.count(F.lit(1)).alias("m"), F.sum("_new").alias("ch"))
    )
    sizes = pairs.select(
        "pair_id", F.size(word_terms("pred")).alias("np"), F.size(word_terms("ref")).alias("nr")
    )
    prec, rec = F.col("m") / F.col("np"), F.col("m") / F.col("nr")
    mean = 10 * prec * rec / (rec + 9 * prec)
    score = mean * (1 - 0.5 * F.pow(F.col("ch") / F.col("m"), 3))
    return _all_pairs(
        pairs, sizes.join(chunks, "pair_id").select("pair_id", score.alias("meteor"))
    )


def cer(pred: str, ref: str) -> Column:
    """Character edit distance over reference length."""
    return F.levenshtein(F.col(pred), F.col(ref)) / F.greatest(F.length(ref), F.lit(1))


def _masks(tokens) -> dict:
    masks: dict = {}
    for i, t in enumerate(tokens):
        masks[t] = masks.get(t, 0) | (1 << i)
    return masks


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence, one big-integer step per token of ``b``."""
    full = (1 << len(a)) - 1
    masks, row = _masks(a), full
    for t in b:
        hit = row & masks.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Unit-cost edit distance, one big-integer step per token of ``b``."""
    if not len(a):
        return len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    masks, plus, minus, dist = _masks(a), full, 0, len(a)
    for t in b:
        eq = masks.get(t, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph = (ph << 1) | 1
        mh = mh << 1
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv & full
    return dist


def _lcs_members(ref: Sequence, pred: Sequence) -> set:
    """Positions of ``ref`` on one longest common subsequence.

    Row i of the table is one big integer over ``pred``, with a zero bit wherever the
    length grows by one, so a step is a few integer operations and the rows of two
    20,000-word lines take 50 MB.
    """
    masks, full = _masks(pred), (1 << len(pred)) - 1
    rows = [full]
    for t in ref:
        hit = rows[-1] & masks.get(t, 0)
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    out, i, j = set(), len(ref), len(pred)
    now = length(i, j)
    while i and j:
        if ref[i - 1] == pred[j - 1]:
            out.add(i - 1)
            i, j, now = i - 1, j - 1, now - 1
        elif not rows[i] >> (j - 1) & 1 or length(i - 1, j) == now:
            i -= 1
        else:
            j -= 1
    return out


def _lcs(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [(lcs_length(list(p), list(r)), len(p), len(r)) for p, r in zip(pred, ref)]
    return pd.DataFrame(rows, columns=["lcs", "n_pred", "n_ref"])


def _word_edits(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(list(r), list(p)) for p, r in zip(pred, ref)], dtype="int64")


def _lcs_union(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = []
    for ps, rs in zip(pred, ref):
        met = 0
        for r in rs:
            seen: set = set()
            for p in ps:
                seen |= _lcs_members(list(r), list(p))
            met += len(seen)
        rows.append((met, sum(len(p) for p in ps), sum(len(r) for r in rs)))
    return pd.DataFrame(rows, columns=["lcs", "n_pred", "n_ref"])


# Return type of the alignment functions; they become UDFs once a session runs.
LCS = "lcs long, n_pred long, n_ref long"


def _lcs_scores(scored: DataFrame, name: str) -> DataFrame:
    p = _share(F.col("_l.lcs"), F.col("_l.n_pred"))
    r = _share(F.col("_l.lcs"), F.col("_l.n_ref"))
    return scored.select(
        "pair_id",
        p.alias(f"{name}_p"),
        r.alias(f"{name}_r"),
        _f1(p, r).alias(f"{name}_f1"),
    )


def rouge_l(pairs: DataFrame) -> DataFrame:
    """LCS over the whole texts."""
    scored = pairs.select("pair_id", F.pandas_udf(_lcs, LCS)(word_terms("pred"), word_terms("ref")).alias("_l"))
    return _lcs_scores(scored, "rougeL")


def rouge_lsum(pairs: DataFrame) -> DataFrame:
    """Union of the LCS of every reference line with all predicted lines."""

    def lines(c: str) -> Column:
        return F.transform(F.split(F.col(c), "\n"), word_terms)

    scored = pairs.select("pair_id", F.pandas_udf(_lcs_union, LCS)(lines("pred"), lines("ref")).alias("_l"))
    return _lcs_scores(scored, "rougeLsum")


def wer(pairs: DataFrame) -> DataFrame:
    """Word edit distance over the number of reference words."""
    edits = F.pandas_udf(_word_edits, "long")(ws_tokens("pred"), ws_tokens("ref"))
    n = F.greatest(F.size(ws_tokens("ref")), F.lit(1))
    return pairs.select("pair_id", (edits / n).alias("wer"))


def clean_perplexity(df: DataFrame, col: str = "perplexity") -> DataFrame:
    """Missing values count as 50; values above 1600 become 0 and are flagged."""
    value = F.coalesce(F.when(~F.isnan(col), F.col(col)), F.lit(50.0))
    huge = value > 1600
    return df.withColumn("too_large", huge).withColumn(
        col, F.when(huge, F.lit(0.0)).otherwise(value)
    )
