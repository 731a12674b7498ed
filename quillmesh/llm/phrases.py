"""Collocations by Toivonen's method: phrases that occur often, and how surprisingly.

A sample of documents proposes phrases, at a lowered threshold. One pass over all
documents counts them and their negative border exactly: every word, and every phrase
that was not proposed but whose two parts, it without its last and without its first
word, both were. A border phrase that turns out frequent is a failure, since longer ones
around it were not counted; further passes count what the failures open up, until no new
phrase is frequent. So results do not depend on the sample.

Words and phrases are known by 64-bit hashes, which differ between languages. Tasks learn
which phrases have been proposed or found from a membership filter of fixed size. It may
let phrases through that were not; they are counted exactly like all others, and none is
lost. The words of frequent phrases come from a last pass, in which each is looked for in
one of 1024 parts of the documents that is known to hold it.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import map_arrow, query, slices, table, task_cache
from quillmesh.llm.shingles import mix
from quillmesh.llm.store import is_member, membership, stored

LONGEST = 5
LEAST = 100
FIRST = 2000
#: One of so many documents is in the sample; its threshold is this share of what is
#: expected at the least count. Both change how many passes are needed, not the result.
SAMPLE = 8
LOWERED = 0.6
#: Phrases that a task holds before it sums them up.
CHUNK = 4_000_000
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20
UNKNOWN = "und"
#: Groups that the first phrases of a language are found in before they meet.
_SALTS = 256
_BUCKETS = 1024
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(LONGEST)]
_LENGTHS = [np.uint64(0x2545F4914F6CDD1D * (k + 1) % (1 << 64)) for k in range(LONGEST)]


def _tables() -> dict:
    rng = np.random.default_rng(411)
    base = int(rng.integers(1 << 62, 1 << 63)) | 1
    kind = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
    kind[list(b" \t")] = 1
    kind[list(b".,;:!?\n\v\f\r")] = 2
    size = 4 * BLOCK + 4096
    powers = {}
    for name, value in (("base", base), ("inverse", pow(base, -1, 1 << 64))):
        p = np.full(size, value, np.uint64)
        p[0] = 1
        powers[name] = np.cumprod(p, dtype=np.uint64)
    return powers | {"kind": kind, "values": rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)}


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial over a word's bytes; words of more than ``BLOCK`` bytes by a digest."""
    t, long_ = task_cache("phrases:tables", _tables), end - begin > BLOCK
    out = np.zeros(len(begin), np.uint64)
    for i in np.flatnonzero(long_):
        digest = hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    # What lies between long words goes through the tables, which are of fixed size.
    cuts = [0, *np.flatnonzero(long_).tolist(), len(begin)]
    for a, b in zip(cuts, cuts[1:]):
        a += int(a < b and long_[a])
        if a < b:
            first, last = int(begin[a]), int(end[b - 1])
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum(t["values"][data[first:last]] * t["base"][: last - first], out=sums[1:])
            x, y = begin[a:b] - first, end[a:b] - first
            out[a:b] = mix((sums[y] - sums[x]) * t["inverse"][x] + (y - x).astype(np.uint64))
    return out


def _block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word, and the number of piece borders up to each byte."""
    kind = task_cache("phrases:tables", _tables)["kind"][data]
    word = np.concatenate([[False], kind == 0, [False]])
    begin, end = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    return _hashes(data, begin, end), begin, end, np.cumsum(kind == 2)


def split_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, begin, end, piece and text of every word of some lower-cased texts.

    Texts stand one behind the other from ``starts``; words of one piece have the same
    number. Blocks are cut between words, texts count as pieces of their own.
    """
    parts, at, borders = [], 0, 0
    kind = task_cache("phrases:tables", _tables)["kind"]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        while stop < len(data) and not edge[stop]:
            gap = np.flatnonzero((kind[data[stop : stop + BLOCK]] > 0) | edge[stop : min(len(data), stop + BLOCK)])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(len(data), stop + BLOCK)
        own = data[at:stop]
        # A text's edge within a block separates words like a border between pieces.
        inside = np.flatnonzero(edge[at + 1 : stop]) + 1
        if len(inside):
            own = np.insert(own, inside, np.uint8(10))
        hashes, begin, end, seen = _block(own)
        piece = borders + seen[begin] if len(begin) else np.zeros(0, np.int64)
        borders += int(seen[-1]) if len(seen) else 0
        shift = np.searchsorted(inside + np.arange(len(inside)), begin, "right")
        parts.append((hashes, begin - shift + at, end - shift + at, piece))
        at = stop
        if at < len(edge) and edge[at]:
            borders += 1
    if not parts:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    hashes, begin, end, piece = (np.concatenate(x) for x in zip(*parts))
    return hashes, begin, end, piece, np.searchsorted(starts, begin, "right") - 1


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def key_of(rolled: np.ndarray, n: int) -> np.ndarray:
    return mix(rolled ^ _LENGTHS[n - 1])


@dataclass
class Grams:
    """Words of some rows, by language, with their bytes in ``data``."""

    data: np.ndarray
    words: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    row: np.ndarray
    bucket: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Iterator[Grams]:
        """Runs of rows with a bounded number of bytes, or one long text."""
        langs, buckets = batch.column("_lang").to_pylist(), batch.column("_bucket").to_numpy()
        known = {x: lang_hash(x) for x in set(langs)}
        each = np.array([known[x] for x in langs], np.uint64)
        for first, _, data, starts in slices(batch.column("_text")):
            data = lowered(data)
            words, begin, end, piece, text = split_words(data, starts)
            row = text + first
            yield cls(data, mix(words + each[row]), begin, end, piece, row, buckets[row])

    def grow(self, longest: int, member: np.ndarray | None):
        """Phrases by growing length: n, where one starts whose two parts are both members,
        its key and whether it is a member itself."""
        words, piece = self.words, self.piece
        rolled = words * _FACTORS[0]
        at = np.arange(len(words))
        keys = key_of(rolled, 1)
        for n in range(1, longest + 1):
            hit = is_member(member, keys) if member is not None and len(keys) else np.zeros(len(keys), bool)
            yield n, at, keys, hit
            if n == longest or not hit.any():
                return
            inside = np.zeros(len(words) + 1, bool)
            inside[at[hit]] = True
            at = np.flatnonzero(inside[:-1] & inside[1:])
            at = at[piece[at] == piece[np.minimum(at + n, len(words) - 1)]]
            at = at[at + n < len(words)]
            rolled[: len(words) - n] += words[n:] * _FACTORS[n]
            keys = key_of(rolled[at], n + 1)


def count_phrases(docs: DataFrame, longest: int, member: np.ndarray | None, fresh: np.ndarray | None = None, only: int | None = None) -> DataFrame:
    """(key, n, code): how often all words and the phrases occur whose parts are members.

    With ``fresh``, only phrases of which a part is in that filter too; with ``only``,
    those of one length. ``code`` is 8 times a bucket that holds the phrase, plus its length.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((member, fresh))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, fresh = shared.value
        held, size = [], 0
        for batch in batches:
            for run_ in Grams.of(batch):
                was = None  # where a phrase of the length before starts that is new
                for n, at, keys, hit in run_.grow(longest, member):
                    keep = np.ones(len(at), bool)
                    if fresh is not None:
                        keep = was[at] | was[at + 1] if n > 1 else np.zeros(len(at), bool)
                        was = np.zeros(len(run_.words) + 1, bool)
                        was[at[hit]] = is_member(fresh, keys[hit])
                    if only is not None and n != only:
                        continue
                    held.append((keys[keep], (run_.bucket[at[keep]] * 8 + n).astype(np.int16)))
                    size += len(held[-1][0])
                if size >= CHUNK:
                    yield total(held)
                    held, size = [], 0
        if size:
            yield total(held)

    def total(held: list) -> pa.RecordBatch:
        keys, code = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(first, len(keys)))
        cols = [keys[first].view(np.int64), n, code[order[first]]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "n", "code"])

    parts = map_arrow(docs, run, "key bigint, n bigint, code smallint")
    return parts.groupBy("key").agg(F.sum("n").alias("n"), F.min("code").alias("code"))


def propose(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """(key): phrases that occur ``least`` times in some documents, length by length."""
    out, member = None, None
    for n in range(1, longest + 1):
        found = stored(count_phrases(docs, n, member, only=n).filter(F.col("n") >= least).select("key"))
        out = found if out is None else out.unionByName(found)
        if found.isEmpty():
            break
        member = membership(out, F.col("key"))
    return out


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(key, n, code) of all words and phrases that occur ``least`` times at least."""
    some = stored(docs.filter(F.pmod(F.xxhash64("_bucket", F.xxhash64("_text"), "_row"), F.lit(sample)) == 0))
    proposed = propose(some, longest, max(1, int(LOWERED * least / sample)))
    member = membership(proposed, F.col("key"))
    found = stored(count_phrases(docs, longest, member).filter(F.col("n") >= least))
    fresh = stored(found.join(proposed, "key", "left_anti").filter("code % 8 < " + str(longest)))
    while not fresh.isEmpty():
        all_, new = membership(found, F.col("key")), membership(fresh, F.col("key"))
        more = count_phrases(docs, longest, all_, new).filter(F.col("n") >= least)
        more = stored(more.join(found.select("key"), "key", "left_anti"))
        found, fresh = found.unionByName(more), more.filter("code % 8 < " + str(longest))
    return found


def spelled(docs: DataFrame, found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(key, lang, phrase, parts) of frequent phrases of two words and more.

    ``parts``: the keys of the first k words and of the rest, for k = 1, 2 ...
    """
    context = docs.sparkSession.sparkContext
    bucket = F.expr("cast(code div 8 AS bigint)")
    long_ = found.filter("code % 8 > 1")
    place = F.col("key").bitwiseXOR(F.shiftleft(bucket, 16)).bitwiseXOR(F.shiftleft(bucket, 42))
    shared = context.broadcast((membership(found, F.col("key")), membership(long_, place)))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, where = shared.value
        for batch in batches:
            langs = batch.column("_lang").to_pylist()
            for run_ in Grams.of(batch):
                data, begin, end, words = run_.data, run_.begin, run_.end, run_.words
                cols: list[list] = [[], [], [], []]
                for n, at, keys, hit in run_.grow(longest, member):
                    if n == 1:
                        continue
                    at, keys = at[hit], keys[hit]
                    own = run_.bucket[at].astype(np.uint64)
                    here = is_member(where, keys ^ (own << np.uint64(16)) ^ (own << np.uint64(42)))
                    keys, first = np.unique(keys[here], return_index=True)
                    at = at[here][first]
                    parts = []
                    for k in range(1, n):
                        for a, b in ((0, k), (k, n)):
                            rolled = np.zeros(len(at), np.uint64)
                            for j in range(a, b):
                                rolled += words[at + j] * _FACTORS[j - a]
                            parts.append(key_of(rolled, b - a).view(np.int64))
                    cols[0].append(keys.view(np.int64))
                    for i in at.tolist():
                        cols[1].append(langs[run_.row[i]])
                        cols[2].append(b" ".join([data[begin[j] : end[j]].tobytes() for j in range(i, i + n)]).decode())
                    cols[3] += np.stack(parts, 1).tolist() if len(at) else []
                keys = np.concatenate(cols[0]) if cols[0] else np.zeros(0, np.int64)
                kinds = (pa.string(), pa.string(), pa.list_(pa.int64()))
                out = [pa.array(keys), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))]
                yield pa.RecordBatch.from_arrays(out, ["key", "lang", "phrase", "parts"])

    rows = map_arrow(docs, run, "key bigint, lang string, phrase string, parts array<bigint>")
    # All rows of a key are alike; the join takes out what the filters let through.
    one = rows.groupBy("key").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"), F.first("parts").alias("parts"))
    return one.join(long_.select("key", F.col("n").alias("a")), "key")


def collocations(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", first: int = FIRST,
    longest: int = LONGEST, least: int = LEAST, sample: int = SAMPLE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``first`` phrases.

    ``a``, ``l`` and ``r`` are the occurrences of the phrase and of both sides of the cut
    that gives the lowest score, ``n`` those of all words of the language. A null text is
    empty, a null language ``und``. Rows are counted one by one, so repeated ones count
    as often as they occur; ids, null or not, only decide about the sample. Other columns
    are not read. No frequent phrase, no row.
    """
    docs = docs.select(
        F.coalesce(docs[lang].cast("string"), F.lit(UNKNOWN)).alias("_lang"),
        F.coalesce(docs[text], F.lit("")).alias("_text"),
        F.coalesce(docs[row_id].cast("string"), F.lit("")).alias("_row"),
    )
    docs = docs.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(_BUCKETS)).cast("int"))
    found = frequent_phrases(docs, longest, least, sample)
    spelled_ = stored(spelled(docs, found, longest))
    # Contained in a longer one that occurs as often: the first or last part of one by one word.
    last = F.size("parts")
    inside = spelled_.filter(last > 2).select(
        F.explode(F.array(F.element_at("parts", 2), F.element_at("parts", last - 1))).alias("key"), "a"
    )
    kept = spelled_.join(inside, ["key", "a"], "left_anti")
    sides = kept.select("key", F.posexplode("parts").alias("at", "part"))
    sides = sides.join(found.select(F.col("key").alias("part"), "n"), "part")
    sides = sides.groupBy("key", F.expr("at div 2 + 1").alias("k")).agg(
        F.max(F.when(F.col("at") % 2 == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("at") % 2 == 1, F.col("n"))).alias("r")
    )
    words = word_totals(docs)
    cut = kept.select("key", "lang", "phrase", "a").join(sides, "key").join(words, "lang")
    over = "cast(a AS decimal(15,0)) * cast(n AS decimal(18,0)) * 1000"
    score = F.expr(f"({over}) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    cut = cut.withColumn("score", score)
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("low")
    best = cut.groupBy("key", "lang", "phrase", "a", "n").agg(lowest).select("key", "lang", "phrase", "a", "n", "low.score", "low.l", "low.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod("key", F.lit(_SALTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= first)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def word_totals(docs: DataFrame) -> DataFrame:
    """(lang, n): occurrences of all words, counted in the JVM."""
    words = F.regexp_count("_text", F.lit("[^ \\t.,;:!?\\n\\x0B\\f\\r]+"))
    return docs.groupBy(F.col("_lang").alias("lang")).agg(F.sum(words.cast("long")).alias("n"))


_SQL = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase
    FROM w, range(1, 6) AS lengths(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
parts AS MATERIALIZED (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inner_ AS (SELECT lang, array_to_string(ws[1 : k - 1], ' ') AS phrase, a FROM parts WHERE k > 2
    UNION ALL SELECT lang, array_to_string(ws[2 : k], ' '), a FROM parts WHERE k > 2),
kept AS (SELECT * FROM parts p WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = p.lang AND i.phrase = p.phrase AND i.a = p.a)),
cuts AS (SELECT lang, phrase, a, k, unnest(range(1, k)) AS cut, ws FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n, c.cut,
    (1000 * CAST(c.a AS HUGEINT) * CAST(t.n AS HUGEINT)) // (CAST(x.a AS HUGEINT) * CAST(y.a AS HUGEINT)) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.cut], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.cut + 1 : c.k], ' ') JOIN total t ON t.lang = c.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""


@query("op11_phrases", _SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 most surprising phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))
