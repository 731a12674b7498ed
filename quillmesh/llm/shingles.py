"""Words and word shingles of whole texts as 64-bit hashes, by numpy.

Words are runs of bytes other than space and 0x09-0x0D. A word's
hash is a polynomial in an odd base over random byte values, a shingle's the same
over the hashes of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillmesh.llm.common import slices, task_cache

BLOCK = 1 << 20
SHINGLE = 5
_SEED = 20240607


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables() -> dict:
    rng = np.random.default_rng(_SEED)
    exact = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    values = exact.copy()
    for c in range(65, 91):
        values[c] = values[c + 32]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    base = int(rng.integers(1 << 62, 1 << 63)) | 1
    inverse = pow(base, -1, 1 << 64)
    return {"values": values, "exact": exact, "space": space, "base": base, "inverse": inverse, "n": 0}


def _powers(n: int) -> dict:
    """The tables with powers of the base and of its inverse up to ``n``."""
    t = task_cache("words:tables", _tables)
    if t["n"] < n:
        size = max(n, BLOCK + 4096)
        for name in ("base", "inverse"):
            p = np.full(size, t[name], np.uint64)
            p[0] = 1
            t[f"{name}_pow"] = np.cumprod(p, dtype=np.uint64)
        t["n"] = size
    return t


def _block_words(data: np.ndarray, starts: np.ndarray, values: str, tails: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the number of words before each start."""
    t = _powers(len(data) + 1)
    word = ~t["space"][data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    begin = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(t[values][data] * t["base_pow"][: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * t["inverse_pow"][begin] + (end - begin).astype(np.uint64))
    if tails is not None:
        two = np.where(end - begin > 1, data[np.maximum(end - 2, 0)], 0).astype(np.uint16)
        tails.append(two << 8 | data[end - 1])
    return hashes, np.searchsorted(begin, starts)


def word_hashes(
    data: np.ndarray, starts: np.ndarray, fold: bool = True, tails: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words start.

    With ``fold`` A-Z count as a-z. ``tails`` takes arrays of the words' last two bytes.

    A single long text is cut into blocks at white space, so memory beyond the
    hashes themselves does not grow with its length.
    """
    values = "values" if fold else "exact"
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    if len(starts) > 2 or len(data) <= 2 * BLOCK:
        return _block_words(data, starts, values, tails)
    space, parts, at = task_cache("words:tables", _tables)["space"], [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):
            gap = np.flatnonzero(space[data[end : end + BLOCK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + BLOCK)
        piece = data[at:end]
        parts.append(_block_words(piece, np.array([0, len(piece)]), values, tails)[0])
        at = end
    hashes = np.concatenate(parts)
    return hashes, np.array([0, len(hashes)])


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles, and where each text's shingles start.

    A text with fewer words has its whole sequence as its only shingle, one
    without words has none.
    """
    counts = np.diff(at)
    factors = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(n)]
    per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_at = np.zeros(len(at), np.int64)
    np.cumsum(per, out=out_at[1:])
    if len(words) == 0:
        return np.zeros(0, np.uint64), out_at
    rolled = words * np.uint64(factors[0])
    for k in range(1, n):
        rolled[:-k] += words[k:] * np.uint64(factors[k])
    text = np.repeat(np.arange(len(per)), per)
    index = np.arange(len(text)) - out_at[text] + at[text]
    out = rolled[index]
    short = np.flatnonzero((counts > 0) & (counts < n))
    for i in short:
        w = words[at[i] : at[i + 1]]
        h = np.uint64(0)
        for k, x in enumerate(w):
            h = np.uint64((int(h) + int(x) * factors[k]) % (1 << 64))
        out[out_at[i]] = np.uint64((int(h) + len(w) * 0x2545F4914F6CDD1D) % (1 << 64))
    return mix(out), out_at


def shingle_sets(column: pa.Array, n: int = SHINGLE):
    """Yield (row, sorted distinct shingle hashes) for every row of a text column."""
    for first, last, data, starts in slices(column):
        hashes, at = shingle_hashes(*word_hashes(data, starts), n)
        for i in range(last - first):
            yield first + i, np.unique(hashes[at[i] : at[i + 1]])
