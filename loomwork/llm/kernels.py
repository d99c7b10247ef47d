"""Numpy kernels over Arrow text batches, shared by the operators that hash words and shingles.

A batch of texts is hashed as one byte buffer: every byte is mapped to a random 64-bit value, a running sum of
value * P**position gives each word's polynomial hash by one subtraction, and a finaliser mixes it. No Python object is
made per word. Hashes depend on nothing but the bytes, so they agree between executors, runs and machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text hashed at once; the tables of powers are as long.
BLOCK_BYTES = 1_000_000
_ODD = 0x9E3779B97F4A7C15
_P = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i <= n."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            out = np.full(size + 1, U64(base))
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets into them (one more than rows); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(at) == 0 or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges of at most `limit` bytes each (a longer row stands alone)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (runs of bytes outside `space`) and each row's offsets into them."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~space[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    starts[firsts] = word[firsts]  # a row begins a word of its own
    ends = np.zeros(n + 1, bool)
    ends[1:] = word
    ends[1:n] &= ~word[1:]
    lasts = offsets[1:][offsets[1:] > 0]
    ends[lasts] = word[lasts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return s, e, np.searchsorted(s, offsets).astype(np.int64)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of the spans, then of their prefixes of so many bytes at most."""
    n = len(data)
    up, down = _power_tables(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    out = []
    for k in (None, *prefixes):
        to = e if k is None else np.minimum(e, s + k)
        out.append(mix((total[to] - total[s]) * down[s] + (to - s).astype(U64) + U64(0 if k is None else k * 0x10001)))
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes other than ASCII white space; A-Z lower-cased) and each row's offsets into them."""
    s, e, at = word_spans(data, offsets)
    if not len(s):
        return np.zeros(0, U64), at
    return span_hashes(_LOWER[data] if lower else data, s, e)[0], at


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, row by row, with offsets. A row of fewer words has one hash, of all of them; a row of none has none."""
    n, counts = len(words), np.diff(at)
    if n >= width:
        h = words[: n - width + 1].copy()
        for k in range(1, width):
            h = mix(h * U64(_ODD) + words[k : n - width + 1 + k])
    else:
        h = np.zeros(0, U64)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(out_at[-1], U64)
    long = np.flatnonzero(counts >= width)
    pick = np.repeat(at[:-1][long] - out_at[:-1][long], sizes[long])
    where = np.repeat(counts >= width, sizes)
    spots = np.flatnonzero(where)
    out[spots] = h[spots + pick]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        value = U64(0xA5A5A5A5A5A5A5A5 ^ int(counts[r]))
        for w in words[at[r] : at[r + 1]]:
            value = mix(np.array([value], U64) * U64(_ODD) + w)[0]
        out[out_at[r]] = value
    return out, out_at


def shingle_sets(column: pa.Array, width: int):
    """Yields (row, sorted distinct shingle hashes) for every row of a text column."""
    data, offsets = text_buffer(column)
    for start, stop in blocks(offsets):
        part = offsets[start : stop + 1]
        words, at = word_hashes(data[part[0] : part[-1]], part - part[0])
        h, hat = shingle_hashes(words, at, width)
        for r in range(stop - start):
            yield start + r, np.unique(h[hat[r] : hat[r + 1]])
