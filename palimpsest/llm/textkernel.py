"""Vectorised word hashing on the UTF-8 buffers of Arrow string columns.

Both word classes used here are unions of single bytes and of everything at or above
0x80, so words of the text are words of its UTF-8 bytes and no decoding is needed.
A word's hash is a polynomial hash over random byte values, read from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a longer text is one piece of its own.
CHUNK = 1 << 20
#: Bytes hashed at once.
SPAN = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(2**61, 2**63)) | 1
_INV = pow(_BASE, -1, 2**64)
_GRAM = U64(int(_rng.integers(2**61, 2**63)) | 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words as they are.
EXACT = np.arange(256, dtype=np.uint8)

#: ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[0] = 1
    return np.cumprod(out)


_pow, _inv = _powers(_BASE, SPAN + 1), _powers(_INV, SPAN + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of some texts: byte spans in ``data``, hashes, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    heads: dict[int, np.ndarray]
    tails: dict[int, np.ndarray]
    offs: np.ndarray


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def pieces(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, size: int = CHUNK, carry: int = 0, **options) -> Iterator[tuple[int, int, Words, int]]:
    """(lo, hi, words, carried): the words of rows lo to hi, of about ``size`` bytes at a time.

    A longer text comes in several pieces that are cut between words; each begins with the last
    ``carry`` words of what came before, ``carried`` of them.  ``options`` are those of :func:`words`."""
    for lo, hi in chunks(offs, size):
        at, end = int(offs[lo]), int(offs[hi])
        if end - at <= size or hi - lo > 1:
            yield lo, hi, words(data, offs[lo : hi + 1], kind, **options), 0
            continue
        start, carried = at, 0
        while at < end:
            at = min(at + size, end)
            while at < end and kind[data[at]]:
                between = np.flatnonzero(~kind[data[at : min(at + size, end)]])
                at = at + int(between[0]) if len(between) else min(at + size, end)
            w = words(data, np.array([start, at]), kind, **options)
            yield lo, hi, w, carried
            carried = min(carry, len(w.starts))
            start = start + int(w.starts[len(w.starts) - carried]) if carried else at


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, heads: tuple[int, ...] = (), tails: tuple[int, ...] = (), hashed: bool = True, lower: np.ndarray = LOWER) -> Words:
    """Words of the texts that ``offs`` bounds in ``data``, lower-cased (A-Z, by the table ``lower``)
    for hashing; none is hashed if ``hashed`` is false.

    ``heads`` and ``tails`` name byte counts; for each, the hash of that many first or
    last bytes of every word is given too (of the whole word where it is shorter).
    """
    base, end = int(offs[0]), int(offs[-1])
    data, offs = data[base:end], offs - base
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = kind[data]
    edges = inside[1:] != inside[:-1]
    for_doc = offs[(offs > 0) & (offs < len(data))]
    split = for_doc[inside[for_doc] & inside[for_doc + 1]]  # a word that runs over the end of a text
    at = np.flatnonzero(edges)
    starts, ends = at[0::2], at[1::2]
    if len(split):
        split = np.unique(split)
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    n = len(starts)
    hashes = np.empty(n, np.uint64)
    h_out, t_out = {k: np.empty(n, np.uint64) for k in heads}, {k: np.empty(n, np.uint64) for k in tails}
    i = 0 if hashed else n
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        grow = b - a > SPAN
        up, down = (_powers(_BASE, b - a + 1), _powers(_INV, b - a + 1)) if grow else (_pow, _inv)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[lower[data[a:b]]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        hashes[i:j] = mix((sums[e] - sums[s]) * down[s])
        for k, out in h_out.items():
            out[i:j] = mix((sums[np.minimum(s + k, e)] - sums[s]) * down[s])
        for k, out in t_out.items():
            from_ = np.maximum(e - k, s)
            out[i:j] = mix((sums[e] - sums[from_]) * down[from_])
        i = j
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offs), h_out, t_out, offs)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of ``n`` items from each position on that has so many."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= _GRAM
        out += hashes[k : k + m]
    return mix(out)


def whole(hashes: np.ndarray) -> int:
    """The hash of a whole sequence, unlike that of any other length."""
    return int(mix(grams(hashes, len(hashes)) + U64(0x9E3779B97F4A7C15 * len(hashes) % 2**64))[0])
