"""Hashes of words and of runs of words, for whole blocks of texts at once (numpy, no loop over words).

A block is the bytes of some texts one after the other. Words are what ASCII white space separates.
A word's hash has 128 bits in two lanes. Its bytes are taken eight at a time; each lane adds them to its state and
mixes the state by a bijection of its own, and the word's length comes last; words of more than CHAINED bytes
have their BLAKE2b. So words of up to eight bytes never share a lane with others of their length, and no pattern of bytes,
however long, makes two words meet but by chance (2**-128 a pair). The hash of a run of words is a polynomial in
its words' hashes, from running sums, so that every run costs the same; a lane each makes a fingerprint of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers of the polynomials, one for each lane.
WORDS, WORDS2 = 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Bytes up to which a word is hashed in steps of eight; for each number of bytes the bits that hold them.
CHAINED = 64
HELD = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        have = made[0], made[1]
        if size <= 3 << 19:
            _powers[base] = have
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of stretches of rows with about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in the bytes, and for each text the number of words before it (one entry more than texts)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = separator[data]
    cut = np.empty(n + 1, bool)  # a word can't run over these places
    cut[0] = cut[n] = True
    np.not_equal(gap[1:], gap[:-1], out=cut[1:n])
    cut[offsets[(offsets > 0) & (offsets < n)]] = True
    places = np.flatnonzero(cut)
    inside = ~gap[places[:-1]]
    starts, ends = places[:-1][inside], places[1:][inside]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two rows of 64 bits: the lanes of each word's hash."""
    length = ends - starts
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    lanes = np.zeros((2, len(starts)), U)
    left = np.flatnonzero(length <= CHAINED)
    for at in range(0, CHAINED, 8):
        left = left[length[left] > at]
        if not len(left):
            break
        x = eights[starts[left] + at] & HELD[np.minimum(length[left] - at, 8)]
        for k in (0, 1):
            lanes[k, left] = mix(lanes[k, left] + x, 61 + k)
    for k in (0, 1):
        lanes[k] = mix(lanes[k] + length.astype(U), 63 + k)
    for i in np.flatnonzero(length > CHAINED).tolist():
        lanes[:, i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), U)
    return lanes


def run_hashes(hashes: np.ndarray, n: int, base: int = WORDS) -> np.ndarray:
    """The hash of each run of n words by its first word (of all words of the block, over texts' ends too), from one lane."""
    if len(hashes) < n:
        return np.zeros(0, U)
    pw, inverse = powers(base, len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, U)
    sums[0] = 0
    np.cumsum(hashes * pw[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse[: len(hashes) - n + 1], n)


def runs_inside(word_offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each word: whether a run of n words from it stays within its text."""
    left = np.repeat(word_offsets[1:], np.diff(word_offsets)) - np.arange(total)
    return left >= n


def sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over each `width` neighbours, by doubling."""
    if len(a) < width:
        return a[:0]
    done = 1
    while done * 2 <= width:
        a = op(a[:-done], a[done:])
        done *= 2
    return op(a[: len(a) - (width - done)], a[width - done :]) if width > done else a
