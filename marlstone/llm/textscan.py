"""Vectorised scanning of Arrow string batches: words, hashes and n-grams without a Python object a word.

An Arrow string array is one byte buffer and one offset buffer. All functions work on numpy views of those, in
pieces of bounded size, so memory does not follow the length of a batch.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes hashed at a time.
BLOCK = 1 << 17
#: Words above this many bytes are hashed by BLAKE2 instead.
LONG_WORD = 1 << 14
STEP = U(0xD6E8FEB86659FD93)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

#: Byte classes. SPACE: the six separators of words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters: ASCII letters and every byte of a multi-byte character.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
#: ASCII lower-casing.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts(NamedTuple):
    """Text of some rows: bytes, and where each row begins (one more entry than rows)."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Where words begin and end in the bytes, and the first word of each row (one more entry than rows)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche."""
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Views of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Each batch in slices: what a stage that passes texts on builds and sends back at a time is small, whatever the batches."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def pieces(t: Texts, most: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole rows with about ``most`` bytes (a longer row alone): first row, end row, their text."""
    n, at = len(t.offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(t.offsets, t.offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, Texts(t.data[t.offsets[at] : t.offsets[to]], t.offsets[at : to + 1] - t.offsets[at])
        at = to


def runs(t: Texts, inside: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``inside`` holds, not across rows."""
    data, offsets = t
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(offsets), np.int64))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def words(t: Texts) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``; the separators are ASCII, so bytes do for UTF-8."""
    return runs(t, ~SPACE[t.data])


def class_runs(t: Texts) -> Words:
    """Tokens of one kind of byte each: letters, digits or other signs; space separates."""
    data, offsets = t
    if not len(data):
        return runs(t, np.zeros(0, bool))
    kind = np.full(256, 3, np.uint8)
    kind[LETTER], kind[DIGIT], kind[SPACE] = 1, 2, 0
    k = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    turn = np.empty(len(data) + 1, bool)
    turn[0] = turn[-1] = True
    turn[1:-1] = (k[1:] != k[:-1]) | edge[1:-1]
    starts = np.flatnonzero(turn[:-1] & (k != 0))
    ends = np.flatnonzero(turn[1:] & (k != 0)) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


@functools.cache
def _multipliers(family: int) -> np.ndarray:
    """A random 64-bit number for each place in a word; families are independent of each other."""
    return np.random.default_rng([0x6D61726C, family]).integers(0, 1 << 64, LONG_WORD + 1, dtype=U)


def hash_words(data: np.ndarray, w: Words, family: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes; equal words hash alike everywhere.

    Multilinear: the sum of each byte times a random number for its place, modulo 2**64. Of two words that differ, the
    sums agree with probability 2**-57 at most over the draw of the numbers, whatever the words (a polynomial modulo
    2**64 has fixed pairs that always agree). ``family`` picks other numbers: hashes of two families are independent.
    """
    starts, ends = w.starts, w.ends
    out = np.empty(len(starts), U)
    times = _multipliers(family)
    at = 0
    while at < len(starts):
        s0 = starts[at]
        if ends[at] - s0 > LONG_WORD:
            out[at] = int.from_bytes(hashlib.blake2b(data[s0 : ends[at]].tobytes(), digest_size=8, salt=bytes([family])).digest(), "little")
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(starts, s0 + BLOCK, side="left")))
        if (big := np.flatnonzero(ends[at:to] - starts[at:to] > LONG_WORD)).size:
            to = at + int(big[0])
        e1 = ends[to - 1]
        a, b = starts[at:to] - s0, ends[at:to] - s0
        place = np.arange(e1 - s0)
        place -= np.repeat(a, np.diff(np.r_[a, e1 - s0]))
        piece = data[s0:e1].astype(U)
        piece += U(1)
        piece *= times[np.minimum(place, LONG_WORD, out=place)]  # places of separators are not summed
        sums = np.zeros(len(piece) + 1, U)
        np.cumsum(piece, out=sums[1:])
        out[at:to] = mix(sums[b] - sums[a] + (b - a).astype(U) * STEP)
        at = to
    return out


def gram_hash(h: np.ndarray, n: int, step: np.uint64 = STEP) -> np.ndarray:
    """Hash of each n consecutive entries, by doubling: log2(n) passes. ``step`` (odd) picks the polynomial."""
    if len(h) < n:
        return np.zeros(0, U)
    out, have, power, wide = None, 0, h, 1
    with np.errstate(over="ignore"):
        while True:
            if n & wide:
                if out is None:
                    out, have = power, wide
                else:
                    m = len(h) - have - wide + 1
                    out = out[:m] * step + power[have : have + m]
                    have += wide
            if 2 * wide > n:
                return mix(out)
            m = len(power) - wide
            power = power[:m] * step + power[wide:]
            step = step * step
            wide *= 2


def whole(w: Words, n: int) -> np.ndarray:
    """For each n consecutive words: do they lie in one row?"""
    rows = w.rows()
    return rows[: len(rows) - n + 1] == rows[n - 1 :] if len(rows) >= n else np.zeros(0, bool)
