"""Words of Arrow text columns as numpy arrays, shared by the operators on words.

A word is a maximal run of bytes of one class. All words of a slice of rows are
found and hashed at once. Short words are gathered eight bytes at a time and mixed. For
long ones, with ``p`` a byte's place in the slice, the running sum of
``T[byte] * R**p`` modulo 2**64 gives every word's polynomial hash as a difference of
two entries, divided by ``R**start``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at a time, so that the sums stay in a core's cache.
_PIECE = 1 << 16
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
#: ``T(byte)``: the byte times the first, plus the second, its upper half mixed into the lower. Arithmetic is faster than a table.
_SPREAD, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_powers: dict[int, np.ndarray] = {}
#: Bytes of a word that is hashed eight bytes at a time, words that are at a time, and what is kept of eight bytes by length.
_SHORT, _WORDS = 32, 1 << 14
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Lower case for A-Z, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Everything but ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Digits, ASCII letters and every byte above ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True


class Words(NamedTuple):
    """Words of consecutive rows; those of row ``r`` are ``offsets[r]:offsets[r + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def bytes_of(self, first: int, last: int) -> bytes:
        """Words ``first:last`` in lower case, joined by single spaces."""
        return b" ".join(FOLD[self.data[s:e]].tobytes() for s, e in zip(self.starts[first:last], self.ends[first:last]))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the rows' offsets in them."""
    column = pc.fill_null(column, "") if column.null_count else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, places, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``limit`` text bytes at most, or of one row that is longer."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def _power(base: int, n: int) -> np.ndarray:
    """``base ** i`` for ``i < n``, modulo 2**64; kept for the next slice."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        size = max(n, _PIECE + 1)
        kept = np.full(size, base, np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if size <= 4 * _PIECE:
            _powers[base] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    values = sums[1:]
    values[:] = data
    values *= _SPREAD
    values += _SHIFT
    values ^= values >> np.uint64(32)
    values *= _power(_R, len(data))
    np.cumsum(sums, out=sums)
    return (sums[ends] - sums[starts]) * _power(_R_INVERSE, len(data) + 1)[starts]


def _chain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words of any length, by a running sum over all bytes."""
    hashes, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        origin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, origin + _PIECE, "right")))
        until = int(ends[last - 1])
        hashes[first:last] = _hash_piece(data[origin:until], starts[first:last] - origin, ends[first:last] - origin)
        first = last
    return mix(hashes)


def _hashes(padded: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every word; ``padded`` is the data and eight bytes more.

    Words of up to ``_SHORT`` bytes take eight bytes at a time, which the length and a chain of mixes tell apart.
    """
    octets = np.ndarray(len(padded) - 7, np.dtype("<u8"), padded, strides=(1,))
    hashes = np.empty(len(starts), np.uint64)
    for first in range(0, len(starts), _WORDS):
        begin, sizes = starts[first : first + _WORDS], ends[first : first + _WORDS] - starts[first : first + _WORDS]
        found = hashes[first : first + _WORDS]
        found[:] = mix((octets[begin] & _MASKS.take(sizes, mode="clip")) + sizes.astype(np.uint64) * np.uint64(_R))
        rest, done = np.flatnonzero((sizes > 8) & (sizes <= _SHORT)), 8
        while len(rest):
            more = octets[begin[rest] + done] & _MASKS.take(sizes[rest] - done, mode="clip")
            found[rest] = mix(found[rest] * _SPREAD + more)
            done += 8
            rest = rest[sizes[rest] > done]
    long = np.flatnonzero(ends - starts > _SHORT)
    if len(long):  # only their bytes are walked
        sizes = ends[long] - starts[long]
        after = np.cumsum(sizes)
        data = np.frombuffer(b"".join(padded[s:e] for s, e in zip(starts[long].tolist(), ends[long].tolist())), np.uint8)
        hashes[long] = _chain(data, after - sizes, after)
    return hashes


def words_of(column: pa.Array, is_word: np.ndarray = NON_SPACE, fold: np.ndarray = FOLD) -> Words:
    """All words of a string column; equal words (after ``fold``) have equal hashes."""
    data, rows = text_bytes(column)
    edge = np.zeros(len(data) + 2, np.int8)
    raw = data.tobytes()
    edge[1:-1] = np.frombuffer(raw.translate(is_word.tobytes()), np.int8)
    bounds = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = bounds[::2].copy(), bounds[1::2].copy()
    inner = rows[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[(edge[inner] == 1) & (edge[inner + 1] == 1)]
    if len(inner):  # one row's last word touches the next row's first
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    hashes = _hashes(raw.translate(fold.tobytes()) + bytes(8), starts, ends)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, rows, "left"))


def shingles_of(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a row, and the rows' offsets.

    A row of fewer words, but not none, is one shingle.
    """
    counts = np.diff(words.offsets)
    per_row = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    first = np.repeat(words.offsets[:-1] - offsets[:-1], per_row) + np.arange(offsets[-1])
    short = np.repeat(np.where(counts < n, counts, n), per_row)
    total = np.zeros(offsets[-1], np.uint64)
    for i in range(n):
        factor = np.uint64(pow(_R, 2 * i + 3, 1 << 64) | 1)
        inside = i < short
        total += np.where(inside, words.hashes[np.minimum(first + i, max(len(words.hashes) - 1, 0))], np.uint64(i)) * factor if offsets[-1] else total
    return mix(total), offsets
