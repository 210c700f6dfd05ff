"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of an Arrow string column, in chunks of a
bounded number of bytes, so memory follows the chunk and the longest single
text rather than the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.shared import small_batches

#: Bytes of text handled by one round of array operations.
CHUNK_BYTES = 1 << 19

U64 = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts; a text over max_bytes comes alone."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte and at the end as one little-endian word; bytes past the end are 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for arrays of positions: words of eight bytes, each mixed with its place.

    Nothing is linear in the bytes, so no family of texts collides by its form.
    """
    size = end - start
    words8 = loads(data)
    first = mix((words8[start] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] - 1) // 8
        of = np.repeat(np.arange(len(long)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + 1
        at = start[long][of] + 8 * k
        word = words8[at] & _LOW_BYTES[np.minimum(end[long][of] - at, 8)]
        word = mix(mix(word + U64(0x2545F4914F6CDD1D)) + k.astype(U64) * U64(0xD1342543DE82EF95))
        first[long] = mix(first[long] + np.add.reduceat(word, np.cumsum(n) - n))
    return first


def gram_hashes(data: np.ndarray, length: int = 16) -> np.ndarray:
    """A number by the `length` (8 to 16) bytes from each byte that has so many; for choosing places, not for telling strings apart."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    words8 = loads(data)
    h = words8[:n] * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h += words8[length - 8 : length - 8 + n]
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    h *= U64(0x94D049BB133111EB)
    return h


PRIME = U64((1 << 61) - 1)
_M30, _M31, _S1, _S30, _S31, _S61 = U64((1 << 30) - 1), U64((1 << 31) - 1), U64(1), U64(30), U64(31), U64(61)


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> _S61)
    return np.where(x >= PRIME, x - PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME of numbers below it."""
    ah, al, bh, bl = a >> _S31, a & _M31, b >> _S31, b & _M31
    mid = ah * bl + al * bh
    return _folded((ah * bh << _S1) + (mid >> _S30) + ((mid & _M30) << _S31) + al * bl)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, _times(out, np.full(len(out), U64(pow(base, len(out), int(PRIME)))))])
    return out[:n]


class PrefixHash:
    """The hash of any substring of a buffer in a few steps: polynomials modulo the prime 2**61 - 1.

    A substring's value doesn't depend on where it starts, and its length goes
    into the final mix. Two different strings of up to n bytes have equal values
    for at most n of the 2**61 bases. Powers are kept for a block of bytes and
    for whole blocks, sums of a letter's two halves for each byte.
    """

    SPAN = 1024
    _base = int(_stream(7924, 1)[0]) % int(PRIME)
    _inverse = pow(_base, -1, int(PRIME))
    _table: np.ndarray | None = None

    def __init__(self, data: np.ndarray):
        own = PrefixHash
        if own._table is None:
            own._in, own._out = _powers(own._base, own.SPAN), _powers(own._inverse, own.SPAN)
            letters = _stream(31337, 256) % PRIME
            own._table = _times(np.tile(letters, own.SPAN), np.repeat(own._in, 256))
        n = len(data)
        place = np.tile(np.arange(self.SPAN, dtype=np.uint32) << np.uint32(8), n // self.SPAN + 1)[:n]
        place |= data
        value = own._table.take(place)
        self.low, self.high = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
        np.bitwise_and(value, _M31, out=self.low[1:])
        np.cumsum(self.low[1:], out=self.low[1:])
        value >>= _S31
        np.cumsum(value, out=self.high[1:])
        blocks = n // self.SPAN + 1
        self.turn, self.back = (_powers(pow(b, self.SPAN, int(PRIME)), blocks) for b in (own._base, own._inverse))
        edge = np.minimum(np.arange(blocks + 1) * self.SPAN, n)
        whole = _times(self.turn, self._inside(edge[1:], edge[:-1]))
        self.before = np.zeros(blocks + 1, U64)
        low, high = (np.cumsum(x, dtype=U64) for x in (whole & _M31, whole >> _S31))
        self.before[1:] = _halves(low, high)

    def _inside(self, at: np.ndarray, edge: np.ndarray) -> np.ndarray:
        return _halves(self.low[at] - self.low[edge], self.high[at] - self.high[edge])

    def _sum(self, at: np.ndarray) -> np.ndarray:
        block = at // self.SPAN
        return _folded(self.before[block] + _times(self.turn[block], self._inside(at, block * self.SPAN)))

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for arrays of positions."""
        value = _folded(self._sum(end) + PRIME - self._sum(start))
        value = _times(_times(value, self.back[start // self.SPAN]), PrefixHash._out[start % self.SPAN])
        return mix(value + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def _halves(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low + high * 2**31 modulo PRIME, of sums below 2**52."""
    return _folded((high >> _S30) + ((high & _M30) << _S31) + low)


def runs_of(black: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; none crosses a text's end."""
    if not len(black):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = offsets[(offsets > 0) & (offsets < len(black))]
    before = np.empty(len(black), bool)
    before[0] = False
    before[1:] = black[:-1]
    before[cut] = False
    after = np.empty(len(black), bool)
    after[-1] = False
    after[:-1] = black[1:]
    after[cut - 1] = False
    return np.flatnonzero(black & ~before), np.flatnonzero(black & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than x20 and x09 to x0D."""
    return runs_of(~_WHITE[data], offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the n + 1 places where each text's words begin among them."""
    data = lowered(data) if lower else data
    start, end = words(data, offsets)
    return slice_hashes(data, start, end), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, and the n + 1 places where each set begins.

    A text with fewer words than a shingle has the whole sequence as its one
    shingle; a text without words has none.
    """
    hashed, first = word_hashes(data, offsets)
    n = len(first) - 1
    keys = _stream(length * 1013, length)
    count = np.diff(first)
    size = np.where(count >= length, count - length + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(begin[-1], U64)
    if len(hashed) >= length:
        m = len(hashed) - length + 1
        grams = np.zeros(m, U64)
        for j in range(length):
            grams += hashed[j : j + m] * keys[j]
        grams = mix(grams)
        owner = np.repeat(np.arange(n), np.where(count >= length, size, 0))
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(np.where(count >= length, size, 0)) - np.where(count >= length, size, 0), np.where(count >= length, size, 0))
        out[begin[owner] + inside] = grams[first[owner] + inside]
    for d in np.flatnonzero((count > 0) & (count < length)):
        own = hashed[first[d] : first[d + 1]]
        out[begin[d]] = mix(np.array([(own * keys[: len(own)]).sum(dtype=U64) + U64(len(own))], U64))[0]
    for d in np.flatnonzero(size > 1):
        out[begin[d] : begin[d + 1]].sort()
    if not len(out):
        return out, begin
    fresh = np.empty(len(out), bool)
    fresh[0] = True
    fresh[1:] = out[1:] != out[:-1]
    fresh[begin[:-1][size > 0]] = True
    place = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], place[begin]


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and after a task's last batch the worker gives free memory back: workers stay idle beside those of the next stage."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def mapped(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """frame.mapInArrow of a released run, by batches of few bytes."""
    small_batches(frame.sparkSession)
    return frame.mapInArrow(released(run), schema)
