"""Vectorised word, hash and window primitives over Arrow text batches.

Every function works on one *slice*: the concatenated UTF-8 bytes of some
documents (``buf``) and their byte offsets (``off``).  Word classes are sets of
bytes, so separators are ASCII and multi-byte characters are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Odd multipliers of the finaliser and of the two independent window lanes.
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
LANES = (
    (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)),
    (U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)),
)
_S32, _S29 = U64(32), U64(29)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], U64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def lut(separators: bytes) -> np.ndarray:
    """True for every byte that belongs to a word."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Blank-separated words.
BLANK = lut(b"\x20\x09\x0a\x0b\x0c\x0d")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values in place."""
    x ^= x >> _S32
    x *= _M1
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S32
    return x


def text_slices(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of about ``limit`` bytes, small enough for their arrays to stay in cache; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, buffers = len(column), column.buffers()
    if not n:
        return
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Word spans of one slice: byte ``start``/``end``, and ``woff``, the word range of each document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray = BLANK):
        self.buf, self.off = buf, off
        inside = table[buf]
        if not buf.size:
            self.start = self.end = np.zeros(0, np.int64)
        else:
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = off[:-1][np.diff(off) > 0]  # a word ends where its document ends
            first[edge] = inside[edge]
            tail = off[1:][np.diff(off) > 0] - 1
            last[tail] = inside[tail]
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.woff = np.searchsorted(self.start, off)
        self.count = np.diff(self.woff)

    def only(self, rows: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
        """The words of some documents, whose bytes are ``buf`` now, and where they are among these."""
        out, count = object.__new__(Words), self.count[rows]
        out.buf, out.off, out.count = buf, off, count
        out.woff = np.concatenate([[0], np.cumsum(count)])
        places = np.arange(out.woff[-1]) + np.repeat(self.woff[rows] - out.woff[:-1], count)
        shift = np.repeat(self.off[rows] - off[:-1], count)
        out.start, out.end = self.start[places] - shift, self.end[places] - shift
        return out, places

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)

    def valid(self, k: int) -> np.ndarray:
        """True where ``k`` words of one document start; one value a word."""
        if not self.start.size:
            return np.zeros(0, bool)
        return np.repeat(self.woff[1:], self.count) - np.arange(len(self.start)) >= k


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight bytes a step, all spans at once."""
    size = end - start
    if not size.size:
        return np.zeros(0, U64)
    raw = np.concatenate([buf, np.zeros(8, np.uint8)])
    at = np.ndarray((buf.size + 1,), "<u8", raw, strides=(1,))
    h = at[start] & _MASK[np.minimum(size, 8)]
    h ^= size.astype(U64) * LANES[0][0]
    mix(h)
    some = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    pos, left = start[some] + 8, size[some] - 8
    while some.size:
        part = at[pos] & _MASK[np.minimum(left, 8)]
        h[some] = mix(h[some] * LANES[0][1] ^ part)
        go = left > 8
        some, pos, left = some[go], pos[go] + 8, left[go] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes())
    return h


def windows(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of the ``k`` values from each position, by doubling; windows past the end hold filler."""
    a, b, c = LANES[lane]

    def pair(x: np.ndarray, gap: int) -> np.ndarray:
        out = x * a
        out[: x.size - gap] ^= (x[gap:] + c) * b if gap else (x + c) * b
        out ^= out >> _S32
        out *= c
        out ^= out >> _S29
        return out

    length, out = 1, h * a if k > 1 else mix(h * a)
    while length * 2 <= k:
        out, length = pair(out, min(length, out.size)), length * 2
    return pair(out, min(k - length, out.size)) if length < k else out


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask, bitorder="little").tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n, bitorder="little").astype(bool)


def covered(hit: np.ndarray, k: int) -> np.ndarray:
    """True at each position that one of the marked windows of ``k`` covers."""
    n = hit.size
    mark = np.zeros(n + k + 1, np.int32)
    at = np.flatnonzero(hit)
    mark[at] += 1
    mark[at + k] -= 1
    return np.cumsum(mark)[:n] > 0
