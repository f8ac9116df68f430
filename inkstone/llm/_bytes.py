"""Vectorised word work on the UTF-8 bytes of Arrow string columns: spans, 64-bit hashes, n-gram hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes that are worked on at once; a longer single text makes a block of its own.
BLOCK_BYTES = 4 << 20
#: Spans longer than this are hashed one by one.
LONG_SPAN = 4096

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)

#: Bytes of words between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters, digits and everything that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class Block:
    """Consecutive rows of a string column: `data` is their bytes, row d has data[off[d]:off[d + 1]]; nulls are empty."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first, self.rows = data, off, first, len(off) - 1

    def spans(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of member bytes that do not cross rows; and for each row the index of its first run, with the total last."""
        inside = member[self.data]
        n = len(inside)
        begins, stops = inside.copy(), inside.copy()
        edge = self.off[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        if n:
            begins[1:] &= ~inside[:-1]
            begins[edge] = inside[edge]
            stops[:-1] &= ~inside[1:]
            stops[edge - 1] = inside[edge - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines between line feeds, and for each row the index of its first line, with the total last."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.off[:-1], breaks + 1]), kind="stable")
        # an empty row has one empty line; a line after the last feed of a row starts where the next row does, so order by row
        per_row = np.searchsorted(breaks, self.off[1:]) - np.searchsorted(breaks, self.off[:-1]) + 1
        first = np.concatenate([[0], np.cumsum(per_row)])
        ends = np.empty(len(starts), np.int64)
        ends[:-1] = starts[1:] - 1
        ends[first[1:] - 1] = self.off[1:]
        return starts, ends, first

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's bytes."""
        length = ends - starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        h = mix(length.astype(np.uint64) * _M1 + _M2)
        long_ = np.flatnonzero(length > LONG_SPAN)
        live = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
        at = starts[live]
        left = length[live]
        while len(live):
            block = eights[at]
            part = left < 8
            if part.any():
                keep = (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
                block = np.where(part, block & keep, block)
            h[live] = mix((h[live] ^ block) * _M1 + _M3)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        raw = self.data.tobytes() if len(long_) else b""
        for i in long_:
            h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
        return h

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many flags are set in each row."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in blocks of whole rows of about `size` bytes."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        chunk = chunk.cast(pa.large_binary())
        if chunk.null_count:
            chunk = chunk.fill_null(b"")
        _, off, data = chunk.buffers()
        off = np.frombuffer(off, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(chunk):
            b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
            part = data[off[a] : off[b]]
            yield Block(LOWER[part] if lower else part, off[a : b + 1] - off[a], a)
            a = b


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, where first has each row's first item and the total last."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive items that do not cross rows, and the index of the first item of each."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(words) - n + 1
    h = words[:count].copy()
    for j in range(1, n):
        h = h * _M1 + words[j : j + count]
        h ^= h >> np.uint64(29)
    ok = np.ones(count, bool)
    for j in range(1, n):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < count)]] = False
    # rows without words share a boundary with the next row, which the rule above covers as well
    at = np.flatnonzero(ok)
    return mix(h[at]), at
