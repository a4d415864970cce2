"""Vectorised views of a block of texts.

Spark hands a task its rows as Arrow batches.  The helpers here look at the UTF-8
bytes of many texts at once: word boundaries, polynomial hashes of words and of
windows, and sliding minima, each a handful of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A block is cut when it holds this many bytes; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20

#: The separators are U+0020 and U+0009 to U+000D; everything else belongs to words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Every ASCII character that is neither letter nor digit.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers of the polynomial hashes; all arithmetic is modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if size > BLOCK_BYTES:
            return made[0], made[1]
        _POWERS[base] = have = (made[0], made[1])
    return have


class Prefix:
    """Hashes of any range of a sequence of integers from one cumulative sum."""

    def __init__(self, values: np.ndarray, base: int):
        self.power, self.inverse = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array and len+1 offsets into it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of half-open ranges, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def parts_of(raw: np.ndarray, separators: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of parts of a text of about `most` bytes that end at a separator, or where the next one stands."""
    a = 0
    while a < len(raw):
        b = min(a + most, len(raw))
        while b < len(raw) and len(gap := np.flatnonzero(separators[raw[b : b + most]])) == 0:
            b = min(b + most, len(raw))
        b += int(gap[0]) if b < len(raw) else 0
        yield a, b
        a = b


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """One 64-bit hash for each of the disjoint ascending byte ranges, from bytes and length; a block at a time, so memory stays bounded."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + BLOCK_BYTES, "right")))
        a, b = int(starts[k]), int(ends[last - 1])
        if last == k + 1 and b - a > BLOCK_BYTES:
            value = 0
            for x in range(b, a, -BLOCK_BYTES):
                part = raw[max(a, x - BLOCK_BYTES) : x].astype(np.uint64) + np.uint64(1)
                value = (value * pow(base, len(part), 1 << 64) + int(Prefix(part, base).sums[-1])) % (1 << 64)
            out[k] = value
        else:
            out[k:last] = Prefix(raw[a:b].astype(np.uint64) + np.uint64(1), base).ranges(starts[k:last] - a, ends[k:last] - a)
        k = last
    return mix(out + (ends - starts).astype(np.uint64))


class Words:
    """The words of a block of texts: byte ranges, and the first word of each text."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACE):
        self.raw, self.at = raw, at
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~separators[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        here, before = inside[1:], inside[:-1]
        self.starts = np.flatnonzero(here & (~before | edge))
        self.ends = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.starts, at)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        """One 64-bit hash for each word, from its bytes and its length."""
        return range_hashes(self.raw, self.starts, self.ends, base)


def room(first: np.ndarray, length: int) -> np.ndarray:
    """For each position of a block, whether `length` positions from there stay in one text."""
    n = int(first[-1])
    ok = np.zeros(n, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    np.greater_equal(left, length, out=ok)
    return ok


def sliding(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each `width` consecutive values; len(x) - width + 1 results."""
    if len(x) < width:
        return x[:0]
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def merge_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as sorted disjoint ranges; ranges that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], reach[last]
