"""Induced suffix sorting with common-prefix values, by queues that wait on disk.

A suffix is induced from the one after it: scanning the sorted suffixes upwards, the
predecessor of each, where its symbol is larger (type L), is the next of that symbol; scanning
downwards the same holds where it is smaller (type S).  Induced suffixes therefore arrive at each symbol in
sorted order, so the priority queue of (symbol, rank) tuples is one queue for each symbol,
appended to and read in order; queues beyond a budget wait on disk, and so do the L suffixes between the two scans.
Two neighbours in a queue share one symbol more than their inducers, whose common prefix is the
least value between them; so common-prefix values travel with the tuples.

A run of one symbol induces itself again and again.  Its suffixes are written down at once: where a symbol repeats
k times before what follows, the suffixes with j repetitions stand together, in the order of what follows, for j = 0, 1, ..., k.

The leftmost S suffixes that start the induction (local minima of the text) are named by their substrings; where names
repeat, the string of names is sorted in the same way, by recursion.  There a suffix is
induced from its symbols up to the next leftmost S suffix and from that one's rank, as there are too many
symbols for a queue each.

Suffixes are ordered by their first `cap` symbols; what agrees on these comes in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries (five bytes each) that the queues of one sort keep in memory.
QUEUED = 1 << 20
#: Suffixes that one step of a scan looks at.
STEP = 1 << 16


class Queues:
    """A queue of (position, common prefix) arrays for each symbol; the longest go to disk when all exceed the budget."""

    def __init__(self, symbols: int, budget: int):
        self.parts: list[list] = [[] for _ in range(symbols)]  # arrays, or the name of a file that holds some
        self.size, self.held, self.budget = np.zeros(symbols, np.int64), 0, budget
        self.folder: tempfile.TemporaryDirectory | None = None
        self.spilled = 0

    def push(self, symbol: int, at: np.ndarray, prefix: np.ndarray) -> None:
        self.parts[symbol].append((at, prefix))
        self.size[symbol] += len(at)
        self.held += len(at)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="queues-", dir=local or None)
        while self.held > self.budget // 2:
            symbol = int(np.argmax(self.size))
            loose = [p for p in self.parts[symbol] if isinstance(p, tuple)]
            name = os.path.join(self.folder.name, str(self.spilled))
            np.save(f"{name}-at.npy", np.concatenate([a for a, _ in loose]))
            np.save(f"{name}-prefix.npy", np.concatenate([p for _, p in loose]))
            self.parts[symbol] = [*(p for p in self.parts[symbol] if not isinstance(p, tuple)), name]
            self.held -= int(self.size[symbol])
            self.size[symbol], self.spilled = 0, self.spilled + 1

    def pop(self, symbol: int, newest_first: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take everything out of a queue, in the order in which it came or the other way round."""
        parts, self.parts[symbol] = self.parts[symbol], []
        self.held -= int(self.size[symbol])
        self.size[symbol] = 0
        while parts:
            part = parts.pop(-1 if newest_first else 0)
            if isinstance(part, str):
                names = [f"{part}-at.npy", f"{part}-prefix.npy"]
                part = tuple(np.load(n) for n in names)
                for n in names:
                    os.unlink(n)
            yield part

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


def least_between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of x[lo..hi], both included, by a sparse table."""
    if not len(lo):
        return x[:0]
    level = np.frexp((hi - lo + 1).astype(np.float32))[1] - 1
    out, table = np.empty(len(lo), x.dtype), x
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << k) + 1])
    return out


def local_minima(text: np.ndarray) -> np.ndarray:
    """Positions of the leftmost S suffixes: smaller than the symbol before, and than the next one that differs; every 0 but the first is one."""
    start = np.append(0, np.flatnonzero(text[1:] != text[:-1]) + 1)
    symbol = text[start]
    low = np.zeros(len(start), bool)
    low[1:-1] = (symbol[1:-1] < symbol[:-2]) & (symbol[1:-1] < symbol[2:])
    low[-1] = True  # the last 0
    return start[low]


def names_of(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranks of the substrings text[start : start + size] among each other, equal ones the same.

    A substring that others continue comes after these: it ends in a leftmost S suffix, they go on with an L suffix.
    Several symbols are compared at a time, and after the first time only substrings whose name others share.
    """
    each = 8 // text.itemsize
    padded = np.append(text, np.zeros(each, text.dtype))
    bits = 8 * text.itemsize
    every = np.uint64(0xFFFFFFFFFFFFFFFF)

    def word(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.uint64)
        for k in range(each):
            value = (value << np.uint64(bits)) | padded[np.minimum(at + k, len(padded) - 1)].astype(np.uint64)
        gap = (bits * np.clip(each - left, 0, each)).astype(np.uint64)
        return np.where(left <= 0, every, value | ~(every << np.minimum(gap, np.uint64(63))) | (gap >> np.uint64(6)))

    _, name = np.unique(word(start, size), return_inverse=True)
    name = name.astype(np.int64)
    done, most = each, int(size.max()) if len(size) else 0
    while done < most:
        longer = np.zeros(int(name.max()) + 1, bool)
        longer[name[size > done]] = True
        shared = np.bincount(name) > 1
        own = np.flatnonzero((longer & shared)[name])
        if not len(own):
            break
        key = word(start[own] + done, size[own] - done)
        keys, key = np.unique(key, return_inverse=True)
        order = np.argsort(name[own] * len(keys) + key)
        own, key = own[order], key[order]
        old = name[own]
        step = np.zeros(len(own), np.int64)
        step[1:] = (old[1:] == old[:-1]) & (key[1:] != key[:-1])
        more = np.cumsum(step)
        # Each name is followed by as many new ones as its substrings need.
        extra = np.bincount(old, step, minlength=len(longer)).astype(np.int64)
        shift = np.cumsum(extra) - extra
        name += shift[name]
        name[own] += more - shift[old]
        done += each
    return name


def sorted_minima(text: np.ndarray, cap: int) -> np.ndarray:
    """The positions of the leftmost S suffixes in order, those that start with 0 (by position) first."""
    low = local_minima(text)
    ends = text[low] == 0
    inner = np.flatnonzero(~ends)
    size = np.minimum(low[np.minimum(inner + 1, len(low) - 1)] - low[inner] + 1, cap + 8)
    name = names_of(text, low[inner], size) + 1
    if not len(name) or name.max() == len(name):
        return np.concatenate([low[ends], low[inner[np.argsort(name)]]])
    reduced = np.zeros(len(low) + 1, np.int32)
    reduced[inner + 1] = name
    order = sorted_names(reduced, cap // 2 + 2)
    return np.concatenate([low[ends], low[order - 1]])


def sorted_names(text: np.ndarray, cap: int) -> np.ndarray:
    """The positions of a string of names (the first symbol and every last one of a string is 0) that do not hold 0, in order."""
    low = local_minima(text)
    rank = np.zeros(len(text), np.int64)
    rank[sorted_minima(text, cap)] = np.arange(len(low))
    at = np.flatnonzero(text)
    following = low[np.searchsorted(low, at, "right")]
    name = names_of(text, at, np.minimum(following - at + 1, cap + 8))
    return at[np.argsort(name * len(low) + rank[following])]


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each position with the one before in order, up to the cap; no 0 equals another."""
    out = np.zeros(len(order), np.uint8)
    each, bits = 8 // text.itemsize, np.uint64(8 * text.itemsize)
    padded = np.append(text, np.zeros(cap + 2 * each, text.dtype))
    words = np.lib.stride_tricks.as_strided(padded[:each].view(np.uint64), (len(text) + cap,), (text.itemsize,))
    ones = np.uint64(sum(1 << i for i in range(0, 64, int(bits))))
    tops = ones << (bits - np.uint64(1))
    for i in range(1, len(order), STEP):
        a, b = order[i - 1 : i - 1 + STEP][: len(order) - i], order[i : i + STEP]
        shared, open_, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(open_) and done < cap:
            x = words[a[open_] + done]
            # A bit of the first symbol that differs, or the top bit of the first 0, is the lowest that is set.
            stop = (x ^ words[b[open_] + done]) | ((x - ones) & ~x & tops)
            shared[open_] += (np.bitwise_count((stop & (~stop + np.uint64(1))) - np.uint64(1)) // bits).astype(np.int64)
            open_, done = open_[stop == 0], done + each
        out[i : i + STEP] = np.minimum(shared, cap)
    return out


class Induction:
    """Sorts the suffixes of `text`: symbols from 0 below `symbols`, a 0 before the first string and after each; no 0 equals another."""

    def __init__(self, text: np.ndarray, symbols: int, cap: int, budget: int = QUEUED):
        self.text, self.symbols, self.cap, self.budget = text, symbols, cap, budget
        self.spilled = 0
        again = np.zeros(len(text) + 1, bool)
        again[1:-1] = text[1:] == text[:-1]
        self.begin = np.flatnonzero(again[1:] & ~again[:-1])  # where the runs of two and more begin

    def run(self, at: int) -> int:
        """How often the symbol at a position repeats from there, up to the cap."""
        part = self.text[at : at + self.cap]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def _repeated(self, symbol: int, at: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The seeds of a symbol, and after them what the symbol induces before itself, in order."""
        yield at, prefix
        more = np.flatnonzero(self.text[at - 1] == symbol)
        if not len(more):
            return
        before = at[more] - self.begin[np.searchsorted(self.begin, at[more], "right") - 1]
        own, level = np.arange(len(at)), 0
        least, left = prefix.astype(np.int64), np.zeros(len(at), np.int64)
        left[more] = before
        while True:
            keep = np.flatnonzero(left[own] > level)
            if not len(keep):
                return
            least = np.minimum.reduceat(least[: keep[-1] + 1], np.append(0, keep[:-1] + 1))
            own = own[keep]
            # All of these go on at least so far; so many levels have the same members.
            last = int(left[own].min())
            rows = max(1, STEP // len(own))
            while level < last:
                k = np.arange(level + 1, min(last, level + rows) + 1)
                shared = np.minimum(least[None, :] + k[:, None], self.cap)
                shared[:, 0] = np.minimum(k, self.cap)
                yield (at[own][None, :] - k[:, None]).astype(at.dtype).ravel(), shared.astype(np.uint8).ravel()
                level = int(k[-1])

    def _step(self, symbol: int, at: np.ndarray, prefix: np.ndarray, small: bool, queues: Queues, since: np.ndarray, filled: np.ndarray) -> None:
        """Induce the predecessors of one block of sorted suffixes of a symbol."""
        before = self.text[at - 1]
        ok = np.flatnonzero((before < symbol) & (before > 0) if small else before > symbol)
        least = int(prefix.min()) if len(prefix) else 255
        if not len(ok):
            np.minimum(since, least, out=since)
            return
        names_at = before[ok]
        order = np.argsort(names_at, kind="stable")
        ok, names_at = ok[order], names_at[order]
        first = np.flatnonzero(np.append(True, names_at[1:] != names_at[:-1]))
        last = np.append(first[1:], len(ok)) - 1
        shared = np.empty(len(ok), np.int64)
        later = np.ones(len(ok), bool)
        later[first] = False
        later = np.flatnonzero(later)
        shared[later] = least_between(prefix, ok[later - 1] + 1, ok[later])
        names = names_at[first].astype(np.int64)
        shared[first] = np.minimum(since[names], np.minimum.accumulate(prefix)[ok[first]])
        shared += 1
        shared[first[~filled[names]]] = 0
        rest = np.append(np.minimum.accumulate(prefix[::-1])[::-1], 255)
        np.minimum(since, least, out=since)
        since[names] = rest[ok[last] + 1]
        filled[names] = True
        shared = np.minimum(shared, self.cap).astype(np.uint8)
        found = at[ok] - 1
        for name, a, b in zip(names.tolist(), first.tolist(), (last + 1).tolist(), strict=True):
            queues.push(name, found[a:b], shared[a:b])

    def _scan(self, symbol: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]], *state) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Induce from the blocks of a symbol, STEP suffixes at a time, and hand them on."""
        for at, prefix in blocks:
            for i in range(0, len(at), STEP):
                self._step(symbol, at[i : i + STEP], prefix[i : i + STEP], *state)
            yield at, prefix

    def _seeds(self, queues: Queues, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        got = list(zip(*queues.pop(symbol), strict=True))
        if got:
            yield from self._repeated(symbol, *map(np.concatenate, got))

    def sort(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each symbol from the largest down its suffixes in order, with their common prefix (up to the cap) with the one before."""
        start = sorted_minima(self.text, self.cap).astype(np.int32)
        prefix = common_prefixes(self.text, start, self.cap)
        bounds = np.searchsorted(self.text[start], np.arange(self.symbols + 1))
        new = lambda: (Queues(self.symbols, self.budget), np.full(self.symbols, 255, np.int64), np.zeros(self.symbols, bool))
        large = Queues(self.symbols, self.budget)  # the L suffixes, kept for the way down
        queues, *state = new()
        for symbol in range(self.symbols):
            last = None
            for at, shared in self._scan(symbol, self._seeds(queues, symbol), False, queues, *state):
                large.push(symbol, at, shared)
                last = int(at[-1])
            at, shared = start[bounds[symbol] : bounds[symbol + 1]], prefix[bounds[symbol] : bounds[symbol + 1]].copy()
            if len(at):
                shared[0] = 0 if last is None else min(self.run(last), self.run(int(at[0])), self.cap)
                for _ in self._scan(symbol, iter([(at, shared)]), False, queues, *state):
                    pass
        queues.close()
        self.spilled += queues.spilled + large.spilled
        del start, prefix
        queues, *state = new()
        for symbol in range(self.symbols - 1, 0, -1):
            up = list(self._scan(symbol, self._seeds(queues, symbol), True, queues, *state))
            high = [np.concatenate(x)[::-1] for x in zip(*up, strict=True)] if up else None
            low = [np.concatenate(x) for x in zip(*large.pop(symbol), strict=True)] if large.parts[symbol] else None
            del up
            # The largest L suffix and the smallest S suffix of a symbol share its repetitions.
            between = min(self.run(int(high[0][0])), self.run(int(low[0][-1])), self.cap) if high and low else 0
            if low:
                down = np.append(np.uint8(between), low[1][:0:-1])
                for _ in self._scan(symbol, iter([(low[0][::-1], down)]), True, queues, *state):
                    pass
            if high:
                high[1] = np.append(np.uint8(between), high[1][:-1])
            both = [x for x in (low, high) if x]
            if both:
                yield tuple(np.concatenate(x) for x in zip(*both, strict=True))
        queues.close()
        large.close()
        self.spilled += queues.spilled


def text_of(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strings laid end to end (bytes, and where each ends) as symbols from 1, with 0 before the first and after each."""
    wide = np.uint16 if len(raw) and raw.max() == 255 else np.uint8
    text = np.zeros(len(raw) + len(ends) + 1, wide)
    keep = np.ones(len(text), bool)
    keep[0] = False
    keep[ends + np.arange(len(ends)) + 1] = False
    text[keep] = raw.astype(wide) + wide(1)
    return text


def sort_strings(raw: np.ndarray, ends: np.ndarray, cap: int, budget: int = QUEUED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sort the suffixes of strings (see text_of): for each symbol from the largest down, positions in the text and
    common prefixes up to the cap (at most 250)."""
    text = text_of(raw, ends)
    yield from Induction(text, int(text.max()) + 1, cap, budget).sort()
