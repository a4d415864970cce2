"""Benchmark decontamination by SimHash.

Windows of as many words as an item are fingerprinted, and a multi-index over four blocks
of the 64 bits finds every item within the Hamming radius: two fingerprints that differ
in at most 4 * r + 3 bits differ in at most r bits of some block, so each item is filed
under all values within r bits of each of its blocks.  Weighted word shingles then decide
exactly.  Only windows that could pass are fingerprinted: similarity s asks that at least
2s / (1 + s) of a window's shingles occur in some item.  As fingerprints are of words and not
of shingles, some similar windows lie outside the radius; so each such window is also
compared with every item that it shares that many shingles with, and none is lost.
"""

from __future__ import annotations

import uuid
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import document_columns, lean_batches, saved
from .textblock import BASES, LOWER, Prefix, Words, blocks, mix, text_bytes

RADIUS, BLOCKS = 16, 4
#: Items of one broadcast.  A larger benchmark is dealt into groups, and only texts that share enough shingles with an item go on to its group.
ITEMS_AT_ONCE = 1000
#: Groups whose index one worker keeps.
KEPT = 4
#: Windows that are fingerprinted together, in words; shingles of all items that are broadcast.
STRETCH, BROADCAST_SHINGLES = 1 << 14, 1 << 23
_NEAR = np.array([sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(64 // BLOCKS), r)], np.int64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    return mix(Prefix(words, BASES[1]).windows(size) + np.uint64(size))


def fingerprints(words: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the windows of `length` words at `starts`: for each bit, whether most words have it."""
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum(2 * bits - 1, axis=0, out=sums[1:])
    return np.packbits(sums[starts + length] - sums[starts] > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Items:
    """The items of one broadcast, with their index; made once in each Python worker (see made())."""

    def __init__(self, ids: list[int], texts: list[str], size: int):
        raw, at = text_bytes(pa.array(texts, pa.string()))
        words = Words(LOWER[raw], at)
        hashes = words.hashes()
        self.ids, self.words, self.size = ids, [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)], size
        self.by_length: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                self.by_length.setdefault(len(w), []).append(k)
        self.shingles = [Counter(shingle_hashes(w, min(size, len(w))).tolist()) if len(w) else Counter() for w in self.words]
        every = np.unique(np.array([x for c in self.shingles for x in c] or [0], np.uint64))
        self.known, self.filter = every, np.zeros(1 << 20, bool)
        self.filter[(every >> np.uint64(44)).astype(np.int64)] = True
        self.holders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.index = {n: self._index(ks) for n, ks in self.by_length.items()}

    def _index(self, ks: list[int]):
        prints = np.array([fingerprints(self.words[k], len(self.words[k]), np.zeros(1, int))[0] for k in ks], np.uint64)
        tables = []
        for b in range(BLOCKS):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            near = (value[:, None] ^ _NEAR[None, :]).astype(np.uint16).ravel()
            order = np.argsort(near, kind="stable")
            tables.append((near[order], np.repeat(np.arange(len(ks), dtype=np.int32), len(_NEAR))[order]))
        return np.array(ks), prints, tables

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.filter[(shingles >> np.uint64(44)).astype(np.int64)])
        found = np.zeros(len(shingles), bool)
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        found[maybe] = self.known[at] == shingles[maybe]
        return found

    def candidates(self, length: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) for all fingerprints within the radius."""
        ks, own, tables = self.index[length]
        pairs = []
        for b, (near, item) in enumerate(tables):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            lo, hi = np.searchsorted(near, value, "left"), np.searchsorted(near, value, "right")
            n = hi - lo
            at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            pairs.append(np.repeat(np.arange(len(prints)), n) * len(ks) + item[at])
        pairs = np.unique(np.concatenate(pairs))
        window, item = pairs // len(ks), pairs % len(ks)
        close = np.bitwise_count(prints[window] ^ own[item]) <= RADIUS
        yield from zip(window[close].tolist(), ks[item[close]].tolist(), strict=True)

    def sharing(self, length: int, shingles: np.ndarray, least: float) -> np.ndarray:
        """The items of `length` words that have `least` of the shingles, repeated ones counted each time."""
        if length not in self.holders:
            ks = self.by_length[length]
            own = [np.array(list(self.shingles[k]), np.uint64) for k in ks]
            every, item = np.concatenate(own), np.repeat(ks, [len(x) for x in own])
            order = np.argsort(every, kind="stable")
            self.holders[length] = every[order], item[order]
        every, item = self.holders[length]
        lo, hi = np.searchsorted(every, shingles, "left"), np.searchsorted(every, shingles, "right")
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return np.flatnonzero(np.bincount(item[at], minlength=len(self.ids)) >= least - 1e-9)

    def matches(self, words: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window for each item found in a text."""
        best: dict[int, tuple[float, int, int]] = {}
        shingles = {k: shingle_hashes(words, k) for k in {min(self.size, n) for n in self.by_length if min(self.size, n) <= len(words)}}
        seen = {k: np.append(0, np.cumsum(self.hits(s))) for k, s in shingles.items()}
        for length in self.by_length:
            k = min(self.size, length)
            if k not in seen:
                continue
            # A text shorter than the item is one window.
            wide = min(length, len(words))
            n, own = wide - k + 1, length - k + 1
            need = least * (n + own) / (1 + least)
            if need > n + 1e-9 or seen[k][-1] < need - 1e-9:
                continue
            start = np.flatnonzero(seen[k][n:] - seen[k][:-n] >= need - 1e-9)
            if not len(start):
                continue
            lo, hi = int(start[0]), int(start[-1]) + wide
            pairs = set()
            if wide == length:
                # A few thousand words at a time, as a fingerprint is made from 64 sums for each word.
                for a in range(lo, hi, STRETCH):
                    some = start[(start >= a) & (start < a + STRETCH)]
                    if len(some):
                        prints = fingerprints(words[a : int(some[-1]) + wide], length, some - a)
                        pairs |= {(int(some[w]), item) for w, item in self.candidates(length, prints)}
            # Windows outside the radius may be similar enough still: each meets the items it shares enough shingles with.
            here = shingles[k][lo : int(start[-1]) + n]
            for item in self.sharing(length, here, need).tolist():
                held = np.append(0, np.cumsum(np.isin(here, np.array(list(self.shingles[item]), np.uint64))))
                pairs |= {(at, item) for at in start[held[start - lo + n] - held[start - lo] >= need - 1e-9].tolist()}
            for at, item in pairs:
                both = (Counter(shingles[k][at : at + n].tolist()) & self.shingles[item]).total()
                score = both / (n + own - both)
                if score >= least and (item not in best or (score, -at) > (best[item][0], -best[item][1])):
                    best[item] = (score, at, wide)
        return [(self.ids[item], *best[item]) for item in sorted(best)]


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.75, size: int = 5) -> DataFrame:
    """Documents that hold a window like a benchmark item: doc_id, item_id, similarity, first_word, n_words.

    One row for each document row and item, with its best window (the first of equals).  The similarity of two word
    sequences is that of their multisets of `size`-word shingles, sum of minima by sum of maxima; a shorter item is
    one shingle.  Words are lower-cased from A to Z and split at white space.  Null, empty or blank texts and items match nothing;
    repeated items are found once for each item_id.  A document that is shorter than an item is one window.  Empty
    tables give an empty table.
    """
    docs = document_columns(docs).where("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"

    def rows(block: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        ids = block.column("doc_id")
        out = [(ids[i].as_py(), *m) for i, matches in found for m in matches]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 2 else pa.int64()) for k, c in enumerate(columns)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    groups, docs = _groups(docs, items), document_columns(docs)
    if len(groups) > 1:
        docs = saved(_suspects(docs, items, size), "suspects")
    return reduce(DataFrame.unionByName, [docs.mapInArrow(_task(group, least, size, rows), schema) for group in groups])


def without_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.75, size: int = 5) -> DataFrame:
    """The rows of `docs`, all columns, that contaminated() finds nothing in; rows with a null text stay."""

    def rows(block: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        clean = np.ones(block.num_rows, bool)
        clean[[i for i, matches in found if matches]] = False
        return block.filter(pa.array(clean))

    groups = _groups(docs, items)
    if len(groups) == 1:
        return docs.mapInArrow(_task(groups[0], least, size, rows), docs.schema)
    # The few texts that may hold an item are numbered by their hash, and those that do are left out.
    text = F.sha2(F.col("text").cast("string"), 256)
    texts = docs.select(F.xxhash64(text).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = contaminated(texts, items, least, size).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, F.xxhash64(text) == F.col("_found"), "left_anti")


def _items(items: DataFrame) -> DataFrame:
    return items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()


def _groups(docs: DataFrame, items: DataFrame) -> list[Broadcast]:
    """The items in broadcasts of about ITEMS_AT_ONCE."""
    lean_batches(docs.sparkSession)
    items = _items(items)
    n = max(1, -(-items.count() // ITEMS_AT_ONCE))
    parts = (items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n))
    return [docs.sparkSession.sparkContext.broadcast(sorted({(r.item_id, r.text) for r in part.collect()})) for part in parts]


def _suspects(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """The texts that hold a shingle of any item: one scan, after which a large benchmark's groups look at few texts only.

    The shingles (8 bytes each) are broadcast up to BROADCAST_SHINGLES; of a still larger benchmark each group scans all texts.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(LOWER[text_bytes(block.column("text"))[0]], text_bytes(block.column("text"))[1])
            hashes, first = words.hashes(), words.first
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                k = min(size, b - a)
                h = shingle_hashes(hashes[a:b], k) if k else hashes[:0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int64)), pa.array(h.view(np.int64))], names=["k", "h"])

    shingles = saved(_items(items).mapInArrow(made, "k long, h long").distinct(), "shingles")
    if shingles.count() > BROADCAST_SHINGLES:
        return docs
    table = shingles.toArrow()
    k, h = table.column("k").to_numpy(), table.column("h").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast({n: np.sort(h[k == n]) for n in np.unique(k).tolist()})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(LOWER[text_bytes(block.column("text"))[0]], text_bytes(block.column("text"))[1])
            hashes, maybe = words.hashes(), np.zeros(block.num_rows, bool)
            for n, known in shared.value.items():
                own = shingle_hashes(hashes, n)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
                maybe[np.searchsorted(words.first, hit, "right") - 1] = True
            yield block.filter(pa.array(maybe))

    return docs.where("text is not null").mapInArrow(task, docs.schema)


_MADE: OrderedDict[tuple[str, int], Items] = OrderedDict()


def made(name: str, shared: Broadcast, size: int) -> Items:
    """The items of a broadcast with their index: a worker serves many tasks and keeps a few of them."""
    if (name, size) not in _MADE:
        _MADE[name, size] = Items([r[0] for r in shared.value], [r[1] for r in shared.value], size)
        while len(_MADE) > KEPT:
            _MADE.popitem(last=False)
    _MADE.move_to_end((name, size))
    return _MADE[name, size]


def _task(shared: Broadcast, least: float, size: int, rows: Callable):
    """For each block of texts `rows` of the block and its (row, matches) that may match at all."""
    name = uuid.uuid4().hex  # of this broadcast, on every worker

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made(name, shared, size)
        for block in blocks(batches, "text"):
            raw, at = text_bytes(block.column("text"))
            words = Words(LOWER[raw], at)
            hashes, first = words.hashes(), words.first
            # Texts with no known shingle at all are done; sizes below `size` only arise from very short items.
            maybe = np.zeros(block.num_rows, bool)
            for k in {min(size, n) for n in known.by_length}:
                hit = np.flatnonzero(known.hits(shingle_hashes(hashes, k)))
                maybe[np.searchsorted(first, hit, "right") - 1] = True
            yield rows(block, [(i, known.matches(hashes[first[i] : first[i + 1]], least)) for i in np.flatnonzero(maybe).tolist()])

    return task


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items)
