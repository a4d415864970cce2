"""Runs of words that repeat with a period, found by longest common extensions.

The words of a block of texts are numbers.  `Extensions` answers how far two positions agree: only the suffixes at
positions of a difference cover are sorted (six of every 31), and two positions are compared word by word until both
stand on the cover, less than 31 words on; from there the answer is a range minimum over the common prefixes of the
sorted suffixes, kept in a sparse table.

A run of period p and four times its length at least holds a multiple of 2p in its first 2p words.  So for each period
the words at 0, 2p, 4p, ... are compared with those p further on: all periods together make a harmonic sum of pairs,
n log n of them.  Where a pair agrees for more than p words it is extended to the left, too, in the reversed texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import document_columns, lean_batches
from .textblock import Words, blocks, merge_ranges, ranges, text_bytes

#: A perfect difference set: every difference modulo 31 but zero is that of exactly one pair of its members (fixed values).
COVER, SPAN = np.array([0, 1, 3, 8, 12, 18]), 31
#: So many pairs of positions are looked at together.
PAIRS = 1 << 19

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("text", pa.string())])


def _steps() -> np.ndarray:
    """By the residues of two positions: how many words on both are in the cover."""
    inside = np.isin(np.arange(SPAN), COVER)
    at = np.arange(SPAN)
    both = inside[(at[:, None, None] + at) % SPAN] & inside[(at[None, :, None] + at) % SPAN]
    return both.argmax(axis=2)


STEPS = _steps()
PLACE = np.searchsorted(COVER, np.arange(SPAN))


class Extensions:
    """How many numbers agree from two positions on.  No common extension may reach the end: texts end in numbers of their own."""

    def __init__(self, numbers: np.ndarray):
        self.size = len(numbers)
        self.numbers = np.zeros((self.size // SPAN + 4) * SPAN, np.int64)
        self.numbers[: self.size] = numbers
        self.rank = None

    def _sample(self) -> None:
        """Ranks of the suffixes at cover positions, and the sparse table of the common prefixes of neighbours in their order."""
        rows = (self.size // SPAN + 2) * len(COVER)
        at = (np.arange(rows) // len(COVER)) * SPAN + COVER[np.arange(rows) % len(COVER)]
        bits = max(1, int(self.numbers.max()).bit_length())
        each, columns = 62 // bits, []
        for a in range(0, SPAN, each):
            packed = np.zeros(rows, np.int64)
            for k in range(a, min(a + each, SPAN)):
                packed = (packed << bits) | self.numbers[at + k]
            columns.append(packed)
        # The last blocks lie behind the texts and are all zeros: they get names of their own.
        columns.append(np.maximum(np.arange(rows) - (rows - len(COVER) - 1), 0))
        order = np.lexsort(columns[::-1])
        new = np.zeros(rows, bool)
        for c in columns:
            new[1:] |= c[order[1:]] != c[order[:-1]]
        names = np.empty(rows, np.int64)
        names[order] = np.cumsum(new)
        levels, step = [names], len(COVER)
        while names.max() < rows - 1:
            after = np.zeros(rows, np.int64)
            after[: max(0, rows - step)] = names[step:] + 1
            key = names * (rows + 1) + after
            order = np.argsort(key, kind="stable")
            names = np.empty(rows, np.int64)
            names[order] = np.cumsum(np.append(False, key[order[1:]] != key[order[:-1]]))
            levels.append(names)
            step *= 2
        # Common prefixes of neighbours: whole blocks by the names of each doubling, then words.
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(rows - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            open_ = (a < rows) & (b < rows)
            same = np.zeros(rows - 1, bool)
            same[open_] = levels[k][a[open_]] == levels[k][b[open_]]
            common += same * (SPAN << k)
            a += same * (len(COVER) << k)
            b += same * (len(COVER) << k)
        left = np.flatnonzero((a < rows) & (b < rows))
        x, y = at[a[left]], at[b[left]]
        for k in range(SPAN):
            go = self.numbers[x + k] == self.numbers[y + k]
            left, x, y = left[go], x[go], y[go]
            common[left] += 1
        self.table = [common]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            t, width = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-width], t[width:]))
        self.rank = names

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different positions, up to the size, how many numbers agree from there."""
        out, steps = np.zeros(len(i), np.int64), STEPS[i % SPAN, j % SPAN]
        open_ = np.arange(len(i))
        synced = []
        for k in range(SPAN):
            here = steps[open_] == k
            if here.any():
                synced.append(open_[here])
                open_ = open_[~here]
            if not len(open_):
                break
            open_ = open_[self.numbers[i[open_] + k] == self.numbers[j[open_] + k]]
            out[open_] += 1
        pairs = np.concatenate([np.zeros(0, np.int64), *synced])
        if len(pairs):
            if self.rank is None:
                self._sample()
            x, y = i[pairs] + steps[pairs], j[pairs] + steps[pairs]
            x, y = (self.rank[(v // SPAN) * len(COVER) + PLACE[v % SPAN]] for v in (x, y))
            lo, width = np.minimum(x, y), np.abs(x - y)
            level = np.frexp(width.astype(np.float64))[1] - 1
            for k in np.unique(level):
                on = level == k
                t = self.table[k]
                out[pairs[on]] += np.minimum(t[lo[on]], t[lo[on] + width[on] - (1 << k)])
        return out


def grid(size: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, period) of all pairs to compare, some PAIRS at a time: positions 0, 2p, 4p, ... for each period p of a text."""
    most = size // times
    first = np.append(0, np.cumsum(most))
    for a in range(0, int(first[-1]), PAIRS):
        at = np.arange(a, min(a + PAIRS, int(first[-1])))
        text = np.searchsorted(first, at, "right") - 1
        period = at - first[text] + 1
        count = (size[text] - period - 1) // (2 * period) + 1
        ends = np.cumsum(count)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            n, p = count[lo:hi], period[lo:hi]
            yield np.repeat(text[lo:hi], n), ranges(np.zeros(len(n), np.int64), n) * np.repeat(2 * p, n), np.repeat(p, n)
            lo = hi


def find_runs(ids: np.ndarray, first: np.ndarray, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in texts of numbers from 0 on; text k has the numbers first[k] to first[k + 1].

    Starts and ends are places in the whole block; runs come by start, then period.
    """
    size, texts = np.diff(first), len(first) - 1
    # Each text is followed by a number of its own, so that nothing agrees beyond it.
    moved = first[:-1] + np.arange(texts)
    apart = np.empty(len(ids) + texts, np.int64)
    apart[ranges(moved, size)] = ids + 1
    apart[moved + size] = int(ids.max(initial=0)) + 2 + np.arange(texts)
    ahead, back = Extensions(apart), Extensions(apart[::-1])
    found = [(np.zeros(0, np.int64),) * 3]
    for text, at, period in grid(size, times):
        i = moved[text] + at
        # More than a period agrees in a run; most pairs end at the first word or at the last that this takes.
        keep = apart[i] == apart[i + period]
        i, period, end = i[keep], period[keep], (moved + size)[text[keep]]
        keep = i + 2 * period < end
        i, period = i[keep], period[keep]
        keep = apart[i + period] == apart[i + 2 * period]
        i, period = i[keep], period[keep]
        if not len(i):
            continue
        right = ahead.common(i, i + period)
        keep = right > period
        i, period, right = i[keep], period[keep], right[keep]
        left = back.common(len(apart) - i, len(apart) - i - period)
        keep = (left < 2 * period) & (left + right + period >= np.maximum(least, times * period))
        found.append(((i - left)[keep], (i + period + right)[keep], period[keep]))
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # Of one stretch the smallest period counts; the others are its multiples.
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    text = np.searchsorted(moved, start, "right") - 1
    return start - text, end - text, period


def word_numbers(words: Words) -> np.ndarray:
    """Equal words of a block get equal numbers."""
    letters = np.zeros(len(words.raw) + 1, np.int64)
    np.add.at(letters, words.starts, 1)
    np.add.at(letters, words.ends, -1)
    offsets = np.append(0, np.cumsum(words.ends - words.starts))
    data = words.raw[np.cumsum(letters[:-1]) > 0]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _task(times: int, least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(*text_bytes(block.column(1)))
            start, end, period = find_runs(word_numbers(words), words.first, times, least)
            bounds = np.searchsorted(start, words.first)
            text = np.repeat(np.arange(block.num_rows), np.diff(bounds))
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start - words.first[text], end - start, period)], fields=list(RUN))
            lo, hi = merge_ranges(start + period, end)
            gone, kept = np.searchsorted(lo, words.first), []
            for k in range(block.num_rows):
                own = words.raw[words.at[k] : words.at[k + 1]].tobytes().split()
                for a, b in zip(lo[gone[k] : gone[k + 1]][::-1].tolist(), hi[gone[k] : gone[k + 1]][::-1].tolist(), strict=True):
                    del own[a - int(words.first[k]) : b - int(words.first[k])]
                kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(words.counts()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs), pa.array(kept, pa.string())], schema=FOUND)

    return task


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """All runs of repeated words of each whole text, and the text without the repetitions.

    A run is a stretch of consecutive words with smallest period q and a length of at least max(least, times * q) that cannot be
    extended keeping that period; `times` is 4 or more.  Reads doc_id and text; returns doc_id, n_words, runs (start, length and period
    in words, by start, then period) and text: the words that no run holds after its first q, joined by one space.
    A null, empty or blank text has no words, no runs and an empty text.  Rows without a doc_id and repeated rows are treated each
    by itself, and no run crosses texts; other columns are not looked at.  One very long text is held whole by one task,
    with some 100 bytes for each word; pairs of positions are looked at in parts.  An empty table gives an empty table.
    """
    if times < 4:
        raise ValueError("the grid of positions is sound for four repetitions and more")
    lean_batches(docs.sparkSession)
    return document_columns(docs).mapInArrow(_task(times, least), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text whose last words, for one document in ten, go round in a loop; all drawn from the checksum of doc_id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def loop(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        return F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    # The array is bound to a name once, else each word would split the text anew.
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.when(h % 10 == 0, F.array_join(F.element_at(F.transform(F.array(words), loop), 1), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.expr("aggregate(runs, cast(null as struct<start: long, length: long, period: long>), (b, x) -> if(b is null or x.length * b.period > b.length * x.period, x, b))")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"), "text")
    milli = F.expr("(1000 * best.length) div best.period")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
