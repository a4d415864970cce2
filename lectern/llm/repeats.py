"""Find passages that occur more than once, without a row for each window of the corpus.

A window of `length` units (words or bytes) is represented by the smallest hash of the
`anchor`-unit windows inside it.  Consecutive windows mostly share that smallest hash, so
a text becomes a short list of *runs*: maximal stretches of windows with one anchor.
Equal windows have equal anchors wherever they stand, hence

* a run whose anchor occurs nowhere else holds no repeated window and is done;
  (within one document, a run may also repeat itself: then its anchor stands in it twice);
* runs that agree on anchor and content are one *stretch*, aggregated before anything else is done with
  it: the first of them stands for all, so a group of copies is looked at once, and the others, whose every window
  starts earlier in the first, go;
* only stretches whose anchor also leads other stretches need a look at their single windows.

Every step is a hash aggregation (combined before its shuffle) or a join in which hot keys are
broadcast, so no key gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, split_join
from .textblock import BASES, BLOCK_BYTES, TOP, Prefix, Words, blocks, mix, room, sliding, text_bytes

RUNS = "h long, c long, doc_id long, lo long, n int, twice boolean, g long"
_RUNS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("twice", pa.bool_()), ("g", pa.int64())])


def units(raw: np.ndarray, at: np.ndarray, by: str) -> tuple[np.ndarray, np.ndarray]:
    """The units of a block (bytes, or hashes of words), and where each text's units begin."""
    if by == "bytes":
        return raw, at
    words = Words(raw, at)
    return words.hashes(), words.first


def overlapping(values: np.ndarray, first: np.ndarray, length: int, most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The units of a block as integers; one very long text in pieces that overlap by all but one unit of a window, with where each begins."""
    whole = lambda x: x if x.dtype == np.uint64 else x.astype(np.uint64) + np.uint64(1)
    if len(first) > 2 or len(values) <= 2 * most:
        yield whole(values), first, 0
        return
    for a in range(0, len(values) - length + 1, most):
        piece = whole(values[a : a + most + length - 1])
        yield piece, np.array([0, len(piece)]), a


def block_runs(values: np.ndarray, first: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of a block: anchor hash, content hash, text number, first window in the text, number of windows, whether
    the anchor stands in the run twice, and the hash of the anchor's first half."""
    small, whole = Prefix(values, BASES[1]), Prefix(values, BASES[2])
    lead = mix(small.windows(anchor))
    lead = np.where(room(first, anchor)[: len(lead)], lead, TOP)
    least = sliding(lead, length - anchor + 1)
    if not len(least):
        return (np.zeros(0, np.int64),) * 7
    valid = room(first, length)[: len(least)]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    new[first[(first > 0) & (first < len(least))]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(least))
    keep = valid[start]
    start, end = start[keep], end[keep]
    content = mix(whole.ranges(start, end + (length - 1)) + (end - start).astype(np.uint64))
    text = np.searchsorted(first, start, "right") - 1
    # Anchors: positions that are the least of some window; a run holds those of its value between its ends.
    width = length - anchor + 1
    edge = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([edge, np.where(valid, least, np.uint64(0)), edge]), width, np.maximum)
    place = np.flatnonzero((lead == most) & (lead != TOP))
    at, till = np.searchsorted(place, start), np.searchsorted(place, end + (width - 1))
    seen, open_, where = np.zeros(len(start), np.int64), np.arange(len(start)), np.zeros(len(start), np.int64)
    while len(open_):
        hit = lead[place[at[open_]]] == least[start[open_]]
        new = open_[hit & (seen[open_] == 0)]
        where[new] = place[at[new]]
        seen[open_] += hit
        at[open_] += 1
        open_ = open_[(at[open_] < till[open_]) & (seen[open_] < 2)]
    half = mix(small.ranges(where, where + (anchor + 1) // 2))
    return least[start].view(np.int64), content.view(np.int64), text, start - first[text], end - start, seen > 1, half.view(np.int64)


def find_runs(docs: DataFrame, by: str, length: int, anchor: int) -> DataFrame:
    """(h, c, doc_id, lo, n, twice, g) for every run of every text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            ids = block.column(0).to_numpy(zero_copy_only=False)
            values, first = units(*text_bytes(block.column(1)), by)
            if len(values) < length:
                continue
            for piece, bounds, at in overlapping(values, first, length):
                h, c, text, lo, n, twice, g = block_runs(piece, bounds, length, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(ids[text]), pa.array(lo + at), pa.array(n.astype(np.int32)), pa.array(twice, pa.bool_()), pa.array(g)], schema=_RUNS)

    return docs.where("doc_id is not null and text is not null").mapInArrow(task, RUNS)


def again(runs: DataFrame, key: str, within: bool) -> DataFrame:
    """The keys that several runs have, or one run twice if `within`; k says how many runs."""
    seen = runs.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("twice"))
    return saved(seen.where((F.col("k") > 1) | (F.col("twice") & F.lit(within))).select(key, "k"), "again")


def split_runs(docs: DataFrame, by: str, length: int, anchor: int, within: bool, levels: tuple[str, ...] = ("h",)) -> tuple[DataFrame, DataFrame]:
    """Runs that repeat an earlier run entirely as (doc_id, lo, n), and the stretches that need a look at each window
    as (h, doc_id, lo, n, k), k being the number of stretches of the anchor.  Earlier: in a smaller doc_id or, if `within`,
    also before in the same document.  `levels` are the keys that must occur again, one after the other, for a run to survive."""
    runs = find_runs(docs, by, length, anchor)
    for key in levels:
        runs = saved(split_join(runs, again(runs, key, within), [key], "k"), "runs")
    stretch = runs.groupBy("h", "c").agg(F.min(F.struct("doc_id", "lo")).alias("o"), F.max("twice").alias("twice"), F.max("n").alias("n"), F.count(F.lit(1)).alias("m"))
    stretch = saved(stretch.select("h", "c", F.col("o.doc_id").alias("o_doc"), F.col("o.lo").alias("o_lo"), "twice", "n", "m"), "stretches")
    copied = split_join(runs.select("h", "c", "doc_id", "lo", "n"), stretch.where("m > 1").select("h", "c", "o_doc", "o_lo", "m"), ["h", "c"], "m")
    first = (F.col("doc_id") == F.col("o_doc")) & ((F.col("lo") == F.col("o_lo")) | F.lit(not within))
    several = stretch.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("twice")).where((F.col("k") > 1) | (F.col("twice") & F.lit(within)))
    several = saved(several.select("h", "k", F.col("k").alias("rows")), "several")
    open_runs = split_join(stretch.select("h", F.col("o_doc").alias("doc_id"), F.col("o_lo").alias("lo"), "n"), several, ["h"], "rows")
    return copied.where(~first).select("doc_id", "lo", "n"), open_runs


def by_document(docs: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """Each document with the ranges found in it, as one list bounded by the document's length."""
    lists = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))
    return docs.join(lists.hint("merge"), "doc_id", how).select("doc_id", "text", "ranges")


def listed(column: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, n) of a list<struct<lo, n>> column; null counts as empty."""
    if not len(column) or column.null_count == len(column):
        return (np.zeros(0, np.int64),) * 3
    flat = column.flatten()
    counts = np.asarray(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(rows), counts), np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
