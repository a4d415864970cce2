"""Removal of repeated byte strings by suffix arrays.

repeats.py narrows the corpus to the stretches whose windows may repeat elsewhere; equal stretches are
aggregated there and enter once, so that no group of copies meets in one task.  Stretches are dealt into shards by
their anchor, so that equal windows always share a shard.  Each shard is sorted by external induced
sorting (induced.py); neighbours in the suffix array that share `length` bytes are copies of one string, of which the
first stays.  An anchor with more different stretches than fit a shard is counted window by window instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .induced import QUEUED, sort_strings
from .repeats import by_document, listed, split_runs
from .shared import lean_batches, saved, split_join
from .textblock import BASES, BLOCK_BYTES, Prefix, blocks, merge_ranges, mix, text_bytes

#: Stands for a missing doc_id inside.
NO_ID = -(1 << 63)
#: An anchor that leads more different stretches than this (some 15 MB of text) is counted window by window.
HOT = 100_000
#: A shard is sorted when it holds this many bytes and its last key is complete.
SHARD_BYTES = 4 << 20
#: Suffixes whose groups are looked at together.
GROUPED = 1 << 20
STRETCHES = "key long, doc_id long, lo long, n int, bytes binary"
WINDOWS = "a long, b long, doc_id long, lo long"


def _listed_runs(block: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first byte in the block, first window, windows, place in the list) of each listed run, within its text."""
    _, at = text_bytes(block.column(1))
    row, lo, n = listed(block.column(2), block.num_rows)
    n = np.minimum(n, np.diff(at)[row] - length + 1 - lo)
    good = np.flatnonzero(n > 0)
    return row[good], at[row[good]] + lo[good], lo[good], n[good], good


def _stretches(length: int):
    """The bytes of each listed run, keyed by its anchor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            row, start, lo, n, good = _listed_runs(block, length)
            if not len(row):
                continue
            key, data = np.asarray(block.column(2).flatten().field(2))[good], text_bytes(block.column(1))[0].tobytes()
            cut = [data[a:b] for a, b in zip(start.tolist(), (start + n + (length - 1)).tolist(), strict=True)]
            ids = block.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids[row], pa.int64()), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(cut, pa.binary())], names=["key", "doc_id", "lo", "n", "bytes"])

    return task


def _windows(length: int):
    """Two independent hashes for each window of the listed runs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            row, start, lo, n, _ = _listed_runs(block, length)
            raw = text_bytes(block.column(1))[0]
            ids = block.column(0).to_numpy(zero_copy_only=False)
            for r, s, w, k in zip(row.tolist(), start.tolist(), lo.tolist(), n.tolist(), strict=True):
                for i in range(0, k, BLOCK_BYTES):
                    part = raw[s + i : s + min(k, i + BLOCK_BYTES) + length - 1].astype(np.uint64) + np.uint64(1)
                    a, b = (mix(Prefix(part, x).windows(length)).view(np.int64) for x in (BASES[2], BASES[3]))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), ids[r])), pa.array(w + i + np.arange(len(a)))], names=["a", "b", "doc_id", "lo"])

    return task


def repeated_windows(doc_id: np.ndarray, lo: np.ndarray, n: np.ndarray, raw: np.ndarray, length: int, budget: int = QUEUED) -> pa.RecordBatch:
    """(doc_id, lo, n) ranges of windows of one shard that repeat an earlier window of it."""
    n = n.astype(np.int64)
    order = np.lexsort((lo, doc_id))
    rank = np.empty(len(order), np.int64)  # of each stretch's first window by document and place
    rank[order] = np.append(0, np.cumsum(n[order])[:-1])
    ends, window = np.cumsum(n + (length - 1)), np.cumsum(n) - n
    begin = ends - n - (length - 1) + np.arange(len(ends)) + 1
    later = np.zeros(int(n.sum()), bool)
    for at, prefix in sort_strings(raw, ends, length, budget):
        same = prefix >= length
        near = np.flatnonzero(same | np.append(same[1:], False))
        if not len(near):
            continue
        at, group = at[near], np.cumsum(~same[near]) - 1
        least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)

        def place(i: int, at: np.ndarray = at) -> tuple[np.ndarray, np.ndarray]:
            stretch = np.searchsorted(begin, at[i : i + GROUPED], "right") - 1
            return stretch, at[i : i + GROUPED] - begin[stretch]

        for i in range(0, len(at), GROUPED):
            stretch, offset = place(i)
            own = group[i : i + GROUPED]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            least[own[first]] = np.minimum(least[own[first]], np.minimum.reduceat(rank[stretch] + offset, first))
        for i in range(0, len(at), GROUPED):
            stretch, offset = place(i)
            later[window[stretch] + offset] = rank[stretch] + offset != least[group[i : i + GROUPED]]
    found = np.flatnonzero(later)
    stretch = np.searchsorted(window, found, "right") - 1
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (stretch[1:] != stretch[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(found)))
    stretch, offset = stretch[start], found[start] - window[stretch[start]]
    return pa.RecordBatch.from_arrays([pa.array(doc_id[stretch]), pa.array(lo[stretch] + offset), pa.array(count, pa.int64())], names=["doc_id", "lo", "n"])


def _sort_shards(length: int):
    """Sort the stretches of a partition, which come ordered by key, in shards of whole keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sorted_shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            shard = pa.Table.from_batches(parts).combine_chunks()
            doc_id, lo, n = (shard.column(c).to_numpy() for c in ("doc_id", "lo", "n"))
            return repeated_windows(doc_id, lo, n, text_bytes(shard.column("bytes").cast(pa.large_binary()))[0], length)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= SHARD_BYTES:
                key = batch.column(0).to_numpy()
                last = held[-1].column(0)[-1].as_py()
                other = np.flatnonzero(key != last)
                cut = int(other[0]) if len(other) else batch.num_rows
                if cut:
                    held.append(batch.slice(0, cut))
                    size += batch.slice(0, cut).nbytes
                if not len(other):
                    continue
                yield sorted_shard(held)
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield sorted_shard(held)

    return task


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leave out the listed byte ranges."""
    for block in blocks(batches, "text"):
        raw, at = text_bytes(block.column(1))
        row, lo, n = listed(block.column(2), block.num_rows)
        data, bounds = raw.tobytes(), np.searchsorted(row, np.arange(block.num_rows + 1))
        total, removed, spans, kept = [], [], [], []
        for i in range(block.num_rows):
            a, b = int(at[i]), int(at[i + 1])
            own = slice(bounds[i], bounds[i + 1])
            starts, ends = merge_ranges(lo[own], np.minimum(lo[own] + n[own], b - a))
            edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), b - a]
            total.append(b - a)
            removed.append(int((ends - starts).sum()))
            spans.append(len(starts))
            kept.append(b"".join(data[a + x : a + y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_bytes(docs: DataFrame, length: int = 100, anchor: int = 32) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts earlier in the corpus.

    Earlier: in a smaller doc_id or before in the same document.  Reads doc_id and text; returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs) and kept (the other bytes, as binary).  Strings are judged on the input, overlaps
    count, and none crosses documents.  A null text is empty.  Rows that share a doc_id count as one document at the same places:
    a range found in one of them counts for each, within its length.  Rows without a doc_id are returned whole.  A
    text longer than a block is searched in overlapping pieces.  An empty table gives an empty table.  `length` may be up to 250, `anchor` any smaller number.
    """
    lean_batches(docs.sparkSession)
    # An id that is never null keeps the two joins below alike, so that the texts are shuffled once for both.
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    copies, open_runs = split_runs(docs.where(F.col("doc_id") != NO_ID), "bytes", length, anchor, within=True)
    # Lists keep the nulls of no group, so that the texts are shuffled once for the joins.
    lists = lambda runs: runs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n", "h")).alias("ranges"))
    texts = lambda runs: docs.join(lists(runs).hint("merge"), "doc_id").select("doc_id", "text", "ranges")
    shards = texts(open_runs.where(F.col("k") <= HOT)).mapInArrow(_stretches(length), STRETCHES).repartition("key").sortWithinPartitions("key")
    later = shards.mapInArrow(_sort_shards(length), "doc_id long, lo long, n long")
    hot = open_runs.where(F.col("k") > HOT)
    if not hot.isEmpty():
        windows = saved(texts(hot).mapInArrow(_windows(length), WINDOWS), "windows")
        first = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "lo")).alias("o"), F.count(F.lit(1)).alias("k")).where("k > 1")
        again = split_join(windows, saved(first, "first"), ["a", "b"], "k").where((F.col("doc_id") != F.col("o.doc_id")) | (F.col("lo") != F.col("o.lo")))
        later = later.unionByName(again.select("doc_id", "lo", F.lit(1).cast("long").alias("n")))
    covers = lambda df: df.select("doc_id", "lo", (F.col("n") + (length - 1)).cast("long").alias("n"))
    ranges = covers(copies).unionByName(covers(later)).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    kept = by_document(docs, ranges, "left").mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return kept.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
