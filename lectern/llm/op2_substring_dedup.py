"""Substring deduplication by level-wise doubling over words.

Level one asks which windows of a quarter of the wanted length (13 words of 50) occur again.  Where
they do, twice that length is asked for (25 words), and of what is repeated there again twice (50 words); what is not
repeated at a level is never looked at again, and no level is begun once no candidates are left.  The first two
levels look at one window for each stretch of text, the last one at every window of the stretches that are left
(see repeats.py); equal stretches are one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import by_document, listed, split_runs
from .shared import document_columns, lean_batches, saved, split_join
from .textblock import BASES, Prefix, Words, blocks, merge_ranges, mix, text_bytes

WINDOWS = "a long, b long, doc_id long, lo long"


def _windows(length: int):
    """Two independent hashes for each window of the given runs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(*text_bytes(block.column(1)))
            row, lo, n = listed(block.column(2), block.num_rows)
            if not len(row):
                continue
            size = words.counts()[row]
            n = np.minimum(n, size - length + 1 - lo).clip(0)
            at = np.repeat(words.first[row] + lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            owner = np.repeat(row, n)
            made = [mix(Prefix(words.hashes(b), c).ranges(at, at + length)).view(np.int64) for b, c in (BASES[:2], BASES[2:])]
            ids = block.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(ids[owner]), pa.array(at - words.first[owner])], names=["a", "b", "doc_id", "lo"])

    return task


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leave out the words in the listed ranges; join the rest by single spaces."""
    for block in blocks(batches, "text"):
        raw, at = text_bytes(block.column(1))
        row, lo, n = listed(block.column(2), block.num_rows)
        from_, bounds = raw.tobytes(), np.searchsorted(row, np.arange(block.num_rows + 1))
        total, removed, kept = [], [], []
        for i in range(block.num_rows):
            words = from_[at[i] : at[i + 1]].split()
            size = len(words)
            if bounds[i] < bounds[i + 1]:
                own = slice(bounds[i], bounds[i + 1])
                starts, ends = merge_ranges(lo[own], np.minimum(lo[own] + n[own], size))
                for s, e in zip(starts[::-1].tolist(), ends[::-1].tolist(), strict=True):
                    del words[s:e]
            total.append(size)
            removed.append(size - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def dedup_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Remove every word covered by a window of `min_words` words that also starts in a document with a smaller doc_id.

    Reads doc_id and text; returns doc_id, n_words, n_removed and text (the kept words, joined by one space).
    Windows are judged on the input, so the result does not depend on order or partitions.
    A null or blank text has no words and gives an empty text.  Rows that share a doc_id never remove each
    other's words, and a range found in one of them counts for each, within its length.  Rows without a doc_id are
    returned whole.  A text longer than a block is searched in overlapping pieces.  An empty table gives an empty table.
    """
    lean_batches(docs.sparkSession)
    docs = document_columns(docs)
    copies, open_runs = split_runs(docs, "words", min_words, max(1, min_words // 2), within=False, levels=("g", "h"))
    covers = lambda df: df.select("doc_id", "lo", (F.col("n") + (min_words - 1)).cast("long").alias("n"))
    ranges = covers(copies)
    if not open_runs.isEmpty():
        windows = saved(by_document(docs, open_runs, "inner").mapInArrow(_windows(min_words), WINDOWS), "windows")
        first = saved(windows.groupBy("a", "b").agg(F.min("doc_id").alias("o_doc"), F.count(F.lit(1)).alias("k")).where("k > 1"), "first")
        later = split_join(windows, first, ["a", "b"], "k").where("doc_id > o_doc").select("doc_id", "lo", F.lit(1).alias("n"))
        ranges = ranges.unionByName(covers(later))
    return by_document(docs, ranges, "left").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
