"""Line deduplication by pairwise alignment.

Every line that an earlier document holds makes its document overlap with the line's first holder, and with no other; so
a line common to a million documents makes one overlap for each of them, never all pairs, and every
shared line has a partner that it can be aligned with.  Two overlapping documents are compared on the lines
that the earlier one holds first: what else they share is aligned with its own first holder.  Their
order is aligned by patience diff, whose anchors are the rarest lines, those that stand once on both sides (a longest
common subsequence where there is none), and what is aligned goes from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import document_columns, lean_batches, saved, split_join
from .textblock import Words, blocks, text_bytes

NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
#: Bits of one table of a longest common subsequence.
LCS_BITS = 1 << 27


LINES = "doc_id long, h long, pos array<int>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each different line of a text that is not empty, and where it stands among those lines."""
    for block in blocks(batches, "text"):
        lines = Words(*text_bytes(block.column(1)), NEWLINE)
        row = np.repeat(np.arange(block.num_rows), lines.counts())
        h, pos = lines.hashes(), np.arange(len(lines)) - lines.first[row]
        order = np.lexsort((pos, h, row))
        row, h, pos = row[order], h[order], pos[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        ids = block.column(0).to_numpy(zero_copy_only=False)
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(pos.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[row[first]], pa.int64()), pa.array(h[first].view(np.int64)), places], names=["doc_id", "h", "pos"])


def increasing(js: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct numbers, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, j in enumerate(js):
        pile = bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    return chain[::-1]


def lcs_rows(a: list[int], b: list[int]) -> list[int]:
    """For each line of `a` the row of the LCS table as bits: bit q is 0 where b[q] makes the subsequence longer."""
    full, at = (1 << len(b)) - 1, {}
    for q, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << q)
    rows, v = [], full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def lcs_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of `a` and each prefix of `b`."""
    full, at = (1 << len(b)) - 1, {}
    for q, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << q)
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(bits == 0))


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; large tables are halved (Hirschberg), so that memory stays bounded."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        own, other = a[i:i_end], b[j:j_end]
        if not own or not other:
            continue
        if len(own) > 1 and len(own) * len(other) > LCS_BITS:
            half = len(own) // 2
            best = int(np.argmax(lcs_lengths(own[:half], other) + lcs_lengths(own[half:][::-1], other[::-1])[::-1]))
            todo += [(i, i + half, j, j + best), (i + half, i_end, j + best, j_end)]
            continue
        rows = lcs_rows(own, other)
        p, q = len(own), len(other)
        while p and q:
            if rows[p - 1] >> (q - 1) & 1:
                q -= 1
                continue
            p -= 1
            if not p or rows[p - 1] >> (q - 1) & 1:
                q -= 1
                found.append((i + p, j + q))
    return sorted(found)


def common_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Patience diff: blocks (i, j, n) with a[i:i+n] == b[j:j+n], in order and disjoint.

    A range without a line that is unique on both sides is matched by a longest common subsequence of its shared lines.
    """
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            matched.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            matched.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {x: q for q, x in enumerate(b[j:j_end], j) if in_b[x] == 1}
        unique = [(p, place[x]) for p, x in enumerate(a[i:i_end], i) if in_a[x] == 1 and x in place]
        anchors = [unique[k] for k in increasing([q for _, q in unique])]
        if not anchors:
            own, other = [p for p in range(i, i_end) if a[p] in in_b], [q for q in range(j, j_end) if b[q] in in_a]
            matched += [(own[p], other[q]) for p, q in longest_common([a[p] for p in own], [b[q] for q in other])]
        for (p, q), (p2, q2) in zip([(i - 1, j - 1), *anchors], [*anchors, (i_end, j_end)], strict=True):
            if anchors and p + 1 < p2 and q + 1 < q2:
                todo.append((p + 1, p2, q + 1, q2))
        matched += anchors
    made: list[list[int]] = []
    for p, q in sorted(matched):
        if made and made[-1][0] + made[-1][2] == p and made[-1][1] + made[-1][2] == q:
            made[-1][2] += 1
        else:
            made.append([p, q, 1])
    return [tuple(m) for m in made]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the later document's lines that align, for each pair of documents."""
    for batch in batches:
        docs, places = [], []
        for doc_id, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(lines) == 1 and len(lines[0]["pos"]) == 1:
                found = lines[0]["pos"]
            else:
                a = sorted((p, k) for k, x in enumerate(lines) for p in x["a_pos"])
                b = sorted((p, k) for k, x in enumerate(lines) for p in x["pos"])
                found = [p for _, j, n in common_blocks([k for _, k in a], [k for _, k in b]) for p, _ in b[j : j + n]]
            docs += [doc_id] * len(found)
            places += found
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int32())], names=["doc_id", "pos"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, kept = [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            filled = [i for i, line in enumerate(lines) if line]
            gone = {filled[p] for p in places or () if p < len(filled)}
            total.append(len(filled))
            removed.append(len(gone))
            kept.append("\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), batch.column("others")], names=["doc_id", "n_lines", "n_removed", "text", "others"])


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Delete from each document the lines that align with an earlier one.

    Reads doc_id and text; returns doc_id, n_lines (lines that are not empty), n_removed, text and the columns `keep` of the
    input, whatever their names but for those four.  Earlier means a smaller doc_id.  Lines are compared exactly and on the
    input, the shortest too.  A line that an earlier document holds stays only where its order contradicts
    the alignment with its first holder.  A null text stays null and has no lines; an empty one stays
    empty.  Rows that share a doc_id are never aligned with each other, and a line that goes in one of them goes in each, by
    its place.  Rows without a doc_id are returned whole.  A very long text is handled whole in one task.  An empty table gives an empty table.
    """
    if clash := {"doc_id", "n_lines", "n_removed", "text"} & set(keep):
        raise ValueError(f"these columns are made here: {sorted(clash)}")
    lean_batches(docs.sparkSession)
    others = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), others.alias("others"))
    rows = saved(document_columns(docs).where("doc_id is not null and text is not null").mapInArrow(_lines, LINES), "lines")
    first = rows.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    held = saved(first.where("first.doc_id < last").select("h", F.col("first.doc_id").alias("first"), F.col("first.pos").alias("a_pos"), "n"), "held")
    shared = split_join(rows, held, ["h"], "n").where("first < doc_id")
    pairs = shared.groupBy("first", "doc_id").agg(F.collect_list(F.struct("pos", "a_pos")).alias("lines"))
    aligned = pairs.select("doc_id", "lines").mapInArrow(_align, "doc_id long, pos int")
    places = aligned.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    schema = f"doc_id long, n_lines long, n_removed long, text string, others {whole.schema['others'].dataType.simpleString()}"
    kept = whole.join(places.hint("merge"), "doc_id", "left").select("doc_id", "text", "others", "places").mapInArrow(_without, schema)
    return kept.select("doc_id", "n_lines", "n_removed", "text", *(F.col(f"others.`{c}`") for c in keep))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
