"""Packing documents into sequences by linear grouping.

Tokenising and ranking run on Spark; the plan itself is made from a histogram with one
entry for each length, so its work is bounded by the square of the capacity and never by the corpus:

1. Lengths of at least capacity / 8 are large.  In descending order they are dealt into groups of
   equal cardinality and rounded up to the largest of their group.
2. For these few sizes the configurations (sets of sizes that fit one sequence) and how often to use
   each are optimised by column generation; fractions are rounded down and the rest is placed by best fit.
3. The documents of a group take the places of its size.  As both sides are ordered by length, sequences of
   one configuration fall into a few bundles with equal lengths inside, and so with a known remainder.
4. Small lengths, largest first, go to the bundle whose remainder is the smallest that holds them.

A plan row says: pieces of this length, ranked lo to hi among their length, go to consecutive sequences at this
offset.  A document finds its place by its length and its rank.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bucket_of, document_columns, lean_batches, saved
from .textblock import LOWER, SPACE, blocks, parts_of, range_hashes, ranges, text_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Distinct chunks that a worker remembers; beyond it those stay that were used since the last clearing.
CACHED_CHUNKS = 1_000_000
#: Chunks of one string handed to the tokeniser.
TOGETHER = 1000
#: Stands between chunks in that string; a pre-token of its own, as white space is on both sides.
MARKER = "\x01"
#: Plan rows (five longs each) that are broadcast; more are shuffled.
BROADCAST_PLAN = 200_000
#: Ranks of one length that share a join key with their plan rows.
RANK_BLOCK = 1 << 16

#: 0 for white space, 1 for ASCII letters, 2 for stops, 3 for all else.
KIND = np.full(256, 3, np.uint8)
KIND[SPACE] = 0
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[list(b".,;:!?")] = 2

# Normaliser and splitter under which the chunks of a text may be encoded apart.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_white_space(config: dict) -> bool:
    """Whether a tokeniser's own configuration proves that its ids are those of the chunks of a text.

    Its splitter keeps runs of letters, single numbers and runs of other characters, none with white space, and the
    contractions start with an apostrophe; so it always splits at white space and between an ASCII letter and a stop.
    Normal form C composes neither white space nor stops with what stands beside them, and lower-casing goes by
    character, so A to Z may be lower-cased before.  The model sees one pre-token at a time.
    """
    normal, before = config.get("normalizer") or {}, (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = before[0]
    whole = split.get("type") == "Split" and split.get("pattern") == {"Regex": PATTERN} and split.get("invert") is True and split.get("behavior") == "Removed"
    return normal.get("normalizers") == NORMALIZERS and whole and len(before) == 2 and before[1].get("use_regex") is False and not before[1].get("add_prefix_space")


def chunks_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chunks of a block begin and end, and the first chunk of each text.

    Chunks are what stands between white space, cut between ASCII letters and stops.
    """
    kind = np.zeros(len(raw) + 2, np.uint8)
    kind[1:-1] = KIND[raw]
    here, before = kind[1:], kind[:-1]
    turn = (here + before == 3) & (here > 0) & (before > 0)
    turn[at] = True
    starts = np.flatnonzero((here > 0) & (turn | (before == 0)))
    ends = np.flatnonzero((before > 0) & (turn | (here == 0)))
    return starts, ends, np.searchsorted(starts, at)


class ChunkIds:
    """Token ids of chunks, each made once: sorted hashes, and for each the place of its ids in one pool."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.apart = splits_at_white_space(config)
        #: Added tokens are found in the text as it is, so chunks with their first character keep their case.
        self.kept_case = sorted({ord(t["content"][0]) for t in config.get("added_tokens") or []})
        mark = self.encode([MARKER])[0]
        self.apart = self.apart and len(mark) == 1 and all(c < 128 for c in self.kept_case)
        self.mark = int(mark[0])
        self.clear()

    def clear(self) -> None:
        self.keys, self.used = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        keep = np.flatnonzero(self.used)
        if 2 * len(keep) > CACHED_CHUNKS:
            return self.clear()
        self.pool = self.pool[ranges(self.start[keep], self.size[keep])]
        self.keys, self.size = self.keys[keep], self.size[keep]
        self.start, self.used = np.cumsum(self.size) - self.size, np.zeros(len(keep), bool)

    def _made(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of chunks as one array, and where those of each begin and end; TOGETHER of them to a string with markers between."""
        between, pool, start, end, at = f" {MARKER} ".encode(), [], [], [], 0
        groups = [chunks[i : i + TOGETHER] for i in range(0, len(chunks), TOGETHER)]
        for group, ids in zip(groups, self.encode([between.join(g).decode() for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == self.mark)
            lo, hi = np.append(0, cuts + 1), np.append(cuts, len(ids))
            if len(lo) != len(group):  # a chunk holds the marker itself
                apart = self.encode([c.decode() for c in group])
                hi = np.cumsum([len(x) for x in apart])
                ids, lo = np.concatenate(apart), np.append(0, hi[:-1])
            pool.append(ids)
            start.append(lo + at)
            end.append(hi + at)
            at += len(ids)
        return np.concatenate(pool), np.concatenate(start), np.concatenate(end)

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        if len(self.keys) + len(keys) > CACHED_CHUNKS:
            self._forget()
        ids, start, end = self._made(chunks)
        order = np.argsort(keys)
        place, start, size = np.searchsorted(self.keys, keys[order]), start[order] + len(self.pool), (end - start)[order]
        self.pool = np.concatenate([self.pool, ids])
        self.keys, self.start, self.size = np.insert(self.keys, place, keys[order]), np.insert(self.start, place, start), np.insert(self.size, place, size)
        self.used = np.insert(self.used, place, True)

    def of_block(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a block as one array, and len+1 offsets into it."""
        if not self.apart:
            data = raw.tobytes()
            made = self.encode([data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            return np.concatenate([np.zeros(0, np.uint32), *made]), np.append(0, np.cumsum([len(m) for m in made], dtype=np.int64))
        starts, ends, first = chunks_of(raw, at)
        lower = LOWER[raw]
        special = np.flatnonzero(np.isin(raw, self.kept_case))
        for k in np.unique(np.searchsorted(starts, special, "right") - 1).tolist():
            lower[starts[k] : ends[k]] = raw[starts[k] : ends[k]]
        code, keys = pd.factorize(range_hashes(lower, starts, ends))
        known = lambda: (place := np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0)), (self.keys[place] == keys) if len(self.keys) else np.zeros(len(keys), bool))
        place, there = known()
        if not there.all():
            self.used[place[there]] = True
            new = np.flatnonzero(~there)
            some = np.empty(len(keys), np.int64)
            some[code] = np.arange(len(code))
            data, some = lower.tobytes(), some[new]
            self._learn(keys[new], [data[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            place, there = known()
            if not there.all():  # forgotten in between: all of the block again
                self.clear()
                return self.of_block(raw, at)
        self.used[place] = True
        size = self.size[place][code]
        ends_at = np.append(0, np.cumsum(size))
        return self.pool[ranges(self.start[place][code], size)], ends_at[first]


@lru_cache(maxsize=1)
def chunk_ids(path: str) -> ChunkIds:
    """One for each Python worker, which serves many tasks."""
    return ChunkIds(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of each text and `end_id`, cut only where longer than `capacity`.

    A text longer than a block is read in parts that end at white space.
    """

    def cut(ids: np.ndarray, done: int, doc_id: int | None, rows: list[tuple]) -> None:
        for at in range(0, len(ids), capacity):
            piece = ids[at : at + capacity]
            rows.append((doc_id, (done + at) // capacity, done + at, len(piece), zlib.crc32(piece)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = chunk_ids(path), np.array([end_id], np.uint32)
        for block in blocks(batches, "text"):
            rows: list[tuple] = []
            raw, at = text_bytes(block.column(1))
            if block.num_rows > 1 or not cache.apart:
                ids, ends = cache.of_block(raw, at)
                for doc_id, a, b in zip(block.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    cut(np.append(ids[a:b], end), 0, doc_id, rows)
            else:
                done, left, doc_id = 0, end[:0], block.column(0)[0].as_py()
                for a, b in parts_of(raw, SPACE):
                    ids = np.append(left, cache.of_block(raw[a:b], np.array([0, b - a]))[0])
                    whole = len(ids) // capacity * capacity
                    cut(ids[:whole], done, doc_id, rows)
                    done, left = done + whole, ids[whole:]
                cut(np.append(left, end), done, doc_id, rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.mapInArrow(task, PIECES)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Cutting-stock solution rounded down: how often to use each configuration (a count for each size)."""
    m = len(sizes)
    base = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(8 * m):
        inverse = np.linalg.inv(base)
        use, price = inverse @ need, np.ones(m) @ inverse
        # The most valuable configuration: a knapsack, one more item in each round, for all rooms at once.
        best, picks = np.zeros(capacity + 1), []
        for _ in range(capacity // min(sizes)):
            more, pick = best.copy(), np.full(capacity + 1, -1)
            for i, s in enumerate(sizes):
                value = best[: capacity + 1 - s] + price[i]
                better = np.flatnonzero(value > more[s:] + 1e-12)
                more[s + better], pick[s + better] = value[better], i
            if (pick < 0).all():
                break
            best = more
            picks.append(pick)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(m), capacity
        for pick in reversed(picks):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        base[:, int(np.argmin(ratio))] = column
    use = np.linalg.inv(base) @ need
    return [(base[:, j].astype(int).tolist(), int(use[j] + 1e-9)) for j in range(m) if use[j] >= 1 - 1e-9]


def group_sizes(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Deal (length, count), lengths descending, into groups of equal cardinality: lists of [length, first rank, count]."""
    total = sum(n for _, n in large)
    share, made, left = -(-total // groups), [[]], 0
    left = share
    for length, n in large:
        rank = 0
        while n:
            if not left:
                made.append([])
                left = share
            take = min(n, left)
            made[-1].append([length, rank, take])
            rank, n, left = rank + take, n - take, left - take
    return made


class Runs:
    """Ranked documents of one group, handed out in order as runs of equal length."""

    def __init__(self, runs: list[list[int]]):
        self.runs = [r for r in runs if r[2]]

    def __len__(self) -> int:
        return sum(r[2] for r in self.runs)

    def take(self, n: int) -> list[tuple[int, int, int]]:
        got = []
        while n and self.runs:
            length, rank, have = self.runs[0]
            k = min(n, have)
            got.append((length, rank, k))
            self.runs[0] = [length, rank + k, have - k]
            if k == have:
                self.runs.pop(0)
            n -= k
        return got


def plan(histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = (24, 72)) -> list[tuple[int, int, int, int, int]]:
    """(length, rank lo, rank hi, first sequence, offset) for all pieces of a histogram {length: count}.

    Finer groups round up less but are harder to fill with whole numbers of configurations, so the best of a few
    group counts is taken.
    """
    made = [_plan(histogram, capacity, g) for g in groups]
    return min(made, key=lambda rows: max((first + hi - lo for _, lo, hi, first, _ in rows), default=0))


def _plan(histogram: dict[int, int], capacity: int, groups: int) -> list[tuple[int, int, int, int, int]]:
    rows: list[tuple[int, int, int, int, int]] = []
    # Bundles of consecutive sequences by remainder; each is (first sequence, how many, used).
    bundles: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    next_sequence = 0

    def add(room: int, first: int, n: int) -> None:
        if room <= 0 or not n:
            return
        if room not in bundles:
            bundles[room] = []
            insort(rooms, room)
        heapq.heappush(bundles[room], (first, n))

    def best_fit(length: int, rank: int, n: int) -> None:
        nonlocal next_sequence
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                first, count = next_sequence, max(1, n // each)
                next_sequence += count
                add(capacity, first, count)
                continue
            room = rooms[i]
            first, have = heapq.heappop(bundles[room])
            if not bundles[room]:
                del bundles[room]
                rooms.pop(i)
            k = min(n, have)
            rows.append((length, rank, rank + k, first, capacity - room))
            add(room - length, first, k)
            add(room, first + k, have - k)
            rank, n = rank + k, n - k

    large = sorted(((s, n) for s, n in histogram.items() if s >= capacity // 8 and n), reverse=True)
    if large:
        parts = group_sizes(large, groups)
        sizes = sorted({p[0][0] for p in parts}, reverse=True)
        queues = [Runs([r for p in parts if p[0][0] == s for r in p]) for s in sizes]
        for counts, times in configurations(sizes, [len(q) for q in queues], capacity):
            slots = [i for i, a in enumerate(counts) for _ in range(a)]
            times = min([times, *(len(queues[i]) // a for i, a in enumerate(counts) if a)])
            if not times:
                continue
            first, next_sequence = next_sequence, next_sequence + times
            taken = [queues[i].take(times) for i in slots]
            # Cut where any slot changes its length, so that a bundle has equal lengths inside.
            edges = sorted({0, times, *(int(x) for t in taken for x in np.cumsum([k for *_, k in t]))})
            at = [[*np.cumsum([0, *(k for *_, k in t)])] for t in taken]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                offset = 0
                for t, starts in zip(taken, at, strict=True):
                    j = int(np.searchsorted(starts, lo, "right")) - 1
                    length, rank, _ = t[j]
                    shift = rank + lo - int(starts[j])
                    rows.append((length, shift, shift + hi - lo, first + lo, offset))
                    offset += length
                add(capacity - offset, first + lo, hi - lo)
        for queue in queues:
            for length, rank, n in queue.take(len(queue)):
                best_fit(length, rank, n)
    for length in sorted((s for s in histogram if s < capacity // 8), reverse=True):
        best_fit(length, 0, histogram[length])
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to (doc_id, piece, length, ...).

    The rank of a piece among its length comes from counts of (length, bucket) and a row number inside the bucket, so a
    length that a third of all pieces share is ranked by as many tasks as it has buckets.
    """
    spark = pieces.sparkSession
    n = max(16, min(4096, pieces.count() // 20_000))
    pieces = pieces.withColumn("bucket", bucket_of(F.struct("doc_id", "piece"), n))
    counts = saved(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length up to the capacity
    rows = plan(histogram, capacity)
    where = spark.createDataFrame([tuple(map(int, r)) for r in rows], "p_length long, lo long, hi long, first long, offset long")
    # A plan row meets the pieces of its length in each block of ranks that it reaches into, so a frequent length has many join keys.
    where = where.withColumn("rank_block", F.explode(F.sequence(F.floor(F.col("lo") / RANK_BLOCK), F.floor((F.col("hi") - 1) / RANK_BLOCK))))
    where = F.broadcast(where) if len(rows) <= BROADCAST_PLAN else where.hint("shuffle_hash")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "bucket")
    ranked = ranked.withColumn("rank_block", F.floor(F.col("rank") / RANK_BLOCK))
    fits = (F.col("length") == F.col("p_length")) & (ranked["rank_block"] == where["rank_block"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(where, fits).withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("lo"))
    return placed.drop("rank", "p_length", "lo", "hi", "first", ranked["rank_block"], where["rank_block"])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    Reads doc_id and text; returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is the end id alone.  Repeated rows are packed as often as they occur; a null doc_id stays null.
    A text longer than a block is tokenised in parts, so memory does not grow with it but for a single chunk without white space.
    An empty table gives an empty table.
    """
    lean_batches(docs.sparkSession)
    pieces = saved(token_pieces(document_columns(docs), tokenizer, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
