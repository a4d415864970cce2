"""A hierarchical Pitman-Yor language model of word pairs.

Every word has a restaurant of the words that follow it, and all these share one parent, the restaurant of single words, which
itself draws from an even distribution over the vocabulary and one unknown word.  A table of a child is a customer of its
parent.  A sweep of the Gibbs sampler seats the customers of every dish anew, given all others: how many tables c customers
occupy is drawn from its exact conditional, Stirling numbers times the chances of new tables.  The dishes of one sweep are
drawn side by side, given the tables of the sweep before.  Pairs that occur once always have one table and need no row: what a
restaurant owes to them follows from its counts.

The pairs are dealt to parts and the words to shards, both by hashes.  A part asks each shard once for the words of its pairs; in a sweep the shards
answer with the tables and guests of these words, and the parts draw and answer with sums for each word.  All of it travels as packed arrays.

Probabilities are averaged over the sweeps kept.  Texts reach the counts and the probabilities as packed arrays: a task sends
each part of the pairs its own array, and a part holds about PART_TOKENS tokens, however large the corpus is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import consumed, lean_batches, saved
from .textblock import BASES, LOWER, Words, blocks, mix, range_hashes, ranges, text_bytes

#: Tokens of one part of the pairs, on average.
PART_TOKENS = 1 << 20
#: Words of one shard, on average at most.
SHARD_WORDS = 1 << 16
#: So many words, the most frequent, are numbered by their rank (8 bytes each in a broadcast); any other is a hash with the highest bit set.
RANKED = 1 << 20
#: Numbers below these take two and four bytes when they travel.
SHORT, MIDDLE = (1 << 16) - 1, (1 << 32) - 1
#: A pair with more than this part of all tokens is scored where its text is; at most so many pairs can be.
HOT = 1024
#: Up to so many customers of a dish the Stirling numbers are exact; beyond, they follow their limit law.
EXACT = 256
#: So many pairs of a part are scored at a time.
JUDGED = 1 << 16
#: Numbers of the two tokens that are no words: the begin of a text (only a context) and its end.
BEGIN, END = np.uint64(0x8000000000000001), np.uint64(0x8000000000000002)
HIGH = np.uint64(1 << 63)
PACKED = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_PACKED = "part long, kind int, data binary"
#: What a packed row holds: tokens of texts, pairs, answers about words, figures of texts (these go to a part); what a part asks about the words of its pairs
#: and about all its other words, sums for words, the restaurants of words, words that occur once (these go to a shard).
TOKENS, LINKS, ANSWERS, TEXTS, ASKS, OTHERS, SUMS, STATE, SINGLES = range(9)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


# ------------------------------------------------------------------ arrays that travel


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one compressed value; frequent words take two or four bytes each, rising numbers their steps, in two bytes where they fit."""
    out = []
    for a in arrays:
        if a.dtype == np.uint64:
            short = np.minimum(a, np.uint64(SHORT)).astype(np.uint16)
            rest = a[short == SHORT]
            middle = np.minimum(rest, np.uint64(MIDDLE)).astype(np.uint32)
            far = rest[middle == MIDDLE]
            out += [b"w%d;%d;%d;" % (len(a), len(rest), len(far)), short.tobytes(), middle.tobytes(), far.tobytes()]
        elif a.dtype == np.int64 and len(a) and (a[1:] >= a[:-1]).all():
            steps = np.diff(a)
            narrow = len(a) > 1 and 0 <= steps.min() and steps.max() < 1 << 16
            out += [b"%s%d;%d;" % (b"r" if narrow else b"s", len(a), a[0]), (steps.astype(np.uint16) if narrow else steps).tobytes()]
        else:
            out += [b"%s%d;" % (a.dtype.char.encode(), len(a)), a.tobytes()]
    whole = b"".join(out)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), 0, []

    def number() -> int:
        nonlocal at
        end = raw.index(b";", at)
        value, at = int(raw[at:end]), end + 1
        return value

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(raw, kind, n, at)
        at += a.nbytes
        return a

    while at < len(raw):
        kind, at = chr(raw[at]), at + 1
        n = number()
        if kind == "w":
            some, few = number(), number()
            a = take("H", n).astype(np.uint64)
            rest = take("I", some).astype(np.uint64)
            rest[rest == MIDDLE] = take("Q", few)
            a[a == SHORT] = rest
            out.append(a)
        elif kind in "rs":
            first = number()
            out.append(np.cumsum(np.append(np.int64(first), take("H" if kind == "r" else "q", n - 1))))
        else:
            out.append(take(kind, n))
    return out


def cuts(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that brings equal parts together, and each part with its bounds in it."""
    # 16-bit numbers are sorted by their digits, several times faster.
    order = np.argsort(part.astype(np.uint16) if len(part) and 0 <= part.min() and part.max() < 1 << 16 else part, kind="stable")
    owner = part[order]
    at = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))[: len(owner)], len(owner))
    return order, list(zip(owner[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))


def packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], schema=PACKED)


def dealt(part: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One packed row for each part, its elements in the order given."""
    order, bounds = cuts(part)
    arrays = [a[order] for a in arrays]
    yield packed([(p, kind, pack(*[a[x:y] for a in arrays])) for p, x, y in bounds])


def posted(sender: int, kind: int, part: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """As dealt, with the number of the sender before the arrays."""
    order, bounds = cuts(part)
    arrays = [a[order] for a in arrays]
    return [(p, kind, pack(np.array([sender]), *[a[x:y] for a in arrays])) for p, x, y in bounds]


def apart(table: pa.Table, kind: int) -> list[list[np.ndarray]]:
    """The arrays of each packed row of one kind."""
    return [unpack(x.as_py()) for x in table.filter(pc.equal(table.column("kind"), kind)).column("data")] if table.num_rows else []


def together(table: pa.Table, kind: int, like: str) -> list[np.ndarray]:
    """The arrays of one kind that a part has been sent; `like` are the types if there are none."""
    parts = apart(table, kind)
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in like]


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Batches of numbers put together to tables of about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


# ------------------------------------------------------------------ tokens and counts


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values and the place of each value among them; only the distinct ones are sorted."""
    coded = pa.array(values).dictionary_encode()
    names = coded.dictionary.to_numpy()
    order = np.argsort(names)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return names[order], place[coded.indices.to_numpy()]


class Tokens:
    """The tokens of a block of texts with the token before each; every text ends in END."""

    def __init__(self, column: pa.Array, base: int, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        """frequent: hashes in their order, and the rank of each."""
        raw, at = text_bytes(column)
        words = Words(LOWER[raw], at)
        names, self.which = distinct(words.hashes(BASES[base]) | HIGH)
        self.words, self.hashes = words, names
        if frequent is not None:
            names = ranked(names, *frequent)
        size = words.counts() + 1
        self.first = np.append(0, np.cumsum(size))
        self.text = np.repeat(np.arange(len(size)), size)
        self.word = np.empty(int(self.first[-1]), np.uint64)
        inner = np.ones(len(self.word), bool)
        inner[self.first[1:] - 1] = False
        self.word[inner], self.word[~inner] = names[self.which], END
        self.context = np.roll(self.word, 1)
        self.context[self.first[:-1]] = BEGIN

    def one_of_each(self) -> np.ndarray:
        """Where each distinct word stands first."""
        at = np.zeros(len(self.hashes), np.int64)
        at[self.which[::-1]] = np.arange(len(self.which))[::-1]
        return at


def ranked(names: np.ndarray, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    place, hit = looked_up(hashes, names)
    return np.where(hit, ranks[place], names) if len(hashes) else names


def key_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(BASES[2]) + mix(word + np.uint64(BASES[3])))


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def summed(order_by: tuple[np.ndarray, ...], *values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Equal keys together: their columns, the sums of the values, and the group of each element.  The first column all but decides."""
    order = np.argsort(order_by[0])
    new = np.ones(len(order), bool)
    for _ in range(2):
        keys = [k[order] for k in order_by]
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        if len(keys) == 1 or np.array_equal(new[1:], keys[0][1:] != keys[0][:-1]):
            break
        order = np.lexsort(order_by[::-1])  # two different keys share the first column
    start = np.flatnonzero(new)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return [k[start] for k in keys], [np.add.reduceat(v[order], start) if len(v) else v for v in values], group


def word_counts(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(id as hash, n) of the words of the documents to learn from, and the hash that tells all of them apart."""
    for base in range(len(BASES)):
        other = BASES[(base + 1) % len(BASES)]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, "text", 1 << 22):
                t = Tokens(block.column(0), base)
                if len(t.hashes):
                    starts, size = t.words.starts[one := t.one_of_each()], t.words.ends[one] - t.words.starts[one]
                    ends = np.cumsum(size)
                    check = range_hashes(t.words.raw[ranges(starts, size)], ends - size, ends, other)
                    yield from dealt(part_of(mix(t.hashes), parts), TOKENS, t.hashes.view(np.int64), check.view(np.int64), np.bincount(t.which, minlength=len(t.hashes)))

        def add(table: pa.Table) -> pa.Table:
            word, check, n = together(table, TOKENS, "qqq")
            (word,), (n, _), group = summed((word,), n, n)
            least, most = np.full(len(word), np.iinfo(np.int64).max), np.full(len(word), np.iinfo(np.int64).min)
            np.minimum.at(least, group, check)
            np.maximum.at(most, group, check)
            return pa.table({"word": word, "n": n, "clash": least != most})

        counts = saved(docs.where("not held").select("text").mapInArrow(send, _PACKED).groupBy("part").applyInArrow(add, "word long, n long, clash boolean"), "words")
        if counts.where("clash").isEmpty() and counts.where(F.col("word").isin([int(BEGIN.view(np.int64)), int(END.view(np.int64))])).isEmpty():
            return counts.select("word", "n"), base
    raise RuntimeError("no hash tells the words of this corpus apart")


def word_sums(context: np.ndarray, word: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of pairs, and how many customers joined a table there: in the word's own restaurant, and as guests of its dish."""
    names, place = distinct(np.concatenate([context, word]))
    less, fewer = (np.bincount(x, joined, minlength=len(names)).astype(np.int64) for x in (place[: len(context)], place[len(context) :]))
    return names, less, fewer


def pair_counts(docs: DataFrame, tokens: Callable[[pa.Array], Tokens], parts: int, shards: int) -> DataFrame:
    """LINKS: the pairs (context, word, c) of a part that occur twice or more where it is learnt; c and two are their sum and how many occur twice.
    ASKS: for each shard, the words of these pairs and their sums with one table for each pair; OTHERS: all other words of the part's texts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 22):
            t = tokens(block.column(0))
            learn = ~np.asarray(block.column(1).to_pylist(), bool)
            (key, context, word), (n,), _ = summed((key_of(t.context, t.word), t.context, t.word), learn[t.text].astype(np.int64))
            yield from dealt(part_of(key, parts), TOKENS, context, word, n.astype(np.int32))

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        context, word, n = together(table, TOKENS, "QQi")
        (_, context, word), (n,), _ = summed((key_of(context, word), context, word), n.astype(np.int64))
        used, several = np.unique(np.concatenate([context, word])), np.flatnonzero(n > 1)
        several = several[np.lexsort((word[several], context[several]))]  # equal contexts side by side take little room
        context, word, n = context[several], word[several], n[several]
        names, less, fewer = word_sums(context, word, n - 1)
        others = np.setdiff1d(used, names, assume_unique=True)
        rows = [(part, LINKS, pack(context, word, n, np.ones_like(n)))]
        rows += posted(part, ASKS, part_of(mix(names), shards), names, less, fewer) + posted(part, OTHERS, part_of(mix(others), shards), others)
        figures = np.zeros((2, len(rows)), np.int64)
        figures[:, 0] = n.sum(), (n == 2).sum()
        return pa.Table.from_batches([packed(rows)]).append_column("c", pa.array(figures[0])).append_column("two", pa.array(figures[1]))

    return saved(docs.select("text", "held").mapInArrow(send, _PACKED).groupBy("part").applyInArrow(add, f"{_PACKED}, c long, two long"), "pairs")


# ------------------------------------------------------------------ seating


@lru_cache(4)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of a discount: ways of seating c customers at t tables."""
    table = np.full((EXACT + 1, EXACT + 2), -np.inf)
    table[0, 0] = 0
    t = np.arange(1, EXACT + 2)
    for c in range(EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            table[c + 1, 1:] = np.logaddexp(table[c, :-1], np.log(np.maximum(c - discount * t, 0)) + table[c, 1:])
    return table


def uniform(seed: np.ndarray) -> np.ndarray:
    """Numbers from 0 to below 1 that depend on the seeds alone: a task that runs again draws the same."""
    return (mix(seed) >> np.uint64(11)).astype(float) / (1 << 53)


def seat(seed: np.ndarray, c: np.ndarray, strength: np.ndarray, parent: np.ndarray, discount: float, ways: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers.  strength: that of the restaurant plus the discount for each table of its other dishes;
    parent: the dish's probability there."""
    t = np.minimum(c, 1)
    order = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for size, a, b in zip(range(2, EXACT + 1), bounds[:-1], bounds[1:], strict=True):
        for x in range(a, b, 1 << 14):
            own = order[x : min(b, x + (1 << 14))]
            # One row for each number of tables: there are many dishes and few tables.
            weight = np.log(strength[own] + discount * np.arange(size)[:, None]) + np.log(parent[own])
            weight = np.cumsum(weight, axis=0) + ways[size, 1 : size + 1, None]
            chance = np.cumsum(np.exp(weight - weight.max(axis=0)), axis=0)
            t[own] = 1 + (chance <= uniform(seed[own]) * chance[-1]).sum(axis=0)
    # For more customers the numbers follow their limit law, a curve over t / c ** discount that the last row of the table gives.
    size, at = EXACT, np.arange(EXACT + 1)
    factorial = np.append(0, np.cumsum(np.log(np.arange(1, size))))
    scale = lambda n: -factorial[n - 1] - (n - 1) * np.log(discount)
    curve = ways[size, 1 : size + 1] - factorial[size - 1] + discount * np.log(size) - scale(at[1:])
    curve, places = np.append(-math.lgamma(1 - discount), curve), at / size**discount
    x = bounds[-1]
    while x < len(order):
        # Rows of like sizes together, a bounded number of weights at a time.
        most = lambda k: int(min(c[order[k]], places[-1] * float(c[order[k]]) ** discount)) + 1
        y = min(len(order), x + max(1, (1 << 18) // most(x)))
        y = min(y, max(x + 1, x + (1 << 19) // most(y - 1)))
        own, n = order[x:y], np.arange(1, most(y - 1) + 1)
        if len(factorial) < n[-1]:
            factorial = np.append(0, np.cumsum(np.log(np.arange(1, 2 * n[-1]))))
        weight = np.cumsum(np.log(strength[own, None] + discount * (n - 1)), axis=1) + np.log(parent[own, None]) * n
        weight += scale(n) + np.interp(n / (c[own, None].astype(float) ** discount), places, curve, right=-np.inf)
        chance = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        t[own] = 1 + (chance <= uniform(seed[own])[:, None] * chance[:, -1:]).sum(axis=1)
        x = y
    return t


def seeds(sweep: int, *columns: np.ndarray) -> np.ndarray:
    """What xxhash64 makes of the sweep and of 64-bit columns: a seed for each row."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def ended(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * two
        x = (x ^ (x >> np.uint64(29))) * three
        return x ^ (x >> np.uint64(32))

    out = ended(turned((np.array([42], np.uint64) + five + np.uint64(4)) ^ (np.array([sweep], np.uint64) * one), 23) * two + three)
    for x in columns:
        out = ended(turned((out + five + np.uint64(8)) ^ (turned(x * two, 31) * one), 27) * one + four)
    return out


def discount_of(once: int, twice: int) -> float:
    """The usual estimate from how many types occur once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


@dataclass
class Root:
    """The restaurant of single words in each sweep kept: what a word with so many guests at so many tables has as its chance."""

    discount: float
    shared: list[float]
    total: list[float]

    def chance(self, sweep: int, guests, seats):
        return (guests - self.discount * seats + self.shared[sweep]) / self.total[sweep]


def seated_words(sweep: int, root: Root, root_tables: int, strength: float, even: float, keep: bool, reply: bool):
    """A shard: what its words owe to the pairs, and their tables at the root drawn anew; answers to all parts that ask.  Without a discount of the root
    nothing is drawn; the figures then tell how many words have one customer, two, and any, else how many customers and tables there are."""

    def task(table: pa.Table) -> pa.Table:
        shard = table.column("part")[0].as_py()
        word, n, m, t, tables, customers, *history = together(table, STATE, "Qqqqqq")
        if len(word) and not (word[1:] > word[:-1]).all():
            order = np.argsort(word)
            word, n, m, t, tables, customers, *history = (x[order] for x in (word, n, m, t, tables, customers, *history))
        asks = apart(table, ASKS)
        sums = together(table, SUMS, "Qqq") if sweep else [np.concatenate(x) for x in zip(*(x[1:] for x in asks), strict=True)] or [np.zeros(0, k) for k in "Qqq"]
        if len(sums[0]):
            place = np.searchsorted(word, sums[0])
            tables, customers = (x - np.bincount(place, y, minlength=len(word)).astype(np.int64) for x, y in ((m, sums[1]), (n, sums[2])))
        if root.discount is None:
            figures = [(customers == 1).sum(), (customers == 2).sum(), np.minimum(customers, 1).sum()]
        else:
            t = seat(seeds(sweep, word), customers, strength + root.discount * (root_tables - t), np.full(len(word), even), root.discount, stirling(root.discount))
            figures = [customers.sum(), t.sum(), 0]
        if keep:
            history += [tables, customers, t]
        rows = [(shard, STATE, pack(word, n, m, t, tables, customers, *history))]
        if reply:
            for (part,), names, *_ in asks:
                place = np.searchsorted(word, names)
                rows.append((int(part), ANSWERS, pack(names, *[x[place] for x in (tables, customers, t)])))
        out = pa.Table.from_batches([packed(rows)])
        for name, x in zip("xyz", figures, strict=True):
            out = out.append_column(name, pa.array([int(x)] + [0] * (len(rows) - 1), pa.int64()))
        return out

    return task


def seated_pairs(sweep: int, root: Root, d: float, strength: float, keep: bool, shards: int):
    """A part: the tables of its pairs drawn anew, given what the shards have answered; sums for the words."""

    def task(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        context, word, c, now, *drawn = together(table, LINKS, "QQqq")
        ids, tables, guests, seats = together(table, ANSWERS, "Qqqq")
        order = np.argsort(ids)
        of_context, of_word = (order[np.searchsorted(ids[order], x)] for x in (context, word))
        parent = (guests - root.discount * seats + root.shared[-1]) / root.total[-1]
        t = seat(seeds(sweep, context, word), c, strength + d * (tables[of_context] - now), parent[of_word], d, stirling(d))
        names, less, fewer = word_sums(context, word, c - t)
        rows = [(part, LINKS, pack(context, word, c, t, *drawn, *[t] * keep))]
        for shard, x, y in (found := cuts(part_of(mix(names), shards)))[1]:
            rows.append((shard, SUMS, pack(*[v[found[0][x:y]] for v in (names, less, fewer)])))
        return pa.Table.from_batches([packed(rows)])

    return task


def flat_pairs(kept: int, more_than: int = 0):
    """Packed pairs as rows (context, word, c, t): those that occur more often."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for context, word, c, _, *t in apart(pa.Table.from_batches([batch]), LINKS):
                some = c > more_than
                drawn = pa.FixedSizeListArray.from_arrays(np.stack([x[some] for x in t], axis=1).ravel(), kept).cast(pa.list_(pa.int64()))
                yield from pa.table({"context": context[some].view(np.int64), "word": word[some].view(np.int64), "c": c[some], "t": drawn}).to_batches(1 << 16)

    return task


def flat_words(kept: int):
    """Packed restaurants as rows (word, n, m, stood, guests, seats)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n, m, _, _, _, *history in apart(pa.Table.from_batches([batch]), STATE):
                lists = [pa.FixedSizeListArray.from_arrays(np.stack(history[k::3], axis=1).ravel(), kept).cast(pa.list_(pa.int64())) for k in range(3)]
                yield from pa.table({"word": word.view(np.int64), "n": n, "m": m, "stood": lists[0], "guests": lists[1], "seats": lists[2]}).to_batches(1 << 16)

    return task


def sample(words: DataFrame, pairs: DataFrame, shards: int, total: int, vocabulary: int, singles: int, strength: float, burn_in: int, kept: int) -> tuple[DataFrame, DataFrame, float, Root, DataFrame, DataFrame]:
    """Gibbs sweeps over both levels.  words: packed restaurants of the words that occur more than once, pairs: what pair_counts returns;
    `singles` words occur once: they have one customer and one table, whatever else is drawn.

    Returns the words with m, and for each sweep kept how many tables stood in their own restaurants, how many guests they had at the root and at how
    many tables; the pairs with their tables t; the discount of the pairs, and the root; the packed words and pairs.
    """
    sums = pairs.agg(F.sum("c").alias("c"), F.sum("two").alias("two")).first()
    d = discount_of(total - (sums.c or 0), sums.two or 0)
    even = 1.0 / (vocabulary + 1)
    kind = lambda table, k: table.where(F.col("kind") == k).select("part", "kind", "data")
    union = lambda *tables: reduce(DataFrame.unionByName, tables).groupBy("part")
    asks, told, linked = kind(pairs, ASKS), f"{_PACKED}, x long, y long, z long", pairs
    root, figures = Root(None, [], []), ["x", "y", "z"]
    count = lambda table: [x or 0 for x in table.agg(*[F.sum(k) for k in figures]).first()]
    state = saved(union(words, asks).applyInArrow(seated_words(0, root, 0, strength, even, False, False), told), "restaurants")
    once, twice, some = count(state)
    root.discount, root_tables = discount_of(once + singles, twice), some + singles
    for sweep in range(burn_in + kept + 1):
        keep, last, spent = sweep > burn_in, sweep == burn_in + kept, [state]
        sent = [kind(state, STATE)] if last else [kind(state, STATE), asks]
        if sweep:
            # The dishes of all restaurants, given how many tables stand there and how likely the parent finds the dish.
            spent += [linked] if linked is not pairs else []
            linked = saved(union(kind(linked, LINKS), kind(state, ANSWERS)).applyInArrow(seated_pairs(sweep, now, d, strength, keep, shards), _PACKED), "links")
            sent.append(kind(linked, SUMS))
        # A restaurant has a table for each customer but those who joined one; its tables are the parent's customers.
        state = saved(union(*sent).applyInArrow(seated_words(sweep, root, root_tables, strength, even, keep, not last), told), "restaurants")
        customers, tables, _ = count(state)
        root_tables = tables + singles
        now = Root(root.discount, [(strength + root.discount * root_tables) * even], [strength + customers + singles])
        if keep:
            root.shared += now.shared
            root.total += now.total
        consumed(*spent)
    state, linked = kind(state, STATE), kind(linked, LINKS)
    lists = "array<long>"
    flat = state.mapInArrow(flat_words(kept), f"word long, n long, m long, stood {lists}, guests {lists}, seats {lists}")
    return flat, linked.mapInArrow(flat_pairs(kept), f"context long, word long, c long, t {lists}"), d, root, state, linked


# ------------------------------------------------------------------ probabilities


def log_probability(c: np.ndarray, t: np.ndarray, m: np.ndarray, tables: np.ndarray, parent: np.ndarray, d: float, strength: float) -> np.ndarray:
    """log10 of the probability of a word in a context, averaged over sweeps (columns): c of the pair, its tables, m of the context and its tables, the word's own probability."""
    return np.log10(((c[:, None] - d * t + (strength + d * tables) * parent) / (strength + m[:, None])).mean(axis=1))


def looked_up(sorted_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(sorted_ids, ids).clip(max=max(0, len(sorted_ids) - 1))
    return place, (sorted_ids[place] == ids) if len(sorted_ids) else np.zeros(len(ids), bool)


def language_model_scores(docs: DataFrame, held: Column | None = None, strength: float = 1.0, burn_in: int = 1, kept: int = 2) -> DataFrame:
    """Score every whole text by a model learnt from those that are not held out.

    Reads doc_id and text; `held` says which rows are held out (by default crc32 of doc_id as text, modulo 10, is 0; a row without a doc_id is not, nor one for which `held` is null).
    Tokens are words (A-Z lower-cased) and one end for each text.  Returns doc_id, held_out, n_tokens, n_known (tokens that occur where it
    is learnt), train_tokens, base_score (add-0.1 frequencies of single words) and score, the model's log10 probability of the text;
    10 ** (-score / n_tokens) is its perplexity.  The probabilities of all words learnt and one unknown word sum to one in every context.
    A null, empty or blank text has one token, its end.  Repeated rows are learnt from and scored each; other columns are not looked at.  With
    nothing to learn from all is unknown, with probability one.  Draws depend on the words alone, not on partitions;
    only the order of sums may change the last digits of a score.  One very long text is tokenised whole by one task, with some 100 bytes for each word; its
    pairs are dealt out like all others.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    held = held_out(F.col("doc_id")) if held is None else F.coalesce(held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted, base = word_counts(docs, 4 * tasks)
    facts = counted.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    learnt = docs.where("not held").count()
    total, vocabulary = (facts.n or 0) + learnt, facts.v + (learnt > 0)
    parts, shards = max(tasks, total // PART_TOKENS + 1), max(tasks, vocabulary // SHARD_WORDS + 1)
    # At most RANKED rows, whatever the corpus.
    top = counted.orderBy(F.col("n").desc(), "word").limit(RANKED).select("word", "n").toArrow()
    top = top.take(pc.sort_indices(top, [("n", "descending"), ("word", "ascending")])).column("word").to_numpy().view(np.uint64)
    by_hash = np.argsort(top)
    shared = spark.sparkContext.broadcast((top[by_hash], by_hash.astype(np.uint64)))
    tokens = lambda column: Tokens(column, base, shared.value)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Restaurants, and words that occur once, to their shards.  At first each has one table, and a table for each customer."""
        for table in gathered(batches):
            word, n, m = (table.column(k).to_numpy() for k in ("word", "n", "m"))
            word = ranked(word.view(np.uint64), *shared.value)
            order = np.argsort(word)
            word, n, m = word[order], n[order], m[order]
            alone = (n == 1) & (m == 1)
            shard, several = part_of(mix(word), shards), ~alone
            yield from dealt(shard[several], STATE, *[x[several] for x in (word, n, m, np.ones_like(n), m, n)])
            yield from dealt(shard[alone], SINGLES, word[alone])

    edges = spark.createDataFrame([(int(BEGIN.view(np.int64)), 0, learnt), (int(END.view(np.int64)), learnt, 0)], "word long, n long, m long").where("n + m > 0")
    words = saved(counted.select("word", "n", F.col("n").alias("m")).unionByName(edges).mapInArrow(send_words, _PACKED), "words")
    found = pair_counts(docs, tokens, parts, shards)
    singles = facts.v - counted.where("n > 1").count()
    restaurants, _, d, root, state, linked = sample(words.where(F.col("kind") == STATE), found, shards, total, vocabulary, singles, strength, burn_in, kept)

    # A pair may be most of the corpus: such pairs are scored where the texts are, the others are dealt out.
    hot = F.broadcast(linked.mapInArrow(flat_pairs(kept, total // HOT), "context long, word long, c long, t array<long>"))
    hot = restaurants.select(F.col("word").alias("context"), "m", "stood").join(hot, "context")
    hot = restaurants.select("word", "n", "guests", "seats").join(F.broadcast(hot), "word").collect()

    def score_of(c, t, m, tables, guests, seats) -> np.ndarray:
        wide = [np.asarray(x, float).reshape(-1, kept) for x in (t, tables, guests, seats)]
        parent = np.stack([root.chance(k, wide[2][:, k], wide[3][:, k]) for k in range(kept)], axis=1)
        return log_probability(np.asarray(c, float), wide[0], np.asarray(m, float), wide[1], parent, d, strength)

    base_of = lambda n: np.log10((n + 0.1) / (total + 0.1 * (vocabulary + 1)))
    hot_context, hot_word = (np.array([r[k] for r in hot], np.int64).view(np.uint64) for k in ("context", "word"))
    hot_key = key_of(hot_context, hot_word)
    hot_score = score_of([r.c for r in hot], [r.t for r in hot], [r.m for r in hot], [r.stood for r in hot], [r.guests for r in hot], [r.seats for r in hot])
    hot_base = base_of(np.array([r.n for r in hot], float))
    order = np.argsort(hot_key)
    hot_table = spark.sparkContext.broadcast([x[order] for x in (hot_key, hot_context, hot_word, hot_score, hot_base)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_, context_, word_, score_, base_ = hot_table.value
        for block in blocks(batches, "text", 1 << 22):
            t = tokens(block.column(0))
            row, doc, away = (np.asarray(block.column(k).fill_null(0)).astype(np.int64) for k in (1, 2, 3))
            facts = away + 2 * np.asarray(block.column(2).is_null()).astype(np.int64)
            key = key_of(t.context, t.word)
            place, hit = looked_up(key_, key)
            if len(key_):
                hit &= (context_[place] == t.context) & (word_[place] == t.word)
            near = [np.bincount(t.text[hit], x, minlength=len(row)) for x in (np.ones(hit.sum()), base_[place[hit]], score_[place[hit]])]
            yield from dealt(part_of(mix(row.view(np.uint64)), parts), TEXTS, row, near[0].astype(np.int64), near[1], near[2], doc, facts, np.diff(t.first))
            rest = ~hit
            yield from dealt(part_of(key[rest], parts), TOKENS, t.context[rest], t.word[rest], 2 * row[t.text[rest]] + 1 - away[t.text[rest]])

    def answer(table: pa.Table) -> pa.Table:
        """What the parts have asked a shard of the words for."""
        ids, n, m, _, _, _, *history = together(table, STATE, "Qqqqqq" + "q" * 3 * kept)
        (single,) = together(table, SINGLES, "Q")
        ones = np.ones(len(single), np.int64)
        ids = np.concatenate([ids, single])
        order = np.argsort(ids)
        ids, values = ids[order], [np.concatenate([x, ones])[order] for x in (n, m, *history[0::3], *history[1::3], *history[2::3])]
        rows = []
        for (part,), names, *_ in apart(table, ASKS) + apart(table, OTHERS):
            place, hit = looked_up(ids, names)
            rows.append((int(part), ANSWERS, pack(names[hit], *[x[place[hit]] for x in values])))
        return pa.Table.from_batches([packed(rows)])

    def judge(table: pa.Table) -> pa.Table:
        context, word, row = together(table, TOKENS, "QQq")
        (key, context, word), (learnt_here,), group = summed((key_of(context, word), context, word), row & 1)
        known_context, known_word, known_c, _, *known_t = together(table, LINKS, "QQqq" + "q" * kept)
        known_key = key_of(known_context, known_word)
        by_key = np.argsort(known_key)
        sorted_key = known_key[by_key]
        ids, n, m, *values = together(table, ANSWERS, "Qqq" + "q" * 3 * kept)
        order = np.argsort(ids)
        ids, n, m, values = ids[order], n[order], m[order], [v[order] for v in values]
        (of_context, has_context), (of_word, has_word) = ([x[which] for x in looked_up(ids, names)] for names, which in map(distinct, (context, word)))
        # What is unknown has been seen by nobody: no count, no table, no guest.
        pick = lambda v, at, has: np.where(has, v[at], 0) if len(v) else np.zeros(len(has))
        owner, mine = distinct(row >> 1)
        figures = np.zeros((3, len(key)))
        # Some pairs at a time: their figures of all sweeps side by side take many times the room of the pairs.
        for x in range(0, len(key), JUDGED):
            own = slice(x, x + JUDGED)
            seen = np.minimum(learnt_here[own], 1)
            c, t = seen.astype(float), np.repeat(seen[:, None], kept, axis=1).astype(float)
            place, hit = looked_up(sorted_key, key[own])
            place = by_key[place[hit]] if len(by_key) else place[hit]
            # Keys that two pairs share are rare; they are told apart one by one.
            same = (known_context[place] == context[own][hit]) & (known_word[place] == word[own][hit])
            where = np.flatnonzero(hit)
            for k in np.flatnonzero(~same):
                real = np.flatnonzero((known_context == context[own][where[k]]) & (known_word == word[own][where[k]]))
                if len(real):
                    place[k], same[k] = real[0], True
            where, place = where[same], place[same]
            c[where] = known_c[place]
            for k in range(kept):
                t[where, k] = known_t[k][place]
            at_context, at_word = (of_context[own], has_context[own]), (of_word[own], has_word[own])
            tables = np.stack([pick(v, *at_context) for v in values[:kept]], axis=1)
            guests, seats = (np.stack([pick(v, *at_word) for v in values[a : a + kept]], axis=1) for a in (kept, 2 * kept))
            count = pick(n, *at_word)
            figures[:, own] = count > 0, base_of(count), score_of(c, t, pick(m, *at_context), tables, guests, seats)
        sums = [np.bincount(mine, x[group], minlength=len(owner)) for x in figures]
        near, known, near_base, near_score, *meta = together(table, TEXTS, "qqddqqq")
        some = known > 0
        rows = [(owner, near[some]), (sums[0].astype(np.int64), known[some]), (sums[1], near_base[some]), (sums[2], near_score[some])]
        out = [np.concatenate(x) for x in rows]
        # The model's share of a part is small: single precision keeps seven digits of it.
        out[1], out[3] = out[1].astype(np.int32), out[3].astype(np.float32)
        return pa.Table.from_batches([*dealt(out[0] >> 12, 0, *out), *dealt(near >> 12, 1, near, *meta)], schema=PACKED)

    def finish(table: pa.Table) -> pa.Table:
        row, known, base_score, score = together(table, 0, "qidf")
        owner, doc, facts, size = together(table, 1, "qqqq")
        order = np.argsort(owner)
        mine = np.searchsorted(owner[order], row)
        sums = [np.bincount(mine, x, minlength=len(owner)) for x in (known, base_score, score)]
        doc, facts, size = doc[order], facts[order], size[order]
        columns = {"doc_id": pa.array(doc, mask=facts >= 2), "held_out": pa.array(facts % 2 == 1), "n_tokens": size, "n_known": sums[0].astype(np.int64), "train_tokens": np.full(len(doc), total), "base_score": sums[1], "score": sums[2]}
        return pa.table(columns)

    numbered = docs.select("text", F.monotonically_increasing_id().alias("row"), "doc_id", F.col("held").cast("long").alias("held"))
    asked = found.where(F.col("kind").isin(ASKS, OTHERS)).select("part", "kind", "data")
    answers = asked.unionByName(words.where(F.col("kind") == SINGLES)).unionByName(state).groupBy("part").applyInArrow(answer, _PACKED)
    sent = numbered.mapInArrow(send, _PACKED).unionByName(linked).unionByName(answers)
    judged = sent.groupBy("part").applyInArrow(judge, _PACKED)
    return judged.groupBy("part").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
