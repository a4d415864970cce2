"""Verification of quotations against a corpus.

A quotation meets the texts that share its rare word sequences: sequences of `gram` words are joined by their hash, each
quotation keeps those that occur least, and what they hit is a candidate with the diagonal on which it lies.  Each candidate is
then aligned word by word in a band about its diagonals, and the best alignment of a quotation (all of its words in their order, else the
best piece) decides its verdict.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions import text as T

#: Texts and sequences of quotations: so many are broadcast at most (a number, 16 bits of a sieve each); beyond, both sides are shuffled.
BROADCAST_IDS, BROADCAST_GRAMS = 1 << 20, 1 << 23
#: Bits of the largest sieve (16 MB), and words that are cut into sequences together.
SIEVE, CUT = 1 << 27, 1 << 20
#: Quotations that are broadcast to their places at most; beyond, they are shuffled.
BROADCAST_QUOTES = 1 << 14
#: So many places of a quotation, those with the most anchors, are aligned before the others are looked at.
FIRST = 4
#: Diagonals of one candidate, and how many words an alignment may leave out or put in beyond them.
DIAGONALS, SLACK = 64, 64
MATCH, MISS = 2, -1
#: Cells of the alignments that are made together.
CELLS = 1 << 22
VERDICTS = ("verified", "wording differs", "incomplete", "wrong reference", "not found")


def tokens_of(text: Column) -> Column:
    """The words of the normal form."""
    bare = F.regexp_replace(T.folded(text), "[^\\p{L}\\p{N}\\s]", "")
    return F.filter(F.split(bare, "\\s+"), lambda w: w != "")


def cut(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n words that follow each other."""
    last = len(hashes) - n + 1
    out = hashes[:last].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : last + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def grams_of(rows: DataFrame, key: str, n: int, sieve: Broadcast | None = None) -> DataFrame:
    """(key, gram, places) for each sequence of n words in a row and all its places there, of those that the sieve lets through; rows have key and words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.columns
            ends = lists.offsets.to_numpy()
            x = 0
            while x < len(keys):
                # Some rows at a time, of one long text all words.
                y = max(x + 1, int(np.searchsorted(ends, ends[x] + CUT, side="right")) - 1)
                words = lists.values.to_numpy()[ends[x] : ends[y]].view(np.uint64)
                size = np.diff(ends[x : y + 1])
                row = np.repeat(np.arange(x, y), size)
                pos = np.arange(len(words)) - (ends[row] - ends[x])
                at = np.flatnonzero(pos + n <= size[row - x])
                gram = cut(words, n)[at] if len(at) else words[:0]
                if sieve is not None:
                    bits = sieve.value
                    for shift in (0, 32):
                        place = (gram >> np.uint64(shift)) & np.uint64(64 * len(bits) - 1)
                        through = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                        at, gram = at[through], gram[through]
                # Stable sorts: places stay in their order.
                order = np.argsort(gram, kind="stable")
                order = order[np.argsort(row[at][order], kind="stable")]
                at, gram = at[order], gram[order]
                owner = row[at]
                new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))[: len(at)])
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(pos[at].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner[new])), pa.array(gram[new].view(np.int64)), places], names=[key, "gram", "places"])
                x = y

    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("gram", LongType()), StructField("places", ArrayType(IntegerType()))])
    return rows.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")).mapInArrow(task, schema)


def sieve_of(grams: DataFrame, n: int) -> Broadcast:
    """Two bits for each of about n sequences, broadcast: others get through by chance, the less the more bits there are."""
    bits = min(SIEVE, 1 << (16 * n + 64).bit_length())
    place = F.col("place").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    places = grams.select(F.explode(F.array("gram", F.shiftrightunsigned("gram", 32))).alias("place"))
    words = places.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return grams.sparkSession.sparkContext.broadcast(out)


def kept(df: DataFrame) -> DataFrame:
    """The same rows, made once and read from then on; the table goes when the driver ends."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/quotes-{uuid.uuid4().hex}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(where.toString())
    return spark.read.schema(df.schema).parquet(where.toString())


def hit_only(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The documents that hits (kept()) name, before any work on the texts of the others."""
    ids = hits.select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def nothing(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def anchored(quotes: DataFrame, texts: DataFrame, gram: int, anchors: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each length of sequences: (item_id, gram, q), a quotation's anchors, and (doc_id, gram, places), where sequences of quotations lie.

    quotes is read often (kept()).  Quotations of fewer than `gram` words are looked for whole.
    """
    lengths = quotes.where(F.size("words") > 0).select(F.least(F.size("words"), F.lit(gram)).alias("n")).distinct()
    for n in sorted(r.n for r in lengths.collect()):
        own = quotes.where(F.size("words") == n if n < gram else F.size("words") >= n)
        asked = kept(grams_of(own, "item_id", n).select("item_id", "gram", F.explode("places").alias("pos")))
        size = asked.count()
        # The texts are cut into sequences once; what is left is counted, then looked up.
        places = grams_of(texts, "doc_id", n, sieve_of(asked, size))
        places = kept(places if size <= BROADCAST_GRAMS else places.join(asked, "gram", "left_semi"))
        often = places.groupBy("gram").agg(F.sum(F.size("places")).alias("n"))
        rare = F.row_number().over(Window.partitionBy("item_id").orderBy("n", "pos"))
        yield asked.join(often, "gram").withColumn("_rn", rare).where(F.col("_rn") <= anchors).select("item_id", "gram", F.col("pos").alias("q")), places


def hits_of(quotes: DataFrame, texts: DataFrame, gram: int, anchors: int) -> DataFrame:
    """(item_id, doc_id, at): places where an anchor of a quotation lies, as that of the quotation's first word."""
    found = [chosen.join(places, "gram").select("item_id", "doc_id", F.explode(F.transform("places", lambda p: p - F.col("q"))).alias("at")).distinct() for chosen, places in anchored(quotes, texts, gram, anchors)]
    return reduce(DataFrame.unionByName, found) if found else nothing(quotes, "item_id bigint, doc_id bigint, at int")


def blocks_of(quotes: DataFrame, texts: DataFrame, gram: int, anchors: int) -> DataFrame:
    """(item_id, doc_id, block, votes): blocks of diagonals on which anchors of a quotation lie, and how many."""
    found = []
    for chosen, places in anchored(quotes, texts, gram, anchors):
        reach = F.array_distinct(F.transform("places", lambda p: F.floor((p - F.col("q")) / DIAGONALS).cast("int")))
        # A sequence that a text repeats is met once, with all its places.
        hit = chosen.join(places, "gram").select("item_id", "doc_id", F.explode(reach).alias("block"))
        found.append(hit.groupBy("item_id", "doc_id", "block").agg(F.count(F.lit(1)).alias("votes")))
    return reduce(DataFrame.unionByName, found) if found else nothing(quotes, "item_id bigint, doc_id bigint, block int, votes bigint")


def verify(quotes: DataFrame, docs: DataFrame, gram: int = 4) -> DataFrame:
    """For each quotation whether a document has it exactly, up to case and punctuation, or not at all.

    quotes: item_id, text; docs: doc_id, text.  Returns item_id, verdict, documents (that have its normal form) and
    first_doc.  A quotation without words is in no document, a null text is no quotation.
    """
    quotes = kept(quotes.where("text is not null").select("item_id", "text", tokens_of(F.col("text")).alias("words")))
    docs = docs.where("text is not null").select("doc_id", "text")
    tokenised = lambda rows: rows.select("doc_id", "text", tokens_of(F.col("text")).alias("words"))
    # One rare sequence is enough: where it is not, the quotation cannot be.
    hits = kept(hits_of(quotes, tokenised(docs), gram, 1).where("at >= 0"))
    asked = quotes.select("item_id", F.col("text").alias("quote"), F.col("words").alias("asked"))
    both = hits.join(asked, "item_id").join(tokenised(hit_only(docs, hits)), "doc_id")
    same = both.where(F.slice("words", F.col("at") + 1, F.size("asked")) == F.col("asked"))
    by_doc = same.groupBy("item_id", "doc_id").agg(F.max(F.col("text").contains(F.col("quote"))).alias("exact"))
    counts = by_doc.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("exact").alias("exact"), F.min("doc_id").alias("first_doc"))
    joined = quotes.select("item_id").join(counts, "item_id", "left")
    verdict = F.when(F.col("exact"), "exact").when(F.col("documents") > 0, "normalised").otherwise("none")
    return joined.select("item_id", verdict.alias("verdict"), F.coalesce("documents", F.lit(0)).alias("documents"), "first_doc")


def aligned(quotes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Local alignments of quotations (rows of numbers, filled up with -2) with their windows (filled up with -1), in a band: word i of
    a quotation meets the places i .. i + width - 1 of its window, which is as much longer.  Score, words matched, first and end place.

    Row i of the band holds the best score that ends at word i and place i + k; a word left out or put in costs as much as one that differs.
    """
    rows, n = quotes.shape
    width = windows.shape[1] - n
    steps = np.arange(width, dtype=np.int32)
    score, came = np.zeros((rows, width + 1), np.int32), np.zeros((n, rows, width), np.int8)
    best, last, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(n):
        same = windows[:, i : i + width] == quotes[:, i : i + 1]
        diagonal = score[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISS))
        skipped = score[:, 1:] + MISS  # a word of the quotation that the text has not
        here = np.maximum(np.maximum(diagonal, skipped), 0)
        # Words of the text that the quotation has not: the best of all before, less one for each.
        here = np.maximum(np.maximum.accumulate(here - MISS * steps, axis=1) + MISS * steps, 0)
        came[i] = np.where(here == 0, 0, np.where(here == diagonal, np.where(same, 1, 2), np.where(here == skipped, 3, 4)))
        score[:, :-1] = here
        k = here.argmax(axis=1)
        top = here[np.arange(rows), k]
        better = top > best
        best, last, end = np.where(better, top, best), np.where(better, i, last), np.where(better, k, end)
    i, k, matched, first = last.copy(), end.copy(), np.zeros(rows, np.int64), last + end
    open_ = np.flatnonzero(best > 0)
    while len(open_):
        step = came[i[open_], open_, k[open_]]
        open_, step = open_[step > 0], step[step > 0]
        level = step <= 2
        matched[open_] += step == 1
        first[open_[level]] = i[open_[level]] + k[open_[level]]
        i[open_] -= step <= 3
        k[open_] += np.where(step == 3, 1, np.where(step == 4, -1, 0))
        open_ = open_[(i[open_] >= 0) & (k[open_] >= 0) & (k[open_] < width)]
    return best, matched, first, last + end + 1


def in_order(quotes: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at which all words of a quotation stand in their order with the fewest words between them, in the band of aligned():
    how many are between (-1: they stand nowhere so, or more than SLACK are), first and end place.

    Row i of the band holds, for word i at place i + k, the last place at which the first word can be.
    """
    rows, n = quotes.shape
    width = windows.shape[1] - n
    places = np.arange(width)
    start = np.where(windows[:, :width] == quotes[:, :1], places, -1)
    for i in range(1, n):
        here = np.where(windows[:, i : i + width] == quotes[:, i : i + 1], np.maximum.accumulate(start, axis=1), -1)
        start = np.where((i < sizes)[:, None], here, start)
    between = np.where(start < 0, width, places - start)
    k = between.argmin(axis=1)
    least = between[np.arange(rows), k]
    return np.where(least <= min(SLACK, width - 1), least, -1), start[np.arange(rows), k], sizes + k


def filled(codes: np.ndarray, offsets: np.ndarray, own: np.ndarray, width: int, empty: int) -> np.ndarray:
    """Lists of numbers (codes between two offsets) as rows of a table, filled up."""
    size, steps = np.diff(offsets)[own], np.arange(width)
    inside = steps < size[:, None]
    out = np.full(inside.shape, empty, np.int32)
    out[inside] = codes[(offsets[own][:, None] + steps)[inside]]
    return out


def _judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of like lengths are aligned together, a bounded number of cells at a time."""
    width = DIAGONALS + 2 * SLACK
    for part in parts:
        item, doc, low = (part.column(k).to_numpy() for k in ("item_id", "doc_id", "low"))
        asked, words = part.column("asked"), part.column("words")
        codes = pa.concat_arrays([asked.flatten(), words.flatten()]).dictionary_encode().indices.to_numpy()
        # flatten() leaves out what lies before the first offset.
        quoted, there = (x.offsets.to_numpy() - x.offsets[0].as_py() for x in (asked, words))
        there = there + quoted[-1]
        order, a = np.argsort(np.diff(quoted), kind="stable"), 0
        sizes = np.diff(quoted)[order]
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * int(sizes[b]) * width <= CELLS:
                b += 1
            own, n = order[a:b], sizes[a:b]
            quotes, windows = filled(codes, quoted, own, int(n[-1]), -2), filled(codes, there, own, int(n[-1]) + width, -1)
            score, matched, first, end = aligned(quotes, windows)
            # The best piece may leave off words that stand further on: all words in their order go before it.
            rest = np.flatnonzero(matched < n)
            if len(rest):
                between, start, stop = in_order(quotes[rest], n[rest], windows[rest])
                rest, ok = rest[between >= 0], between >= 0
                score[rest], matched[rest], first[rest], end[rest] = MATCH * n[rest] + MISS * between[ok], n[rest], start[ok], stop[ok]
            figures = {"score": score, "matched": matched, "first": low[own] + first, "end": low[own] + end}
            yield pa.RecordBatch.from_pydict({"item_id": item[own], "doc_id": doc[own]} | {k: x.astype(np.int32) for k, x in figures.items()})
            a = b


def aligned_with(places: DataFrame, quotes: DataFrame, texts: DataFrame, room: Column | None = None) -> DataFrame:
    """(item_id, doc_id, score, matched, first, end): the best alignment of each place (item_id, doc_id, block).  room: so many different
    words of a quotation may be missing about a place, else it is passed over."""
    low = F.col("block") * DIAGONALS - SLACK
    own, here = quotes.select("item_id", F.col("words").alias("asked")).join(places.select("item_id").distinct(), "item_id", "left_semi"), hit_only(texts, places)
    # Few quotations reach the places after the texts do, and are not moved for each place.
    both = places.join(here, "doc_id").join(F.broadcast(own), "item_id") if own.count() <= BROADCAST_QUOTES else places.join(own, "item_id").join(here, "doc_id")
    # Only the words in reach travel on; those before the text are made up for by empty ones.
    size = F.size("asked") + DIAGONALS + 2 * SLACK
    window = F.concat(F.array_repeat(F.lit(""), F.greatest(-low, F.lit(0))), F.slice("words", F.greatest(low, F.lit(0)) + 1, F.greatest(size + F.least(low, F.lit(0)), F.lit(0))))
    both = both if room is None else both.where(F.size(F.array_except("asked", window)) <= room)
    return both.select("item_id", "doc_id", low.alias("low"), "asked", window.alias("words")).mapInArrow(_judge, "item_id bigint, doc_id bigint, score int, matched int, first int, end int")


def standing(places: DataFrame, quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """As aligned_with(), for the first place in each text of (item_id, doc_id) at which a quotation stands in one piece."""
    pairs = places.join(quotes.select("item_id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("quote"), F.size("words").alias("n")), "item_id")
    text = hit_only(texts, places).select("doc_id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("all"))
    before = F.substring("all", F.lit(1), F.col("at") - 1)
    first = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    found = pairs.join(text, "doc_id").withColumn("at", F.instr(F.col("all"), F.col("quote"))).where("at > 0")
    return found.select("item_id", "doc_id", (MATCH * F.col("n")).alias("score"), F.col("n").alias("matched"), first.alias("first"), (first + F.col("n")).alias("end"))


def promising(places: DataFrame, quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """The places (item_id, doc_id, block, n, room) about which no more than room of the quotation's words are missing, as far as its first
    words in the order of how few quotations have them tell: more than room of them, repeats included.  Any choice of words is sound."""
    words = quotes.select("item_id", F.explode("words").alias("word")).groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("times"))
    often = words.groupBy("word").agg(F.sum("times").alias("n"))
    own, item = words.join(places.select("item_id", "room").distinct(), "item_id"), Window.partitionBy("item_id")
    before = F.sum("times").over(item.orderBy("n", "word").rowsBetween(Window.unboundedPreceding, -1))
    rare = own.join(often, "word").withColumn("before", F.coalesce(before, F.lit(0))).where("before <= room").withColumn("asked", F.sum("times").over(item))
    keys = kept(grams_of(rare.select(F.struct("item_id", "times", "asked").alias("of"), F.array("word").alias("words")), "of", 1).select("of.*", "gram"))
    spots = grams_of(texts, "doc_id", 1, sieve_of(keys, keys.count()))
    low = F.col("block") * DIAGONALS - SLACK
    here = F.size(F.filter("places", lambda p: (p >= low) & (p < low + F.col("n") + DIAGONALS + 2 * SLACK)))
    found = places.join(keys, "item_id").join(spots, ["gram", "doc_id"]).groupBy("item_id", "doc_id", "block", "n", "room", "asked").agg(F.sum(F.least("times", here)).alias("found"))
    return found.where("found >= asked - room").select("item_id", "doc_id", "block", "n", "room")


def verdicts(quotes: DataFrame, docs: DataFrame, gram: int = 3, anchors: int = 8, least: float = 0.6) -> DataFrame:
    """One verdict for each quotation, with the place that it comes from.

    quotes: item_id, text and cited (the doc_id that it is said to come from, or null); docs: doc_id, text.  Returns item_id,
    verdict, doc_id, first and end (places of words in the document), words (of the quotation), matched and score.

    'verified': the words stand there in one piece, in the cited document if one is cited; 'wrong reference': they do, but in
    other documents only; 'incomplete': all words stand there in their order, but the source has words between them; 'wording
    differs': at least the share `least` of the words can be aligned; 'not found': less, or no common sequence of `gram` words
    among the quotation's `anchors` rarest.  An alignment of all words goes before one that leaves some out, the one with
    fewer words between them first; of equal alignments that of the cited document counts, then the smallest doc_id and place.  At most SLACK words are skipped or inserted on one side of a candidate's diagonals.  A null text or one
    without words is not found; item_id is unique; documents that repeat a doc_id count as several texts of it.
    """
    asked = quotes.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("cited").cast("bigint").alias("cited"), F.coalesce(tokens_of(F.col("text")), F.array().cast("array<string>")).alias("words"))
    # Quotations of the same words are looked for once, under the smallest item_id.
    asked = kept(asked.withColumn("same", F.min("item_id").over(Window.partitionBy("words"))))
    own = asked.where("item_id = same").select("item_id", "words")
    texts = kept(docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), tokens_of(F.col("text")).alias("words")))
    blocks = kept(blocks_of(own, texts, gram, anchors).where("doc_id is not null").join(own.select("item_id", F.size("words").alias("n")), "item_id"))
    # Nothing goes before a quotation in one piece, on which all its anchors lie: only without one are others looked at.
    full = kept(blocks.where(F.col("votes") >= F.least(F.lit(anchors), F.greatest(F.col("n") - gram + 1, F.lit(1)))).select("item_id", "doc_id").distinct())
    exact = kept(standing(full, own, texts))
    turn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("votes").desc(), "doc_id", "block"))
    left = kept(blocks.join(exact.select("item_id").distinct(), "item_id", "left_anti").withColumn("turn", turn))
    best = kept(aligned_with(left.where(F.col("turn") <= FIRST), own, texts))
    # A place where more words of the quotation are missing than the best piece leaves out, or any if that has all of them, cannot be as good.
    of = left.select("item_id", "n").distinct()
    room = best.join(of, "item_id").groupBy("item_id").agg(F.min(F.when(F.col("matched") == F.col("n"), 0).otherwise(F.floor(F.col("n") - F.col("score") / MATCH))).alias("room"))
    others = promising(kept(left.where(F.col("turn") > FIRST).join(room, "item_id")), own, texts)
    others = aligned_with(kept(others), own, texts, F.col("room"))
    judged = exact.unionByName(best).unionByName(others).join(own.select("item_id", F.size("words").alias("n")), "item_id")
    order = ["part", "minus", "first", "end", "matched", "score"]
    by_doc = kept(judged.withColumn("part", F.col("matched") < F.col("n")).withColumn("minus", -F.col("score")).groupBy(F.col("item_id").alias("same"), "doc_id").agg(F.min(F.struct(*order)).alias("b")).select("same", "doc_id", "b.*"))
    best = by_doc.groupBy("same").agg(F.min(F.struct("part", "minus", "doc_id", *order[2:])).alias("b"))
    cited = by_doc.select("same", F.col("doc_id").alias("cited"), F.struct("part", "minus", "doc_id", *order[2:]).alias("c"))
    facts = asked.select("item_id", "cited", "same", F.size("words").alias("n"))
    made = facts.join(best, "same", "left").join(cited, ["same", "cited"], "left")
    ours = F.coalesce((F.col("c.part") == F.col("b.part")) & (F.col("c.minus") == F.col("b.minus")), F.lit(False))
    made = made.select("item_id", "cited", "n", F.when(ours, F.col("c")).otherwise(F.col("b")).alias("b"), (~ours).alias("elsewhere")).select("item_id", "cited", "n", "elsewhere", "b.*")
    whole = (F.col("matched") == F.col("n")) & (F.col("n") > 0)
    verdict = (
        F.when(whole & (F.col("end") - F.col("first") == F.col("n")), F.when(F.col("cited").isNull() | ~F.col("elsewhere"), "verified").otherwise("wrong reference"))
        .when(whole, "incomplete")
        .when(F.col("matched") >= F.col("n") * least, "wording differs")
        .otherwise("not found")
    )
    found = verdict != "not found"
    keep = lambda c: F.when(found, F.col(c)).alias(c)
    return made.select("item_id", verdict.alias("verdict"), keep("doc_id"), keep("first"), keep("end"), F.col("n").alias("words"), keep("matched"), keep("score"))
