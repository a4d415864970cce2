"""Near-duplicate documents by b-bit MinHash.

Each text becomes its set of word shingles, 768 minima over as many hash functions, 32
band keys of four minima each (from the first 128), and a packed signature that retains
two well-mixed bits of each minimum.  Documents that share a band key are candidates; the collision-corrected
similarity of their signatures, a few bit counts, sorts out most, and full shingle sets
confirm the rest.  A pair of similarity 0.75 shares no band with a chance of 5 in a million.

Groups of copies stay linear: equal sets are one vertex; in each bucket the members are
first linked with leaders, in several turns where that saves much; only buckets that still hold several
components are searched pair by pair, members of one component never being compared.  Large ones are searched in
tiles, so no task holds a whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import document_columns, lean_batches, saved, split_join
from .textblock import BASES, LOWER, Prefix, Words, blocks, mix, ranges, text_bytes

HASHES, BANDED, ROWS, BITS = 768, 128, 4, 2
#: Pairs that look less similar than this are not confirmed: 4.5 standard deviations of the estimate below 0.75.
LEAST_ESTIMATE = 0.665
#: Further turns, at most, in which buckets of several components choose a leader; none is needed once
#: their members meet no more than so many others on average.  The search pair by pair that follows is exact in any case.
TURNS, FEW_MET = 3, 32
#: So many comparisons in all are made at once: a turn, some fifteen tables, takes longer than they do.
FEW_COMPARISONS = 1 << 26
#: Members of a tile of a bucket, on average; a bucket of several tiles is searched pair of tiles by pair of tiles.
TILE = 2048
#: So many ids (8 bytes each) are broadcast to pick documents; more are shuffled, and the texts with them.
BROADCAST_IDS = 500_000
_rng = np.random.default_rng(6)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SALT = mix(np.arange(HASHES, dtype=np.uint64) * np.uint64(BASES[0]) + np.uint64(1))
SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sig array<long>"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; a text of fewer words is one shingle."""
    raw, at = text_bytes(column)
    words = Words(LOWER[raw], at)
    p = Prefix(words.hashes(), BASES[1])
    counts = words.counts()
    starts = np.arange(len(words))
    width = np.minimum(np.repeat(counts, counts), size)
    left = np.repeat(words.first[1:], counts) - starts
    starts, width = starts[left >= width], width[left >= width]
    all_ = mix(p.ranges(starts, starts + width) + width.astype(np.uint64))
    bounds = np.searchsorted(starts, words.first)
    return [np.unique(all_[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        h = x[i : i + 256, None] ^ _XOR
        h *= _ODD
        np.minimum(least, h.min(axis=0), out=least)
    return least


def pack(least: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, side by side in 64-bit words; one row for each set.

    They are mixed with the number of the hash function: the low bits of the minima themselves agree or differ for all
    functions alike, as the low bits of the two shingles do.
    """
    lanes = 64 // BITS
    bits = (mix(least.astype(np.uint64) ^ _SALT) >> np.uint64(64 - BITS)).reshape(len(least), -1, lanes)
    return (bits << (np.arange(lanes, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = least[:, :BANDED].astype(np.uint64).reshape(len(least), -1, ROWS)
    key = np.arange(keys.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for i in range(ROWS):
        key = mix(key * np.uint64(BASES[0]) + keys[:, :, i])
    return key


def _sketch(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = shingle_sets(block.column(1), size)
            n = np.array([len(s) for s in sets])
            least = np.stack([minima(s) for s in sets])
            ids = [np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (BASES[2], BASES[3])]
            offsets = lambda k: pa.array(np.arange(0, k * len(sets) + 1, k, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets(x.shape[1]), pa.array(x.view(np.int64).ravel())) for x in (band_keys(least), pack(least))]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n), *map(pa.array, ids), *lists], schema=_SKETCH)

    return task


def similarity(left: str, right: str) -> Column:
    """Estimated similarity of two packed signatures, corrected for lanes that agree by chance."""
    words, mask = HASHES * BITS // 64, sum(1 << i for i in range(0, 64, BITS))
    lanes = lambda x: f"bit_count(({' | '.join([x, *(f'shiftrightunsigned({x}, {i})' for i in range(1, BITS))])}) & {mask}L)"
    differ = " + ".join(lanes(f"({left}[{i}] ^ {right}[{i}])") for i in range(words))
    chance = 2.0**-BITS
    return (F.lit(1.0) - F.expr(f"({differ})") / F.lit(float(HASHES)) - F.lit(chance)) / F.lit(1 - chance)


def _sets(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([s.tobytes() for s in shingle_sets(block.column(1), size)], pa.binary())], names=["id", "shingles"])

    return task


def _confirm(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set"), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
                good.append(100 * both >= percent * (len(a) + len(b) - both) and both > 0)
            yield batch.drop_columns(["a_set", "b_set"]).filter(pa.array(good, pa.bool_()))

    return task


def confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of (a, b, more columns) whose full shingle sets are similar enough; each needed set is made once."""
    pairs = saved(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    few = 2 * pairs.count() <= BROADCAST_IDS
    if not few:
        ids = saved(ids.distinct(), "ids")
        few = ids.count() <= BROADCAST_IDS
    sets = saved(docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(size), "id long, shingles binary"), "sets")
    x, y = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b").select(*pairs.columns, "a_set", "b_set")
    return saved(both.mapInArrow(_confirm(percent), pairs.schema), "confirmed")


def _search(percent: int):
    """Rows (key, i, j, tile, id, label, band, n_shingles, bands, sig), those of a key and pair of tiles (i, j) side by side, become the pairs
    (a, b) that look alike, with their labels (x, y)."""
    lanes = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    chance = 2.0**-BITS

    def alike(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, tile, id_, label, band, n = (table.column(c).to_numpy() for c in ("key", "i", "j", "tile", "id", "label", "band", "n_shingles"))
        bands, sig = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(key), -1) for c in ("bands", "sig"))
        sig = sig.view(np.uint64)
        group = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        order = np.lexsort((n, group))
        # Each row meets the larger ones of its group, as far as their sizes allow.
        step = int(n.max()) + 1
        place = group[order] * step + n[order]
        last = np.searchsorted(place, group[order] * step + np.minimum(100 * n[order] // percent, step - 1), "right")
        first = np.arange(1, len(order) + 1)
        meets = last - first
        done = np.append(0, np.cumsum(meets))
        x = 0
        while x < len(order):
            y = max(x + 1, int(np.searchsorted(done, done[x] + (1 << 16), "right")) - 1)
            l, r = order[np.repeat(np.arange(x, y), meets[x:y])], order[ranges(first[x:y], meets[x:y])]
            x = y
            some = (label[l] != label[r]) & ((tile[l] != tile[r]) | (i[l] == j[l]))
            l, r = l[some], r[some]
            # Once for each pair, in the first band that both share.
            some = np.argmax(bands[l] == bands[r], axis=1) == band[l]
            l, r = l[some], r[some]
            differ = sig[l] ^ sig[r]
            for k in range(1, BITS):
                differ |= differ >> np.uint64(k)
            some = (1.0 - np.bitwise_count(differ & lanes).sum(axis=1) / HASHES - chance) / (1 - chance) >= LEAST_ESTIMATE
            l, r = l[some], r[some]
            if len(l):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (id_[l], id_[r], label[l], label[r])], names=["a", "b", "x", "y"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * TILE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            # The last group may go on in the next batch.
            end = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            whole = int(end[-1]) + 1 if len(end) else 0
            if whole:
                yield from alike(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield from alike(pa.Table.from_batches(held).combine_chunks())

    return task


def cross_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, x, y): members of a bucket with different labels x and y that look alike.  rows: (key, id, band, label, size of the bucket)."""
    tiles = F.ceil(F.col("size") / TILE)
    tiled = rows.withColumn("tile", F.pmod(F.xxhash64("id"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    tiled = tiled.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "label", "band")
    whole = tiled.join(classes.select("id", "n_shingles", "bands", "sig").hint("shuffle_hash"), "id")
    return whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_search(percent), "a long, b long, x long, y long")


def mixed_buckets(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, float]:
    """(key, id, band, label, size) of the members of buckets that hold several components, how many members such a row meets, and all meetings."""
    members = saved(rows.select("key", "id", "band").join(labels, "id", "left").select("key", "id", "band", F.coalesce("label", "id").alias("label")), "members")
    several = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("key", "n")
    several = saved(several, "several")
    compared, met = several.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).first()
    mixed = split_join(members, several.withColumn("size", F.col("n")), ["key"], "n").select("key", "id", "band", "label", "size")
    return saved(mixed, "mixed"), met or 0.0, compared or 0.0


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links; those are (a, b) pairs of labels, an id without one being its own."""
    over = saved(components(links), "over")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(over.select(F.col("id").alias("label"), F.col("label").alias("low")), "label", "left")
    sizes = saved(sizes.select("label", F.coalesce("low", "label").alias("low"), "n"), "sizes")
    known = split_join(labels, sizes, ["label"], "n").select("id", F.col("low").alias("label"))
    return saved(known.unionByName(over.join(labels.select("id"), "id", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Reads doc_id and text; returns doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept
    (doc_id = component_id).  Words are lower-cased from A to Z.  A null, empty or blank text has no shingles, links
    with nothing and is kept; so is a row without a doc_id (its component_id and kept are null).  Rows that share a doc_id
    are one vertex of several sets.  A very long text is one set in one task, some 100 bytes for each of its words.  An empty
    table gives an empty table.
    """
    lean_batches(docs.sparkSession)
    docs = document_columns(docs)
    sketch = saved(docs.mapInArrow(_sketch(size), SKETCH), "sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = saved(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("n_shingles", "bands", "sig"), "doc_id").alias("x")).select("s1", "s2", "id", "x.*"), "classes")
    buckets = classes.select("id", F.posexplode("bands").alias("band", "key"))
    like_sized = 100 * F.least("l.n_shingles", "r.n_shingles") >= percent * F.greatest("l.n_shingles", "r.n_shingles")
    close = like_sized & (similarity("l.sig", "r.sig") >= LEAST_ESTIMATE)
    # Rows of buckets that several share; how often a document meets others there tells how central it is.
    again = saved(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "again")
    rows = saved(split_join(buckets, again.select("key", "k", F.col("k").alias("n")), ["key"], "n"), "buckets")
    central = rows.groupBy("id").agg(F.sum("k").alias("met"))
    # Each bucket is led by its most central member, and each member is compared with the most central of its leaders.
    lead = rows.join(central.hint("shuffle_hash"), "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("lead"), F.count(F.lit(1)).alias("n"))
    led = split_join(rows, saved(lead, "leads"), ["key"], "n").where(F.col("lead.minus") != -F.col("id")).groupBy("id").agg(F.max("lead").alias("lead"))
    pairs = led.select(F.col("id").alias("a"), (-F.col("lead.minus")).alias("b"))
    signed = classes.select("id", "n_shingles", "sig")

    def close_ones(pairs: DataFrame) -> DataFrame:
        return pairs.join(signed.alias("l"), F.col("a") == F.col("l.id")).join(signed.alias("r"), F.col("b") == F.col("r.id")).where(close).select(*pairs.columns)

    def fresh(pairs: DataFrame) -> DataFrame:
        """The labels (x, y) of the pairs (a, b) that are confirmed."""
        return confirmed(docs, pairs, size, percent).select(F.col("x").alias("a"), F.col("y").alias("b"))

    labels = components(confirmed(docs, close_ones(pairs), size, percent))
    # While members of mixed buckets would meet many others, the buckets get further leaders, drawn by id alone, so that one
    # member leads all buckets of its family; each member is compared with one leader a turn that looks like it.  A turn that
    # does not halve what is met is the last.  A bucket of one component never becomes mixed again.
    before = float("inf")
    for turn in range(TURNS + 1):
        rows, met, compared = mixed_buckets(rows, labels)
        if met <= FEW_MET or compared <= FEW_COMPARISONS or met > before / 2 or turn == TURNS:
            break
        before = met
        lead = F.struct(F.xxhash64(F.lit(turn), "id").alias("draw"), F.col("id").alias("b"), F.col("label").alias("y"))
        leads = saved(rows.groupBy("key").agg(F.min(lead).alias("lead"), F.count(F.lit(1)).alias("n")), "leads")
        pairs = split_join(rows, leads, ["key"], "n").where("label <> lead.y").select(F.col("id").alias("a"), F.col("label").alias("x"), "lead.*").distinct()
        links = fresh(close_ones(pairs).groupBy("a", "x").agg(F.min(F.struct("draw", "b", "y")).alias("lead")).select("a", "x", "lead.b", "lead.y"))
        if not links.isEmpty():
            labels = merged(labels, links)
    # What is left there: each member with the members of other components near its size.
    links = fresh(cross_pairs(rows, classes, percent))
    if not links.isEmpty():
        labels = merged(labels, links)
    vertex = full.join(classes.select("s1", "s2", F.col("id").alias("vertex")), ["s1", "s2"]).select("doc_id", "vertex")
    found = vertex.join(labels.withColumnRenamed("id", "vertex"), "vertex", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "vertex")).alias("component"))
    return sketch.select("doc_id", "n_shingles").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
