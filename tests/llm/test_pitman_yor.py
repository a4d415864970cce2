"""The language model: counts and probabilities against brute force, seating against enumeration, and the awkward cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import op11_pitman_yor as op11

DOCS = "doc_id long, text string, held int, row string"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def tokens(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w).decode() for w in (text or "").encode().split()] + [None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    follow = {w: [f"w{rng.randrange(40)}" for _ in range(4)] for w in (f"w{i}" for i in range(40))}

    def text(n):
        w, out = "w0", []
        for _ in range(n):
            w = rng.choice(follow[w]) if rng.random() < 0.9 else f"W{rng.randrange(40)}".lower()
            out.append(w.upper() if rng.random() < 0.05 else w)
        return " ".join(out)

    texts = [text(rng.randrange(1, 120)) for _ in range(150)] + ["", " \n", None, "naïve ☃", "unseen words here", "again " * 4000] + ["copy of one text"] * 6
    return [*((i, t) for i, t in enumerate(texts)), (None, "w1 w2 w3"), (3, texts[3]), (3, texts[3])]


def scored(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(3)
    return op11.language_model_scores(df, **more)


@pytest.mark.parametrize(("part_tokens", "names"), [(1 << 20, 1 << 20), (300, 20)])
def test_scores(spark, rows, monkeypatch, part_tokens, names):
    """Every figure of every document from the tables that the sampler ended with."""
    kept = {}

    def keep(*args):
        out = op11_sample(*args)
        kept["words"], kept["pairs"], kept["d"], kept["root"] = out[0].collect(), out[1].collect(), out[2], out[3]
        return out

    op11_sample = op11.sample
    monkeypatch.setattr(op11, "sample", keep)
    monkeypatch.setattr(op11, "PART_TOKENS", part_tokens)
    monkeypatch.setattr(op11, "RANKED", names)
    got = scored(spark, rows).collect()
    assert len(got) == len(rows)
    c, pair, context = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            c.update(w)
            pair.update(zip(["", *w], w, strict=False))
            context.update(["", *w[:-1]])
    total, v = sum(c.values()), len(c)
    singles = sum(n == 1 for n in c.values())
    assert len(kept["words"]) == v + 1 - singles and singles > 0
    root = kept["root"]
    d, strength, restaurants = kept["d"], 1.0, {r.word: r for r in kept["words"]}
    tables = {(r.context, r.word): r for r in kept["pairs"]}
    assert sorted(r.c for r in kept["pairs"]) == sorted(n for n in pair.values() if n > 1)
    assert sorted((r.n, r.m) for r in kept["words"]) == sorted((c[w], context[w]) for w in [*c, ""] if c[w] != 1)
    for k in range(2):
        # A restaurant's tables are those of its pairs, and all probabilities of a context sum to one.
        open_ = defaultdict(int)
        for (a, _), r in tables.items():
            assert 1 <= r.t[k] <= r.c
            open_[a] += r.t[k] - r.c
        assert all(r.stood[k] == r.m + open_[r.word] for r in kept["words"])
        assert math.isclose(sum(root.chance(k, r.guests[k], r.seats[k]) for r in kept["words"] if r.n) + root.chance(k, 0, 0) + singles * root.chance(k, 1, 1), 1)
        assert all(min(1, r.guests[k]) <= r.seats[k] <= r.guests[k] <= r.n for r in kept["words"])
    # The same scores, one token at a time.
    plainly = lambda t, known=None: op11.Tokens(pa.array([t], pa.string()), 0, known)
    count = Counter(h for i, t in rows if not held(i) for h in plainly(t).word.tolist() if h != int(op11.END))
    order = sorted(count, key=lambda h: (-count[h], np.uint64(h).view(np.int64)))[: op11.RANKED]
    by_hash = np.argsort(np.array(order, np.uint64))
    hashes = np.array(order, np.uint64)[by_hash], by_hash.astype(np.uint64)
    want = []
    for i, t in rows:
        w = plainly(t, hashes)
        plain = tokens(t)
        score = 0.0
        for a, b, x, y in zip(w.context.view(np.int64).tolist(), w.word.view(np.int64).tolist(), ["", *plain], plain, strict=False):
            n, seen, own = pair[x, y], restaurants.get(a), restaurants.get(b)
            m = context[x]
            assert m == (seen.m if seen else int(c[x] == 1))
            chances = []
            for k in range(2):
                parent = root.chance(k, own.guests[k], own.seats[k]) if own else root.chance(k, int(c[y] == 1), int(c[y] == 1))
                at = tables[a, b].t[k] if (a, b) in tables else n
                chances.append((n - d * at + (strength + d * (seen.stood[k] if seen else int(m == 1))) * parent) / (strength + m))
            score += math.log10(sum(chances) / 2)
        base_score = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (v + 1))) for x in plain)
        want.append((-1 if i is None else i, held(i), len(plain), sum(c[x] > 0 for x in plain), total, round(base_score, 6), score))
    have = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:5], round(r.base_score, 6), r.score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:-1] == b[:-1] and math.isclose(a[-1], b[-1], rel_tol=1e-6)
    out = [(r.base_score, r.score) for r in got if r.held_out and r.n_tokens > 20]
    assert sum(s for _, s in out) > 0.7 * sum(b for b, _ in out)


def test_held_unknown(spark, rows):
    """Rows of which a given column does not say whether they are held out are learnt from, words and pairs alike."""
    some = [(i, t, None if k % 3 == 0 else k % 3 == 1) for k, (i, t) in enumerate(rows)]
    said = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, out boolean").repartition(3)
    a, b = (sorted(((r.doc_id or -1, *r[1:5], round(r.base_score, 6), round(r.score, 4)) for r in op11.language_model_scores(said(x), F.col("out")).collect()), key=str) for x in (some, [(i, t, bool(h)) for i, t, h in some]))
    assert a == b and a[0][4] == sum(len(tokens(t)) for _, t, h in some if not h)


def partitions(n):
    """All ways of seating n customers, as the sizes of the tables."""
    if n == 0:
        yield []
        return
    for rest in partitions(n - 1):
        yield [*rest, 1]
        for k in range(len(rest)):
            yield [*rest[:k], rest[k] + 1, *rest[k + 1 :]]


@pytest.mark.parametrize("c", [2, 3, 5, 7])
def test_seating(c):
    """How many tables are drawn, against the weights of all ways of seating."""
    d, strength, parent, n = 0.6, 3.2, 0.2, 200_000
    weight = Counter()
    for sizes in partitions(c):
        x = math.prod((strength + d * k) * parent for k in range(len(sizes))) * math.prod(j - d for s in sizes for j in range(1, s))
        weight[len(sizes)] += x
    t = op11.seat(np.arange(n, dtype=np.uint64) * np.uint64(op11.BASES[0]), np.full(n, c), np.full(n, strength), np.full(n, parent), d, op11.stirling(d))
    share = np.bincount(t, minlength=c + 1)[1:] / n
    assert np.abs(share - np.array([weight[k] for k in range(1, c + 1)]) / sum(weight.values())).max() < 0.005


@pytest.mark.parametrize(("d", "strength", "parent"), [(0.5, 5.0, 0.05), (0.8, 300.0, 0.1), (0.3, 2.0, 0.9), (0.6, 4000.0, 0.01)])
def test_many_customers(monkeypatch, d, strength, parent):
    """Beyond the table the limit law draws what the exact numbers draw."""
    n, ways = 20_000, op11.stirling(d)
    draw = lambda: op11.seat(np.arange(n, dtype=np.uint64) * np.uint64(op11.BASES[0]), np.full(n, 250), np.full(n, strength), np.full(n, parent), d, ways)
    exact = draw()
    monkeypatch.setattr(op11, "EXACT", 128)
    near = draw()
    assert abs(exact.mean() - near.mean()) < 0.04 * exact.mean() + 0.02 and abs(exact.std() - near.std()) < 0.06 * exact.std() + 0.02


def test_packing():
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, 70_000, 500).astype(np.uint64), np.array([op11.SHORT - 1, op11.SHORT, op11.MIDDLE - 1, op11.MIDDLE], np.uint64), rng.integers(1 << 63, (1 << 64) - 1, 100, dtype=np.uint64, endpoint=True)])
    arrays = [words, np.arange(604), rng.integers(-9, 9, 604), np.linspace(0, 1, 604), np.zeros(0, np.int32)]
    for a, b in zip(arrays, op11.unpack(op11.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)


def test_nothing_to_learn(spark):
    assert scored(spark, []).count() == 0
    only_held = [(i, t) for i, t in zip((x for x in range(200) if held(x)), ["a b", "", None], strict=False)]
    for r in scored(spark, only_held).collect():
        assert r.held_out and (r.n_known, r.train_tokens, r.score) == (0, 0, 0.0)


def test_same_again(spark, rows):
    a, b = (sorted((r.doc_id or -1, r.n_tokens, round(r.score, 3)) for r in df.collect()) for df in (scored(spark, rows), scored(spark, rows[::-1])))
    assert a == b


def test_distinct():
    """As np.unique with the inverse, without sorting what repeats; parts in any range are dealt in the order given."""
    rng = np.random.default_rng(11)
    for values in (rng.integers(0, 50, 10_000), rng.integers(1 << 63, (1 << 64) - 1, 1000, dtype=np.uint64), np.zeros(0, np.uint64), np.array([3, -1, 3])):
        for a, b in zip(op11.distinct(values), np.unique(values, return_inverse=True), strict=True):
            assert a.dtype == b.dtype and np.array_equal(a, b)
    for top in (100, 1 << 40):
        part, what = rng.integers(0, top, 5000) // (top // 10) * (top // 10), np.arange(5000, dtype=np.float64)
        (batch,) = op11.dealt(part, 0, what)
        assert batch.column(0).to_pylist() == sorted(set(part.tolist()))
        for p, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            assert np.array_equal(op11.unpack(data)[0], what[part == p])
    for a in (np.array([-7, -7, 5, 70_000], np.int64), np.array([-9, 3, 1 << 40]), np.array([12]), np.arange(3) - (1 << 62), np.array([-(1 << 63), (1 << 63) - 1])):
        (b,) = op11.unpack(op11.pack(a))
        assert b.dtype == np.int64 and np.array_equal(a, b)
    rows = np.repeat(np.arange(20_000) * 3, 5)
    assert int.from_bytes(op11.pack(rows)[:8], "little") < 3 * len(rows)  # before: eight bytes each


def test_sweeps_hold_no_row_for_each_pair(spark, rows, monkeypatch):
    """Pairs and words travel as packed arrays, one for each part and shard that have something to say to each other; before, links had a row for each pair."""
    made, save = [], op11.saved

    def keep(df, name):
        made.append((name, (table := save(df, name)).count()))
        return table

    monkeypatch.setattr(op11, "saved", keep)
    assert scored(spark, rows).count() == len(rows)
    n = 4  # parts, and shards
    most = {"pairs": n * (1 + 2 * n), "links": n * (1 + n), "restaurants": n * (1 + n)}
    assert [k for k, _ in made].count("links") == 3
    assert all(x <= most[k] for k, x in made if k in most), made


def test_seeds(spark):
    """The draws are those of Spark's xxhash64 of the sweep and the words."""
    words = np.array([0, 1, 77, -1, 1 << 40, -(1 << 63)], np.int64)
    want = [r[0] for r in spark.createDataFrame([(int(a), int(b)) for a, b in zip(words, words[::-1], strict=True)], "a long, b long").selectExpr("xxhash64(2, a, b)").collect()]
    assert op11.seeds(2, words.view(np.uint64), words[::-1].view(np.uint64)).view(np.int64).tolist() == want


def test_rows_posted():
    """Each row names its sender, and its arrays come back in their order."""
    ids = np.array([5, 6, 9, 1 << 63], np.uint64)
    table = pa.Table.from_batches([op11.packed(op11.posted(7, op11.ASKS, np.array([1, 0, 1, 1]), ids, np.arange(4)) + op11.posted(7, op11.OTHERS, np.zeros(0, np.int64), ids[:0]))])
    assert table.column("part").to_pylist() == [0, 1]
    assert [[x.tolist() for x in row] for row in op11.apart(table, op11.ASKS)] == [[[7], [6], [1]], [[7], [5, 9, 1 << 63], [0, 2, 3]]]
    assert op11.apart(table, op11.SUMS) == []
