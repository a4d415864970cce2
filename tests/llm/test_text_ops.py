"""The operators against brute force on small tables, with the awkward cases each must survive."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import induced
from lectern.llm import op6_minhash as op6
from lectern.llm import op9_suffix_array as op9
from lectern.llm.op1_line_dedup import common_blocks, dedup_lines, longest_common
from lectern.llm.op2_substring_dedup import dedup_passages
from lectern.llm.op4_decontamination import contaminated, without_contaminated
from lectern.llm.op6_minhash import near_duplicates

DOCS = "doc_id long, text string"


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages, periodic texts, blanks, nulls and long words."""
    rng = random.Random(1)
    shared, base = words(rng, 80), words(rng, 120)
    texts = [" ".join(words(rng, rng.randrange(1, 200))) for _ in range(25)]
    texts += [" ".join(words(rng, 30) + shared + words(rng, 40)) for _ in range(6)]
    texts += [" ".join(base)] * 4
    for _ in range(8):
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += ["", " \t\n ", None, "one", "x" * 3000, "ab " * 200, "abc" * 100, " ".join(["tick", "tock"] * 90), "a\nb\n\na\nb", "naïve ☃ " * 60]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS + ", ranges int, h string").repartition(3)


def test_substrings(spark, corpus):
    got = {r.doc_id: r for r in dedup_passages(frame(spark, corpus), 50).collect()}
    assert len(got) == len(corpus)
    split = {i: (t or "").encode().split() for i, t in corpus}
    first = {}
    for i, w in split.items():
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    for i, w in split.items():
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (len(w), len(gone), kept)


def brute_bytes(corpus, length):
    seen, want = set(), {}
    for i, t in corpus:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return want


@pytest.mark.parametrize(("hot", "shard"), [(20_000, 4 << 20), (0, 4 << 20), (20_000, 500)])
def test_byte_strings(spark, corpus, monkeypatch, hot, shard):
    monkeypatch.setattr(op9, "HOT", hot)
    monkeypatch.setattr(op9, "SHARD_BYTES", shard)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in op9.dedup_bytes(frame(spark, corpus)).collect()}
    assert got == brute_bytes(corpus, 100)


def test_induced_sorting(monkeypatch):
    """Order and common prefixes of random strings, with queues that spill and steps of a few suffixes."""
    rng = random.Random(2)
    for _ in range(300):
        monkeypatch.setattr(induced, "STEP", rng.choice([1, 3, 1 << 16]))
        letters = rng.choice([b"a", b"ab", b"abcd", bytes(range(256))])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, rng.choice([6, 25, 80])))) for _ in range(rng.randrange(1, 7))]
        strings += strings[: rng.randrange(2)]
        cap = rng.choice([2, 9, 100])
        raw, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
        parts = list(induced.sort_strings(raw, ends, cap, rng.choice([8, 1 << 20])))[::-1]
        order, prefix = np.concatenate([a for a, _ in parts]), np.concatenate([p for _, p in parts])
        suffix, at = {}, 1
        for s in strings:
            suffix |= {at + i: s[i:] for i in range(len(s))}
            at += len(s) + 1
        assert sorted(order.tolist()) == sorted(suffix)
        for x, y, p in zip(order[:-1], order[1:], prefix[1:], strict=True):
            a, b = suffix[x], suffix[y]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert a[:cap] <= b[:cap] and p == min(same, cap)


def test_production_budget_spills():
    """A shard of the usual size keeps its queues on disk, and finds what a hash set finds."""
    rng = np.random.default_rng(5)
    base = rng.integers(97, 105, 300_000).astype(np.uint8)
    n = np.full(20_000, 60)
    lo = rng.integers(0, len(base) - 160, len(n))
    raw = np.concatenate([base[a : a + 159] for a in lo])
    assert len(raw) < op9.SHARD_BYTES
    sorter = induced.Induction(induced.text_of(raw, np.cumsum(n + 99)), 256, 100)
    assert sum(len(a) for a, _ in sorter.sort()) == len(raw) and sorter.spilled > 0
    got = op9.repeated_windows(np.arange(len(n)), lo, n, raw, 100)
    assert got.column(2).to_numpy().sum() == n.sum() - len(set(np.concatenate([np.arange(a, a + 60) for a in lo]).tolist()))


def test_one_letter():
    import resource

    size = 10_000_000
    found = op9.repeated_windows(np.array([1]), np.array([0]), np.array([size - 99]), np.full(size, 97, np.uint8), 100)
    assert found.to_pylist() == [{"doc_id": 1, "lo": 1, "n": size - 100}]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_500_000  # in KB, the test session included


def shingles(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, corpus):
    got = {r.doc_id: r for r in near_duplicates(frame(spark, [*corpus, (1000, "ONE")])).collect()}
    rows = [*corpus, (1000, "ONE")]
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_short_near_duplicates(spark):
    """Texts of 8 words and their first 7: 3 of 4 shingles in common, just enough."""
    rng = random.Random(8)
    texts = [[f"v{rng.randrange(10**9)}" for _ in range(8)] for _ in range(150)]
    rows = [(2 * i + k, " ".join(t[: 8 - k])) for i, t in enumerate(texts) for k in range(2)]
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("tile", [2048, 16])
def test_one_template(spark, monkeypatch, tile):
    """Texts of one template, near 0.75 on both sides: so few comparisons are made at once, in tiles, and no turn of leaders comes before."""
    rng = random.Random(75)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(160):
        words = list(template)
        for at in (rng.randrange(0, 60), rng.randrange(0, 60)) if i % 4 else (rng.randrange(56, 60),):
            words[at] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    names, keep = [], op6.saved
    monkeypatch.setattr(op6, "saved", lambda df, name: names.append(name) or keep(df, name))
    monkeypatch.setattr(op6, "TILE", tile)
    monkeypatch.setattr(op6, "FEW_MET", 0)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()}
    sets, low = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    assert got == low and names.count("leads") == 1


def test_pairs_of_a_bucket(spark, monkeypatch):
    """Tiles find the pairs of a bucket that all comparisons find, each once, in its first shared band."""
    rng = random.Random(5)
    base = [[f"w{k}-{i}" for i in range(50)] for k in range(3)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"v{rng.random()}" for w in base[i % 3])) for i in range(90)]
    sketch = frame(spark, rows).mapInArrow(op6._sketch(5), op6.SKETCH).select("doc_id", "n_shingles", "bands", "sig").cache()
    made = sketch.collect()
    buckets = sketch.select("doc_id", F.posexplode("bands").alias("band", "key")).select("key", F.col("doc_id").alias("id"), "band", (F.col("doc_id") % 7).alias("label"))
    buckets = buckets.join(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")
    classes = sketch.withColumnRenamed("doc_id", "id")
    lanes = lambda r: [(x >> s) & 3 for x in r.sig for s in range(0, 64, 2)]
    want = set()
    for p in made:
        for q in made:
            if (p.n_shingles, p.doc_id) < (q.n_shingles, q.doc_id) and p.doc_id % 7 != q.doc_id % 7 and set(p.bands) & set(q.bands) and 100 * p.n_shingles >= 75 * q.n_shingles:
                differ = sum(x != y for x, y in zip(lanes(p), lanes(q), strict=True))
                if (1 - differ / op6.HASHES - 0.25) / 0.75 >= op6.LEAST_ESTIMATE:
                    want.add((*sorted((p.doc_id, q.doc_id)), *sorted((p.doc_id % 7, q.doc_id % 7))))
    for tile in (2048, 4):
        monkeypatch.setattr(op6, "TILE", tile)
        found = [(*sorted((r.a, r.b)), *sorted((r.x, r.y))) for r in op6.cross_pairs(buckets, classes, 75).collect()]
        assert len(found) == len(want) > 100 and set(found) == want


def test_patience():
    a, b = list("axbycz"), list("abc")
    assert common_blocks(a, b) == [(0, 0, 1), (2, 1, 1), (4, 2, 1)]
    assert common_blocks([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)] and common_blocks([], [1]) == [] and common_blocks([1, 1], [2, 2]) == []
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        last = (0, 0)
        for i, j, n in common_blocks(a, b):
            assert (i, j) >= last and i >= last[0] and j >= last[1] and a[i : i + n] == b[j : j + n] and n
            last = (i + n, j + n)


@pytest.mark.parametrize("bits", [1 << 27, 1])
def test_ranges_without_unique_lines(monkeypatch, bits):
    monkeypatch.setattr("lectern.llm.op1_line_dedup.LCS_BITS", bits)
    assert common_blocks(list("aQc"), list("bQdQe")) in ([(1, 1, 1)], [(1, 3, 1)])
    assert common_blocks(list("aQcQd"), list("bQeQf")) == [(1, 1, 1), (3, 3, 1)]
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(2))
        table = {(i, j): 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        pairs = longest_common(a, b)
        assert len(pairs) == table[len(a), len(b)] and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs[:-1], pairs[1:], strict=True))


def test_repeated_line_in_one_document(spark):
    q = "a passage of ten words that one document holds twice"
    rows = [(1, f"a1\n{q}\na2"), (2, f"b1\n{q}\nb2\n{q}\nb3")]
    got = {r.doc_id: r.n_removed for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 1}


def test_lines(spark):
    line = [f"this is line number {i} with ten words in it now" for i in range(8)]
    rows = [
        (1, "\n".join(line[:4])),
        (2, "own words\n" + "\n".join(line[:4]) + "\n\nmore"),
        (3, "\n".join(line[:4])),
        (4, "short\n" + line[6]),
        (5, "short\nother"),
        (6, None),
        (7, ""),
        (8, line[1] + "\nsomething\n" + line[3]),
    ]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (4, 0, rows[0][1]), 2: (6, 4, "own words\n\nmore"), 3: (4, 4, ""), 4: (2, 0, rows[3][1]), 5: (2, 1, "other"), 6: (0, 0, None), 7: (0, 0, ""), 8: (3, 2, "something")}
    kept = dedup_lines(frame(spark, rows), keep=("h",)).where("doc_id = 2").first()
    assert kept.h == "x" and kept.text == "own words\n\nmore"


def test_lines_beside_rarer_ones(spark):
    licence, own, more = (f"{w} line of ten words that stands in some documents here" for w in ("licence", "own", "more"))
    short = [f"short {i}" for i in range(6)]
    rows = [
        (1, f"first\n{licence}"),
        (2, f"{own}\n{licence}\n{more}"),
        (3, f"{own}\n{licence}\n{more}"),  # a later copy of 2
        (4, f"x\n{licence}\ny"),
        *((10 + i, f"{s}\nalone {i}") for i, s in enumerate(short)),  # first holders of the short lines
        (20, "before\n" + "\n".join(short) + "\nafter"),
        (21, "other\n" + "\n".join(short) + "\nend"),
        (30, f"{own}\ntail"),
        (31, f"{own}\ntail"),
        (40, f"y\n{licence}\n{more}\nnew 40"),  # the second stands in a later document, too
        (41, f"{more}\nnew 40"),
    ]
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert (got[2], got[3], got[4], got[20], got[21], got[30], got[31]) == (f"{own}\n{more}", "", "x\ny", "before\nafter", "other\nend", "tail", "")
    assert (got[40], got[41]) == ("new 40", "")


def test_lines_against_brute_force(spark):
    """With lines that stand once in a document, as many go as the longest common subsequences with their first holders have."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        lines = rng.sample([f"line {k}" for k in range(150)], rng.randrange(2, 25))
        rows.append((i + 1, "\n".join(sorted(lines) if rng.random() < 0.5 else lines)))
    first, want = {}, {}
    for i, t in rows:
        for x in t.split("\n"):
            first.setdefault(x, i)
    for i, t in rows:
        want[i] = 0
        for a in {first[x] for x in t.split("\n")} - {i}:
            x, y = ([z for z in text.split("\n") if first[z] == a] for text in (dict(rows)[a], t))
            table = np.zeros((len(x) + 1, len(y) + 1), int)
            for p in range(len(x)):
                for q in range(len(y)):
                    table[p + 1, q + 1] = table[p, q] + 1 if x[p] == y[q] else max(table[p, q + 1], table[p + 1, q])
            want[i] += int(table[-1, -1])
    got = {r.doc_id: r for r in dedup_lines(frame(spark, rows)).collect()}
    assert {i: r.n_removed for i, r in got.items()} == want and all(len(r.text.split("\n")) == r.n_lines - r.n_removed or not r.text for r in got.values())
    assert sum(want.values()) > 100


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([3, 8, 20, 40, 40])] + [(9, None), (10, "")]
    docs = [(i, " ".join(words(rng, 60))) for i in range(10)]
    docs += [(20, "x " + items[3][1].upper() + " y"), (21, " ".join(words(rng, 10)) + " " + " ".join([*items[4][1].split()[:38], "new", "words"])), (22, items[0][1]), (23, None), (24, ""), (25, " ".join(items[2][1].split()[:12]))]
    bag = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            v = (x or "").lower().split()
            for p in range(len(w) - len(v) + 1) if v else ():
                k = min(5, len(v))
                a, b = bag(w[p : p + len(v)], k), bag(v, k)
                s = (a & b).total() / (a | b).total()
                if s >= 0.75 and s > want.get((d, i), (0,))[0]:
                    want[d, i] = (s, p, len(v))
    df, known = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in contaminated(df, known).collect()}
    assert got == want and {(20, 3), (21, 4), (22, 0)} <= got.keys()
    clean = without_contaminated(df, known)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in {k[0] for k in want}) and clean.columns == df.columns


def test_windows_outside_the_radius(spark):
    """Items whose last 28 of 200 words are changed (similarity 0.75 to 0.76), and documents shorter than an item."""
    rng = random.Random(9)
    items = [(i, " ".join(f"t{rng.randrange(10**9)}" for _ in range(200))) for i in range(150)]
    items.append((500, " ".join(f"s{k}" for k in range(30))))
    docs = [(i, " ".join([*t.split()[:172], *(f"n{rng.randrange(10**9)}" for _ in range(28))])) for i, t in items[:-1]]
    docs += [(1000, " ".join(items[-1][1].split()[:-1])), (1001, " ".join(items[-1][1].split()[:15]))]
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i): (168 / 224, 0, 200) for i, _ in items[:-1]} | {(1000, 500): (25 / 26, 0, 29)}


def test_many_items_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr("lectern.llm.op4_decontamination.ITEMS_AT_ONCE", 2)
    items = [(i, " ".join(f"t{i}x{k}" for k in range(12))) for i in range(7)]
    docs = [(i, f"a b {t} c") for i, t in items]
    got = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(7)]
    more = spark.createDataFrame([*docs, (50, "clean"), (51, None), (None, f"z {items[2][1]}"), (52, "")], DOCS)
    kept = without_contaminated(more, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [50, 51, 52]


def test_empty_tables_and_missing_ids(spark):
    empty = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    for made in (dedup_passages(empty), op9.dedup_bytes(empty), near_duplicates(empty), dedup_lines(empty), contaminated(empty, items)):
        assert made.count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (5, "q " * 60), (5, "q " * 60), (6, "q " * 60)], DOCS)
    assert dedup_passages(odd).count() == op9.dedup_bytes(odd).count() == dedup_lines(odd).count() == near_duplicates(odd).count() == 4
    removed = {(r.doc_id, r.n_removed) for r in dedup_passages(odd).collect()}
    assert removed == {(None, 0), (5, 0), (6, 60)}


def test_digest_columns(spark, tmp_path):
    from lectern.llm.op2_substring_dedup import op2_substring_dedup

    spark.createDataFrame([(1, "a  b"), (2, None)], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in op2_substring_dedup(spark, f"file://{tmp_path}").collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
