"""Periodic runs against brute force, and the awkward cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import op13_periodic_runs as op13

DOCS = "doc_id long, text string, runs int, n_words string"


def brute(w, times=4, least=6):
    """(start, period, end) of all runs: for each period the stretches in which words that far apart agree."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, times * p):
                found.setdefault((s, i + p), p)
            i += i == s
    return sorted((s, p, e) for (s, e), p in found.items())


def collapsed(w, runs):
    gone = {i for s, p, e in runs for i in range(s + p, e)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("pairs", [7, 100, 1 << 19])
def test_runs_of_numbers(monkeypatch, pairs):
    monkeypatch.setattr(op13, "PAIRS", pairs)
    rng = random.Random(pairs)
    for _ in range(60):
        docs = []
        for _ in range(rng.randrange(6)):
            n, letters = rng.randrange(rng.choice([8, 60, 300])), rng.choice([1, 2, 3, 50])
            d = [rng.randrange(letters) for _ in range(n)]
            if n > 10 and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randrange(1, n // 3)
                d = [d[i] if i < a else d[min(n - 1, a + (i - a) % p)] for i in range(n)]
            docs.append(d)
        first = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        start, end, period = op13.find_runs(np.array([x for d in docs for x in d], np.int64), first)
        want = [(a + f, p, b + f) for d, f in zip(docs, first.tolist(), strict=False) for a, p, b in brute(d)]
        assert sorted(zip(start.tolist(), period.tolist(), end.tolist(), strict=True)) == sorted(want)


def test_extensions():
    """Common extensions of any two positions, near and far, in texts with long repeats."""
    rng = np.random.default_rng(3)
    unit = rng.integers(1, 4, 90)
    numbers = np.concatenate([np.tile(unit, 9), [9], np.tile(unit, 9)[7:], [10], np.ones(500, int), [11]])
    ext = op13.Extensions(numbers)
    i, j = rng.integers(0, len(numbers), (2, 4000))
    i, j = i[i != j], j[i != j]
    for a, b, got in zip(i.tolist(), j.tolist(), ext.common(i, j).tolist(), strict=True):
        want = 0
        while max(a, b) + want < len(numbers) and numbers[a + want] == numbers[b + want]:
            want += 1
        assert got == want


def test_documents(spark):
    """Nulls, blanks, repeated rows, clashing columns, two runs that overlap, and a text longer than a block."""
    two = "x y x y x y x y x z z z z z z q"
    texts = [two, two, None, "", " \t\n", "a", "a a a a a", "a a a a a a", "A a A a A a", "b c d " * 5 + "e", "é ☃ " * 9, " ".join(f"w{i % 40_000}" for i in range(200_000))]
    rows = [(None if k == 1 else k, t, 5, "z") for k, t in enumerate(texts)] + [(3, "k k k k k k k", 5, "z")]
    got = op13.periodic_runs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    plain = lambda i, n, runs, t: (-1 if i is None else i, n, runs, t)
    want = []
    for i, t, *_ in rows:
        w = (t or "").split()
        runs = brute(w) if len(w) < 1000 else [(0, 40_000, 200_000)]
        want.append(plain(i, len(w), [(s, e - s, p) for s, p, e in runs], collapsed(w, runs)))
    assert sorted(plain(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got) == sorted(want)
    assert op13.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="four"):
        op13.periodic_runs(spark.createDataFrame([], DOCS), times=3)


def test_looped(spark):
    text = " ".join(f"w{i}" for i in range(37))
    rows = [(i, t) for i in range(120) for t in (text, "", None, "one")]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", op13.looped(F.col("doc_id"), F.col("text")).alias("made")).collect()
    touched = 0
    for r in got:
        h = zlib.crc32(str(r.doc_id).encode())
        w = (r.text or "").split()
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert r.made.split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            touched += 1
        else:
            assert (r.made or "").split() == w
    assert touched > 5
