"""Quotations: alignment against a plain table, and the five verdicts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import quotes as Q

DOCS, QUOTES = "doc_id long, text string, at int", "item_id long, text string, cited long, words int"


def plain_score(quote, text):
    """Best local alignment by the whole table."""
    best, before = 0, [0] * (len(text) + 1)
    for a in quote:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, before[j] + (Q.MATCH if a == b else Q.MISS), before[j + 1] + Q.MISS, row[j] + Q.MISS))
        best, before = max(best, *row), row
    return best


def test_alignment():
    rng = random.Random(1)
    for _ in range(300):
        letters = rng.choice([2, 4, 20])
        text = [rng.randrange(letters) for _ in range(rng.randrange(1, 50))]
        at = rng.randrange(len(text))
        quote = text[at : at + rng.randrange(1, 25)]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(quote) + 1)
            quote = quote[:k] + [rng.randrange(letters)] * rng.randrange(3) + quote[k + rng.randrange(2) :]
        quote = quote or [0]
        # A band that holds the whole table, and a second row that is shorter.
        n, reach = len(quote), len(text) + len(quote)
        quotes, windows = np.full((2, n), -2), np.full((2, n + reach), -1)
        quotes[0], windows[0, n : n + len(text)] = quote, text
        quotes[1, : n // 2], windows[1, n : n + len(text)] = quote[: n // 2], text
        for row, own in ((0, quote), (1, quote[: n // 2])):
            score, matched, first, end = (x[row] for x in Q.aligned(quotes, windows))
            assert score == plain_score(own, text)
            if score:
                assert 0 < matched <= min(len(own), end - first) and plain_score(own, text[first - n : end - n]) == score


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    return {i: [word() for _ in range(rng.randrange(60, 400))] for i in range(40)}


def said(spark, corpus, quotes, **more):
    docs = [(i, ", ".join(w).capitalize(), 1) for i, w in corpus.items()] + [(1000, None, 1), (1001, "", 1)]
    rows = [(i, t, c, 0) for i, (t, c) in enumerate(quotes)]
    return {r.item_id: r for r in Q.verdicts(spark.createDataFrame(rows, QUOTES), spark.createDataFrame(docs, DOCS).repartition(3), **more).collect()}


def test_verdicts(spark, corpus, monkeypatch):
    rng = random.Random(3)
    cases = []
    for i in range(0, 40, 2):
        w = corpus[i]
        at = rng.randrange(len(w) - 50)
        part = w[at : at + 40]
        cases.append((" ".join(part).upper() + "!", i, "verified", i, at, 40))
        cases.append(("“" + " ".join(part) + "”", None, "verified", i, at, 40))
        cases.append((" ".join(part), i + 1, "wrong reference", i, at, 40))
        cases.append((" ".join(part[:15] + part[24:]), i, "incomplete", i, at, 40))
        changed = list(part)
        for k in (7, 20, 33):
            changed[k] = "zzzz"
        cases.append((" ".join(changed), i, "wording differs", i, at, 40))
        cases.append((" ".join(part[:3] + ["qqq%d" % k for k in range(37)]), i, "not found", None, None, None))
    cases.append((" ".join(corpus[4]), 4, "verified", 4, 0, len(corpus[4])))
    cases.append((" ".join(corpus[4][:1]), 4, "verified", None, None, 1))
    cases += [(None, 1, "not found", None, None, None), ("?!", None, "not found", None, None, None), ("qq rr", 1, "not found", None, None, None)]
    got = said(spark, corpus, [c[:2] for c in cases])
    assert len(got) == len(cases)
    for i, (text, _, verdict, doc, first, size) in enumerate(cases):
        r = got[i]
        assert r.verdict == verdict, (i, text, r)
        if doc is not None:
            assert (r.doc_id, r.first, r.end) == (doc, first, first + size)
        assert r.words == len([w for w in (text or "").split() if w != "?!"])
    monkeypatch.setattr(Q, "BROADCAST_GRAMS", 0)
    assert said(spark, corpus, [c[:2] for c in cases]) == got


def test_copies(spark, corpus):
    """A passage that several documents hold is the cited one's, or the first one's."""
    part = corpus[3][10:40]
    more = {50: ["x"] * 5 + part, 51: part * 3, 52: ["y"] * 400 + part}
    got = said(spark, corpus | more, [(" ".join(part), None), (" ".join(part), 51), (" ".join(part), 52), (" ".join(part), 7)])
    assert [(got[i].verdict, got[i].doc_id, got[i].first) for i in range(4)] == [("verified", 3, 10), ("verified", 51, 0), ("verified", 52, 400), ("wrong reference", 3, 10)]


def test_short_end(spark, corpus):
    """Words that stand further on count, even if the best piece leaves them off: fewer than half of those between them."""
    long = ["enatre"] * 23 + ["whed"] * 23 + ["thonnt"] * 23
    part, other = corpus[3][10:50], corpus[5][10:50]
    cases = [(long[10:25] + long[35:50], 50, 50, 40), (other[:20] + other[34:], 5, 5, 40), (other[:4] + other[30:], None, 5, 40)]
    # A copy with one word changed scores better than the whole with the words between.
    cases.append((part[:15] + part[25:], 3, 3, 40))
    more = {50: long, 51: part[:15] + ["zzz"] + part[26:]}
    got = said(spark, corpus | more, [(" ".join(t), c) for t, c, *_ in cases])
    for i, (text, _, doc, span) in enumerate(cases):
        r = got[i]
        assert (r.verdict, r.doc_id, r.end - r.first, r.matched, r.score) == ("incomplete", doc, span, len(text), 3 * len(text) - span), (i, r)


def test_in_order():
    rng = random.Random(4)
    for _ in range(200):
        letters = rng.choice([2, 3, 6])
        text = [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
        quote = [rng.randrange(letters) for _ in range(rng.randrange(1, 8))]
        spans = []
        for i in range(len(text)):
            at = i - 1
            for q in quote:
                at = text.index(q, at + 1) if q in text[at + 1 :] else len(text)
                if at == len(text) or at >= i and text[i] != quote[0]:
                    break
            else:
                spans.append((at + 1 - i, at + 1, i))
        # A second row is longer, so that the first is filled up.
        n, size = len(quote) + 2, len(text) + len(quote) + 4
        quotes, windows = np.full((2, n), -2), np.full((2, n + size), -1)
        quotes[0, : len(quote)], windows[0, : len(text)] = quote, text
        between, first, end = (x[0] for x in Q.in_order(quotes, np.array([len(quote), n]), windows))
        if spans:
            span, stop, start = min(spans)
            assert (between, first, end) == (span - len(quote), start, stop)
        else:
            assert between == -1


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_texts_are_cut_once(spark, corpus, monkeypatch, bound):
    """One pass over the texts finds the sequences, another those that are hit; only these are aligned."""
    monkeypatch.setattr(Q, "BROADCAST_GRAMS", bound)
    seen = spark.sparkContext.accumulator(0)

    def looked(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in corpus.items()], "doc_id long, text string").repartition(3)
    watched = docs.select("doc_id", F.udf(looked, "string").asNondeterministic()("text").alias("text"))
    quotes = spark.createDataFrame([(1, " ".join(corpus[7][5:30])), (2, " ".join(corpus[9][20:29]).upper()), (3, "no such words here")], "item_id long, text string")
    got = {r.item_id: (r.verdict, r.documents, r.first_doc) for r in Q.verify(quotes, watched).collect()}
    assert got == {1: ("exact", 1, 7), 2: ("normalised", 1, 9), 3: ("none", 0, None)}
    assert seen.value == 2 * len(corpus)


def test_alignments_do_not_multiply(spark, corpus, monkeypatch):
    """Before: each quotation met each text with one of its anchors, 60 * 45 and 30 alignments here."""
    seen = spark.sparkContext.accumulator(0)

    def counted(parts, judge=Q._judge):
        for part in parts:
            seen.add(len(part))
            yield from judge(iter([part]))

    monkeypatch.setattr(Q, "_judge", counted)
    monkeypatch.setattr(Q, "FIRST", 3, raising=False)
    part, rng = corpus[3][10:40], random.Random(5)
    # Many copies of one passage, quoted as often.
    more = {100 + i: [f"x{i}"] * 9 + part for i in range(44)}
    got = said(spark, corpus | more, [(" ".join(part), 100 + i) for i in range(60)])
    assert [(got[i].verdict, got[i].doc_id, got[i].first) for i in range(60)] == [("verified", 100 + i, 9) if i < 44 else ("wrong reference", 3, 10) for i in range(60)]
    assert seen.value == 0
    # A run of one word that many texts have besides, before words that they have not; the source comes last.
    runs = {200 + i: [f"y{rng.randrange(10**9)}" for _ in range(20)] + ["to"] * 20 for i in range(30)}
    runs[230] = ["edo", "wh", "onh", *["to"] * 9, "zz", "qq", "uu", *["to"] * 9]
    quote = ["edo", "wh", "onh", *["to"] * 18]
    for bound in (0, 1 << 14):
        monkeypatch.setattr(Q, "BROADCAST_QUOTES", bound, raising=False)
        seen.value = 0
        r = said(spark, corpus | runs, [(" ".join(quote), None)])[0]
        assert (r.verdict, r.doc_id, r.first, r.end, r.matched, r.score) == ("incomplete", 230, 0, 24, 21, 39)
        assert seen.value <= 4


@pytest.mark.parametrize("n", [1, 3])
def test_sequences(spark, corpus, monkeypatch, n):
    """All places of each sequence in each text, whatever is cut together; the sieve lets all of its own through and few others."""
    monkeypatch.setattr(Q, "CUT", 500)
    lists = corpus | {40: ["a"] * 5, 41: [], 42: ["a", "b"]}
    rows = spark.createDataFrame(list(lists.items()), "doc_id long, words array<string>").repartition(2)
    found = [(r.doc_id, r.gram, r.places) for r in Q.grams_of(rows, "doc_id", n).collect()]
    names = {}
    for i, gram, places in found:
        for p in places:
            assert names.setdefault(gram, lists[i][p : p + n]) == lists[i][p : p + n] and len(lists[i][p : p + n]) == n
    assert len(names) == len({tuple(x) for x in names.values()})
    assert sum(len(p) for *_, p in found) == sum(max(0, len(w) - n + 1) for w in lists.values()) and len({x[:2] for x in found}) == len(found)
    asked = Q.grams_of(rows.where("doc_id in (3, 40)"), "doc_id", n)
    through = {r.gram for r in Q.grams_of(rows, "doc_id", n, Q.sieve_of(asked, asked.count())).collect()}
    own = {g for i, g, _ in found if i in (3, 40)}
    assert own <= through and len(through - own) < 0.1 * len(names)


def test_no_quotations(spark, corpus):
    assert said(spark, corpus, []) == {}
    none = Q.verdicts(spark.createDataFrame([(1, "a b c", None, 0)], QUOTES), spark.createDataFrame([], DOCS)).collect()
    assert [r.verdict for r in none] == ["not found"]
