"""Fixture plans, nested results, and the check after an import."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import checks, fixtures, nested

POINTS = "id string, profile string, lang string, corpus string, bible string, tokens int, n int"


def plan_of(spark, rows, slots=None, **more):
    slots = slots or fixtures.usual_slots(F.col("tokens"))
    return [(r.slot, r.part, r.id) for r in fixtures.fixture_plan(spark.createDataFrame(rows, POINTS).repartition(3), slots, **more).orderBy("slot", "part", "id").collect()]


def full(n=12):
    rows = []
    for lang in ("en", "de", "fr", "es", "it", "pt", "ru"):
        rows += [(f"{lang}{i:02}", "sop", lang, "egw", None, 50, 0) for i in range(n)]
    rows += [(f"p{i:02}", "sop", "en", "pioneers", None, 600 if i in (0, 3) else 90, 0) for i in range(n)]
    for b in ("kjv", "asv", "luther", "elb", "web", "ylt"):
        rows += [(f"{b}{i:02}", "bible", "en", None, b, 20, 0) for i in range(n)]
    return rows + [(None, "sop", "en", "egw", None, 1, 0), ("x", None, None, None, None, None, 0), ("en00", "sop", "en", "egw", None, 50, 0)]


def test_usual_plan(spark):
    got = plan_of(spark, full())
    assert len(got) == 16
    assert [i for s, _, i in got if s == 0] == ["en00", "en01"] and [i for s, _, i in got if s == 1] == ["de00", "de01"]
    assert [i for s, _, i in got if s == 2] == ["es00", "fr00", "it00", "pt00"]
    # The first long text is taken already as a pioneer, so the next one fills the last slot.
    assert [i for s, _, i in got if s == 3] == ["p00", "p01"] and [i for s, _, i in got if s == 5] == ["p03"]
    assert [i for s, _, i in got if s == 4] == ["asv00", "elb00", "kjv00", "luther00", "web00"]


def test_too_small(spark):
    few = [r for r in full() if r[2] in ("en", "de") and r[1] == "sop" and r[3] == "egw"]
    with pytest.raises(Exception, match="needs 8 entries, found 4"):
        plan_of(spark, few)
    assert len(plan_of(spark, few, least=4)) == 4
    with pytest.raises(Exception, match="found 0"):
        plan_of(spark, [])


@pytest.mark.parametrize("seed", range(4))
def test_first_come(spark, seed):
    """Any slots on any rows, against a plain loop."""
    rng = random.Random(seed)
    rows = [(f"i{i:03}", "sop", rng.choice("abc"), "egw", rng.choice(["u", "v", "w", None]), rng.randrange(10), rng.randrange(6)) for i in range(rng.choice([6, 80]))]
    tests = [(lambda r: r[6] < 4, F.col("n") < 4), (lambda r: r[2] == "a", F.col("lang") == "a"), (lambda r: r[5] > 3, F.col("tokens") > 3), (lambda r: True, F.lit(True))]
    slots, plain = [], []
    for k in range(5):
        test, where = rng.choice(tests)
        take, most, each = rng.randrange(1, 4), rng.randrange(1, 4), rng.random() < 0.4
        slots.append(fixtures.Slot(f"s{k}", where, take, F.col("bible") if each else None, most))
        plain.append((test, take, most, each))
    taken, want = set(), []
    for k, (test, take, most, each) in enumerate(plain):
        parts = sorted({r[4] for r in rows if test(r) and r[4] is not None})[:most] if each else [None]
        for part in parts:
            free = [r[0] for r in sorted(rows) if test(r) and (not each or r[4] == part) and r[0] not in taken][:take]
            taken.update(free)
            want += [(k, part or "", i) for i in free]
    assert plan_of(spark, rows, slots, least=0) == sorted(want)


def test_titles_fragment(spark):
    rows = [
        ("en", "A", "One", None, None, None, "A", 0), ("en", "A", "One", "x", 1888, "egw", "A", 1), ("en", "A", "Two", "y", 1900, None, "A/B", 2),
        ("de", "XA", "Eins", None, None, None, "de/ A ", 3), ("de", "XB", None, None, None, None, "XB", 4), (None, "Z", "lost", None, None, None, None, 5), ("de", "XC", None, None, None, None, "XC/", 6),
    ]
    books = spark.createDataFrame(rows, "lang string, book_code string, title string, author string, year long, corpus string, book_pair string, pos int").repartition(3)
    got = nested.titles_fragment(books).collect()
    assert json.loads(got[0].json) == {
        "en": {"A": {"titles": ["One", "Two"], "author": "x", "year": 1888, "corpus": "egw"}},
        "de": {"XA": {"titles": ["Eins"], "en_code": "A"}, "XB": {"titles": []}, "XC": {"titles": []}},
    }
    assert got[0].json.index('"de"') < got[0].json.index('"en"')
    assert [r.json for r in nested.titles_fragment(books.limit(0)).collect()] == ["{}"]


def test_answers(spark):
    queries = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "a")], "query_id long, query string")
    hits = spark.createDataFrame([(0, 1, 2, "h2", None), (0, 1, 1, "h1", "x"), (1, 2, 1, "f1", None), (3, 1, 1, "h1", None), (3, 2, 1, "f9", None), (9, 1, 1, "lost", None)], "query_id long, pass int, rank int, para_key string, author string")
    found = nested.answers(queries, hits.repartition(3), ["para_key", "author"])
    got = {r.query_id: ([h.para_key for h in r.hits], [h.para_key for h in r.fallbacks]) for r in found.collect()}
    assert got == {0: (["h1", "h2"], []), 1: ([], ["f1"]), 2: ([], []), 3: (["h1"], [])}
    text = {r.query_id: r.j for r in found.select("query_id", nested.results_json(found).alias("j")).collect()}
    assert text[0] == '{"query":"a","hits":[{"para_key":"h1","author":"x"},{"para_key":"h2"}],"fallbacks":[]}' and text[2] == '{"query":"c","hits":[],"fallbacks":[]}'


def test_union_and_specs(spark):
    verses = spark.createDataFrame([("kjv", "Gen.1.1", "b"), ("kjv", "Gen.1.1", "a"), ("kjv", "Gen.1.2", "c"), ("elb", "Gen.1.1", "d")], "bible string, osis string, text string")
    wanted = spark.createDataFrame([("kjv", 0, "Gen.1.1", 1), ("kjv", 0, "Gen.1.1", 0), ("elb", 1, "Gen.1.1", 0), ("elb", 1, "Gen.9.9", 2)], "bible string, bible_pos int, osis string, key_pos int")
    assert sorted(map(tuple, nested.editions_union(verses, wanted).collect())) == [(0, 0, "kjv", "Gen.1.1", "a"), (0, 1, "elb", "Gen.1.1", "d")]
    asked = spark.createDataFrame([(0, "A", "en"), (1, " A", "en "), (2, "B", ""), (3, "B", None), (4, "A", "de")], "pos int, code string, lang string")
    assert sorted(map(tuple, nested.ordered_specs(asked, "pos", "code", "lang").collect())) == [(0, "A", "en"), (2, "B", None), (4, "A", "de")]


def test_after_import(spark):
    vec = lambda k: [float(k), 1.0, 0.5]
    rows = [(f"a{i}", "en", "A", vec(i), "T", "x", "egw") for i in range(5)]
    rows += [(f"b{i}", "en", "B", vec(i), None, " ", "egw") for i in range(3)]
    rows += [("c0", "de", "C", [0.0, 0.0, 0.0], "T", "x", "egw"), ("c1", "de", "C", None, "T", "x", "egw"), ("c2", "de", "C", vec(2), "T", "x", "egw")]
    rows += [(f"d{i}", "de", "D", vec(1), "T", "x", "egw") for i in range(4)]
    points = spark.createDataFrame(rows, "id string, lang string, book_code string, vector array<float>, title string, author string, corpus string").repartition(3)
    books = spark.createDataFrame([("en", "A", 5), ("en", "B", 4), ("de", "C", 3), ("de", "D", 4), ("fr", "E", 1)], "lang string, book_code string, n long")
    got = sorted(map(tuple, checks.after_import(books, points).collect()))
    assert got == [("de", "C", "unreachable", "c0"), ("de", "C", "unreachable", "c1"), ("en", "B", "count", "4 3"), ("en", "B", "metadata", "author"), ("en", "B", "metadata", "title"), ("fr", "E", "count", "1 0")]
    assert checks.after_import(books.limit(0), points).count() == 0
