"""Collocations against brute force, the plan of the merge join, and the awkward cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import op12_collocations as op12

DOCS = "doc_id long, text string, lang string, piece long, m string, id int"


def brute(rows, least, longest, most, cover):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if c in op12.UPPER[:26] else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    found = {}
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    for (lang, w), a in candidates.items():
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        longer = [v for (other, x), v in candidates.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if not any(100 * v >= cover * a for v in longer):
            score, _, left, right = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, xs in found.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[:most]))


def frame(spark, rows):
    return spark.createDataFrame([(i % 5, t, lang, 7, "x", 1) for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["New", "york", "city", "of", "the", "é", "Über", "x" * 90, "a b"]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            part = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 7))]
            parts.append(rng.choice(["new york city", "of the", " ", "the the the the"]) if rng.random() < 0.4 else rng.choice([" ", "\t  "]).join(part))
        texts.append("".join(p + rng.choice([". ", ", ", "\n", " ", ";;", "!?"]) for p in parts))
    return [(t, rng.choice(["en", "de", None])) for t in texts] + [(texts[0], "en")] * 20 + [(None, "en"), ("", None), (" . ,\t", "fr"), ("one two " * 3000, "en")]


@pytest.mark.parametrize(("least", "longest", "most", "cover"), [(5, 4, 2000, 80), (2, 3, 7, 50), (30, 4, 3, 80), (1, 2, 2000, 100)])
def test_collocations(spark, rows, least, longest, most, cover):
    got = op12.collocations(frame(spark, rows), least, longest, most, cover).collect()
    want = brute(rows, least, longest, most, cover)
    assert want and sorted(tuple(r) for r in got) == want


def test_without_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(op12, "BROADCAST_GROUPS", 0)
    assert sorted(tuple(r) for r in op12.collocations(frame(spark, rows), 5).collect()) == brute(rows, 5, 4, 2000, 80)


def test_nothing(spark, rows):
    assert op12.collocations(frame(spark, []), 5).count() == 0
    assert op12.collocations(frame(spark, rows), 10_000).count() == 0
    with pytest.raises(ValueError, match="two words"):
        op12.collocations(frame(spark, rows), 5, 1)


def test_relations_are_merged_in_place(spark):
    """The join of adjacent positions neither shuffles nor sorts, and the caller's settings stay."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    with op12.settings(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__requireAllClusterKeysForCoPartition="false"):
        made = spark.range(4000).select((F.col("id") % 97).alias("piece"), F.col("id").cast("int").alias("pos"), (F.col("id") - 1).cast("int").alias("prev"), "id")
        relation = op12.Relation(made.repartition(4, "piece"), 4, ["piece", "pos"], ["piece", "prev"])
        x, y = relation.read(), relation.read(other=True).select("piece", F.col("prev").alias("pos"), F.col("id").alias("next"))
        pairs = x.join(y.hint("merge"), ["piece", "pos"])
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert pairs.count() == 0
        relation.drop()
    assert spark.conf.get(key) == before
