"""Tables dealt by language and book, reports, and coverage."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import osis
from lectern.operators import checks, corpus, reports
from lectern.operators.store import CorpusStore

POINTS = "id string, lang string, book_code string, n long"


def points(spark, n, shift=0):
    rows = [(f"{lang}:{b}:{i}", lang, b, i + shift) for lang in ("en", "de") for b in ("A", "B", "C", None) for i in range(n)]
    return spark.createDataFrame(rows, POINTS).repartition(3)


def content(df):
    return sorted((r.id, r.n) for r in df.collect())


def test_by_book(spark, tmp_path):
    store = CorpusStore(spark, f"{tmp_path}/s", parts=32, by=("lang", "book_code"), spread=4)
    assert store.read_only(lang="en", book_code="A") is None
    store.upsert(points(spark, 20))
    only = store.read_only(lang="de", book_code="B")
    assert content(only) == [(f"de:B:{i}", i) for i in sorted(range(20), key=str)]
    # Only the parts of that book are opened, and there are several of them.
    files = only.inputFiles()
    parts = {f.split("_part=")[1].split("/")[0] for f in store.read().inputFiles()}
    group = store.spark.range(1).select(store._group(store._state(), F.lit("de"), F.lit("B"))).first()[0]
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan.split("PartitionFilters: [")[1].split("]")[0] and files
    own = spark.read.parquet(*files).where("lang = 'de' and book_code = 'B'")
    assert own.count() == 20 and len(parts) > 4
    kept = {int(r[0]) for r in spark.read.parquet(*{f.split("_part=")[0] for f in files}).where("lang = 'de' and book_code = 'B'").select("_part").distinct().collect()}
    assert kept <= set(range(group * 4, group * 4 + 4)) and len(kept) > 1
    # A change touches the parts of its book; the others stay as they were.
    before = {k: v for k, v in store._state()["versions"][-1]["parts"].items()}
    store.upsert(points(spark, 3, 100).where("lang = 'en' and book_code = 'C'"))
    after = store._state()["versions"][-1]["parts"]
    assert 0 < sum(before[k] != after[k] for k in before) <= 4
    assert content(store.read_only(lang="en", book_code="C"))[:3] == [("en:C:0", 100), ("en:C:1", 101), ("en:C:10", 10)]
    store.delete_ids(spark.createDataFrame([("en:C:0",)], "id string"))
    assert store.read().count() == 159
    assert store.read_only(lang="xx", book_code="A").count() == 0
    with pytest.raises(ValueError, match="value is needed"):
        store.read_only(lang="en")
    with pytest.raises(ValueError, match="is dealt by"):
        CorpusStore(spark, f"{tmp_path}/s", parts=32).upsert(points(spark, 1))


def test_dealt_by_key(spark, tmp_path):
    store = CorpusStore(spark, f"{tmp_path}/s", parts=8)
    store.upsert(points(spark, 5))
    with pytest.raises(ValueError, match="value is needed"):
        store.read_only(lang="en")
    assert store.read().count() == 40


def test_coverage(spark):
    rows = [("kjv", "Gen.1.1", 1), ("kjv", "Gen.1.2", 2), ("kjv", "Gen.1.2", 2), ("kjv", "Rev.22.21!a", 1), ("kjv", "Gen.0.1", 1), ("kjv", None, None), ("x", "Odd", 1)]
    got = {r.bible: r for r in checks.coverage(spark.createDataFrame(rows, "bible string, osis string, chunks int"), "bible", "osis", "chunks").collect()}
    k = got["kjv"]
    assert (k.books, k.chapters, k.verses, k.split, k.invalid) == (2, 2, 4, 2, 2) and k.missing == [b for b in osis.BOOKS if b not in ("Gen", "Rev")]
    assert (got["x"].books, got["x"].verses, got["x"].invalid, len(got["x"].missing)) == (0, 0, 1, 66)


def test_groups_and_ids(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "egw"), ("c", None, "pioneers"), ("d", 4, "")], "id string, n int, corpus string")
    n = F.col("n")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(df.where(corpus.any_of([[n > 3], [n < 3, F.col("corpus").isNotNull()]]))) == ["b", "d"] and ids(df.where(corpus.any_of([]))) == []
    asked = spark.createDataFrame([("d", 0), ("zz", 1), ("a", 2), ("d", 3), (None, 4)], "id string, pos int")
    assert [r.id for r in corpus.retrieved(df, asked).orderBy("pos").collect()] == ["d", "a"]
    assert ids(corpus.attributable(df)) == ["a", "b", "d"]


def test_reports(spark, tmp_path, monkeypatch):
    facts = spark.createDataFrame([("b", 2, None), ("a|x\ny", 1, 0.5)], "name string, n int, share double")
    lines = [r.text for r in reports.markdown("Run", facts, ["n"]).orderBy("line").collect()]
    assert lines == ["# Run", "", "| name | n | share |", "|---|---|---|", "| a\\|x y | 1 | 0.5 |", "| b | 2 |  |"]
    reports.write_report("Run", facts, ["n"], f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/report.md").collect()] == lines
    (text,) = [r.value for r in spark.read.text(f"{tmp_path}/out/report.json").collect()]
    assert json.loads(text) == [{"name": "a|x\ny", "n": 1, "share": 0.5}, {"name": "b", "n": 2, "share": None}]
    monkeypatch.setattr(reports, "MOST", 1)
    with pytest.raises(Exception, match="at most 1 rows, not 2"):
        reports.json_text(facts, ["n"]).collect()
