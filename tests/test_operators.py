import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import vectors as V
from lectern.operators import batches, checks, corpus, jobs, search
from lectern.operators.quotes import verify
from lectern.operators.store import Busy, CorpusStore


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_must_not_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r.x for r in df.where(corpus.none_of(F.col("x") == "a")).collect()} == {"b", None}
    assert rows(corpus.facet(df, "x")) == [("a", 1), ("b", 1)]


def test_context_clips_at_both_ends(spark):
    book = spark.createDataFrame([("en", "A", p, 1, 0) for p in range(1, 6)], "lang string, book_code string, page int, para int, chunk int")
    anchors = spark.createDataFrame([(0, "en", "A", 1, 1, 0), (1, "en", "A", 5, 1, 0)], "anchor_id int, lang string, book_code string, page int, para int, chunk int")
    got = corpus.context(book, anchors, ["lang", "book_code"], ["page", "para", "chunk"], 2, 1)
    assert sorted((r.anchor_id, r.page, r.is_target) for r in got.collect()) == [(0, 1, True), (0, 2, False), (1, 3, False), (1, 4, False), (1, 5, True)]


def test_page_cut(spark):
    def cut(pages, most, page_to=99):
        df = spark.createDataFrame([("A", p, i) for i, p in enumerate(pages)], "book string, page int, para int")
        got = corpus.page_cut(df, ["book"], "page", ["para"], F.lit(page_to), most).collect()
        return sorted(r.page for r in got), {r.next_page_from for r in got}

    assert cut([1, 1, 2, 2, 3], 4) == ([1, 1, 2, 2], {3})
    assert cut([1, 1, 2, 2, 3], 3) == ([1, 1], {2})
    assert cut([1, 1, 1, 1, 2], 3) == ([1, 1, 1, 1], {2})
    assert cut([1, 1, 1, 1], 3, page_to=1) == ([1, 1, 1, 1], {None})
    assert cut([1, 2], 3) == ([1, 2], {None})


def test_alignment_direction(spark):
    """The keys of the reverse map are the English ones; read the other way round nearly all pairs would be wrong."""
    de = spark.createDataFrame([("de", "X", "XDE", "5.1", ["0.1", "0.2"], "eins")], "lang string, book_pair string, book_code string, para_key string, aligned array<string>, raw_text string")
    en = spark.createDataFrame([("X", "0.1", "one"), ("X", "0.2", "two"), ("X", "5.1", "wrong")], "book_code string, para_key string, raw_text string")
    assert [(r.en_key, r.en_text) for r in corpus.aligned_originals(de, en).orderBy("pos").collect()] == [("0.1", "one"), ("0.2", "two")]
    assert rows(corpus.aligned_translations(en, de).select("para_key", "t_key")) == [("0.1", "5.1"), ("0.2", "5.1")]


def test_collided_keys_get_following_numbers(spark):
    df = spark.createDataFrame([("b", "1.1", 0, "first text"), ("b", "1.1", 5, "second text"), ("b", "1.2", 3, "third")], "book string, para_key string, pos int, text string")
    got = corpus.chunks_of(df, ["book", "para_key"], ["pos"]).orderBy("para_key", "seq").collect()
    assert [(r.para_key, r.seq, r.chunk, r.chunks, r.words) for r in got] == [("1.1", 0, 0, 1, 2), ("1.1", 1, 0, 1, 2), ("1.2", 0, 0, 1, 1)]


def test_citation_mode_first_seen_wins(spark):
    text = ["a CHR 1.1", "b ABC 1.2", "c ABC 1.3", "d CHR 1.4", "none"]
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(text)], "book string, pos int, text string")
    assert rows(corpus.citation_mode(df, ["book"], "pos").select("code", "n", "blocks")) == [("CHR", 2, 5)]
    assert corpus.citation_mode(df, ["book"], "pos", least=0.5).isEmpty()


def test_density_and_partition(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 0), ("c", 0)], "k string, seq int")
    assert [r.k for r in checks.density(df, ["k"], "seq").orderBy("k").collect()] == ["b", "c"]
    pieces = [("ok", 0, 0, 2), ("ok", 1, 1, 2), ("ok", 2, 0, 1), ("short", 0, 0, 2), ("start", 0, 1, 2), ("start", 1, 0, 1)]
    bad = checks.partition_violations(spark.createDataFrame(pieces, "k string, seq int, chunk int, chunks int"), ["k"], "seq", "chunk", "chunks")
    assert rows(bad) == [("short", 1), ("start", 0)]


def test_reconcile_both_directions(spark):
    a = spark.createDataFrame([("en", "A", 2), ("es", "A", 1), ("de", "B", 1)], "lang string, code string, n long")
    b = spark.createDataFrame([("en", "A", 2), ("es", "A", 2), ("fr", "C", 3)], "lang string, code string, n long")
    assert rows(checks.reconcile(a, b, ["lang", "code"])) == [("de", "B", 1, 0), ("es", "A", 1, 2), ("fr", "C", 0, 3)]


def test_preflight(spark):
    new = spark.createDataFrame([("A", "s1"), ("B", "s2"), ("C", None), ("D", "s4")], "code string, slug string")
    old = spark.createDataFrame([("A", "s1"), ("B", "other"), ("C", "s3")], "code string, slug string")
    assert rows(checks.identity_probe(new, old, ["code"], "slug").select("code", "status")) == [("A", "re-index"), ("B", "collision"), ("C", "re-index"), ("D", "new")]
    titles = spark.createDataFrame([("T", "A", "x"), ("U", "B", None)], "title string, code string, author string")
    stored = spark.createDataFrame([("T", "Z", "y"), ("T", "Y", "x"), ("U", "W", "q"), ("T", "A", "x")], "title string, code string, author string")
    assert rows(checks.same_title(titles, stored).select("code", "other_code")) == [("A", "Y"), ("B", "W")]


def test_gate_statuses(spark):
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    fixture = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id int, w array<double>")
    got = checks.cosine_gate(stored, fixture, V.cosine(F.col("v"), F.col("w")), 0.95, 0.999)
    assert rows(got.select("id", "status")) == [(1, "suspicious"), (2, "below"), (3, "missing")]


def test_search_filters_ties_and_blocks(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.9, 0.1], "b"), (4, [0.0, 1.0], None), (5, None, "a")], "id long, vector array<double>, g string")
    queries = spark.createDataFrame([(10, [2.0, 0.0], "a"), (11, [0.0, 1.0], None), (12, [0.9, 0.1], "b")], "query_id long, vector array<double>, g string")
    for block in (1, 100):
        got = rows(search.cosine_topk(points, queries, 2, 0.5, ("g",), block).select("query_id", "rank", "id"))
        assert got == [(10, 1, 1), (10, 2, 2), (12, 1, 3)]
    two = search.two_pass(points, queries, 1, 0.5, ("g",))
    assert rows(two.select("query_id", "pass", "id")) == [(10, 1, 1), (11, 2, 4), (12, 1, 3)]


def test_store(spark, tmp_path):
    store = CorpusStore(spark, f"file://{tmp_path}/points", keep=3)
    frame = lambda *r: spark.createDataFrame(list(r), "id string, x int")
    assert store.read() is None
    store.upsert(frame(("a", 1), ("b", 2)))
    assert store.dry_run(frame(("b", 9), ("c", 3))) == {"new": 1, "overwritten": 1, "total": 3}
    store.upsert(frame(("b", 9), ("c", 3)))
    assert rows(store.read()) == [("a", 1), ("b", 9), ("c", 3)]
    store.rollback()
    assert rows(store.read()) == [("a", 1), ("b", 2)]
    store.upsert(frame(("n", None)))
    store.delete(F.col("x") == 1)
    assert {r.id for r in store.read().collect()} == {"b", "n"}
    store.delete_ids(frame(("b", 0)))
    assert [r.id for r in store.read().collect()] == ["n"] and len(store.versions()) == 3
    with store._locked(), pytest.raises(Busy):
        store.upsert(frame(("z", 1)))
    store.check_fingerprint("f1")
    store.check_fingerprint("f1")
    with pytest.raises(ValueError):
        store.check_fingerprint("f2")


def test_store_survives_crashes(spark, tmp_path, monkeypatch):
    """A change that dies at any step leaves what was there before; a dead writer's lock does not block for ever."""
    store = CorpusStore(spark, f"file://{tmp_path}/points", parts=4)
    frame = lambda *r: spark.createDataFrame(list(r), "id string, x int")
    store.upsert(frame(*((str(i), i) for i in range(20))))
    before = rows(store.read())

    def died(*_):
        raise RuntimeError("dead")

    with pytest.raises(RuntimeError):
        store._commit(died)
    with monkeypatch.context() as m:  # after the rows, before the pointer
        m.setattr(store, "_point", died)
        with pytest.raises(RuntimeError):
            store.upsert(frame(("1", 99)))
    assert rows(store.read()) == before
    (tmp_path / "points" / "pointer-9.json").write_text('{"versions": [')  # torn
    assert rows(store.read()) == before
    store.upsert(frame(("1", 100), ("1", 7), ("new", 5)))
    assert dict(rows(store.read())) == dict(before) | {"1": 100, "new": 5}
    assert rows(CorpusStore(spark, store.path).read()) == rows(store.read())
    (tmp_path / "points" / "LOCK").touch()
    with pytest.raises(Busy):
        store.upsert(frame(("z", 1)))
    CorpusStore(spark, store.path, stale=-1).upsert(frame(("z", 1)))
    assert "z" in dict(rows(store.read()))
    folders = {f for v in store._state()["versions"][-1]["parts"].values() for f in [v]}
    assert len(folders) > 1  # only touched parts were written anew


def test_violations(spark):
    books = spark.createDataFrame([("en", "A", None, "T", "me", "egw", "s1"), ("de", "B", None, "U", "", "egw", "s2"), ("de", "C", "A/B", "V", "you", "egw", None)], "lang string, book_code string, book_pair string, title string, author string, corpus string, slug string")
    stored = spark.createDataFrame([("en", "A", "T", "me", "other"), ("en", "Z", "T", "me", "s9")], "lang string, book_code string, title string, author string, slug string")
    ids = spark.createDataFrame([("en", "A", 1), ("en", "A", 2), ("de", "B", 3)], "lang string, book_code string, id int")
    got = rows(checks.import_violations(books, stored, ids, ids.where("id < 3").select("id")))
    assert got == [("collision", "en:A", "s1"), ("metadata", "de:B", "author"), ("no original", "de:B", ""), ("overwrite", "en:A", "2"), ("pair code", "de:C", "A/B"), ("same title", "A", "Z")]
    points = spark.createDataFrame([("en", "A", None), ("en", "A", None), ("de", "D", "A")], "lang string, book_code string, book_pair string")
    asked = spark.createDataFrame([("en", "A", 3), ("en", "X", None)], "lang string, book_code string, n long")
    assert rows(checks.delete_violations(asked, points)) == [("count", "en:A", "2"), ("no points", "en:X", ""), ("paired", "en:A", "de:D")]
    assert rows(checks.left_over(asked, points)) == [("en", "A", 2)]
    verses = spark.createDataFrame([("kjv", "Gen.1.1", None), ("kjv", "Gen.1.1", None), ("kjv", "Gen.01.2", 4), ("K V", "Gen.1.3", None)], "bible string, osis string, page int")
    assert {(r.rule, r.subject) for r in checks.bible_violations(verses, "bible", "osis").collect()} == {("edition", "K V"), ("key", "kjv"), ("duplicate", "kjv"), ("forbidden", "kjv")}
    packs = spark.createDataFrame([("sop", "a"), ("sop", "b")], "profile string, id_rule string")
    assert rows(checks.agreement(packs)) == [("id_rule", 2)]


def test_stages(spark):
    log = spark.createDataFrame([("j", "open", "ok"), ("j", "preflight", "ok"), ("j", "write", "failed")], "job string, stage string, status string")
    assert [r.stage for r in jobs.stages_to_run(log, "job").orderBy("position").collect()] == ["open", "contract", "probe", "write", "verify", "report"]
    states = spark.createDataFrame([("a", "running"), ("b", "done")], "job string, status string")
    assert rows(jobs.interrupted(states)) == [("a", "interrupted"), ("b", "done")]
    seen = []
    with pytest.raises(ZeroDivisionError):
        jobs.run_stages({"open": lambda: None, "preflight": lambda: seen.append("no"), "write": lambda: 1 / 0}, {"open", "preflight"}, lambda *x: seen.append(x))
    assert seen == [("open", "running"), ("open", "ok"), ("write", "running"), ("write", "failed")]
    events = spark.createDataFrame([("j", 2.0, 10, 40), ("j", 5.0, 20, 40), ("k", 0.0, 0, 3)], "job string, elapsed_s double, done int, total int")
    assert rows(jobs.pace(events, "job").select("job", "rate", "eta_s")) == [("j", 4.0, 5.0), ("k", None, None)]


def test_jobs(spark):
    events = spark.createDataFrame([("j", 3), ("j", 1), ("k", 2)], "job string, at int")
    numbered = jobs.numbered(events, "job", ["at"])
    assert rows(numbered) == [("j", 1, 0), ("j", 3, 1), ("k", 2, 0)]
    cursors = spark.createDataFrame([("j", 0), ("k", 0), ("none", 4)], "job string, after long")
    assert rows(jobs.poll(numbered, cursors, "job")) == [("j", 0, 1, 2), ("k", 0, 0, 1), ("none", 4, 0, 5)]
    parts = spark.createDataFrame([("u", 0), ("u", 1), ("u", 1), ("u", 4), ("v", 1)], "upload string, n int")
    assert rows(jobs.upload_gaps(parts, "upload", "n").select("upload", "n")) == [("u", 4), ("v", 1)]


def test_batches(spark):
    tokens = [5, 100, 7, 7, 3, 1, 0]
    got = batches.plan_batches(spark.createDataFrame(list(enumerate(tokens)), "id long, tokens long"), 14).orderBy("batch", "id").collect()
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r.id)
    assert list(by.values()) == [[1], [2, 3], [0, 4], [5, 6]]


def test_quotes(spark):
    quotes = spark.createDataFrame([(1, "Hello, big World."), (2, "not there"), (3, "other words"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(7, "x Hello, big World. y"), (8, "hello big   world"), (9, "another word, OTHER: words!"), (10, None)], "doc_id long, text string")
    assert rows(verify(quotes, docs)) == [(1, "exact", 2, 7), (2, "none", 0, None), (3, "normalised", 1, 9)]


def test_file_stream(spark, tmp_path):
    from lectern.streaming.events import append_new, hourly, hourly_stream

    rows_ = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 1.0d as value union all select timestamp'2024-01-01 03:00:00', 2.0d")
    rows_.write.parquet(f"{tmp_path}/in")
    query = hourly_stream(spark, f"{tmp_path}/in", rows_.schema).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("hours")) == rows(hourly(rows_))
    for _ in range(2):
        append_new(spark, f"{tmp_path}/in", rows_.schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_same_title_pairs(spark, monkeypatch):
    """Each pair once, also of codes with several authors; pairs are not shuffled to be told apart."""
    rng = random.Random(6)
    made = lambda n: [(rng.choice(["A", "B", None]), rng.randrange(12), rng.choice(["x", "y", "z", "z", None])) for _ in range(n)]
    mine, other = made(40), made(40)
    want = sorted({(t, c, d) for t, c, a in mine for u, d, b in other if t is not None and t == u and c != d and (a is None or b is None or a == b)})
    sides = [spark.createDataFrame(x, "title string, code long, author string") for x in (mine, other)]
    assert sorted(map(tuple, checks.same_title(*sides).collect())) == want
    plan = checks.same_title(*sides)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0] and "Aggregate" in plan
    monkeypatch.setattr(checks, "BROADCAST_HOLDERS", 0)
    assert sorted(map(tuple, checks.same_title(*sides).collect())) == want
