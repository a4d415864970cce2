"""One pass of rules against the separate checks, its plan, and the awkward cases."""

import random

from pyspark.sql import functions as F

from lectern.operators import checks, rules

BLOCKS = "book string, para_key string, seq long, chunk long, chunks long, text string, title string, lang string, book_code string, corpus string, author string, year int, profile string, id_rule string, target_profile string, target_contract string"


def frame(spark, rows):
    return spark.createDataFrame(rows, BLOCKS).repartition(3)


def block(book, key, seq, chunk, chunks, text="t", **more):
    fields = dict(title="T", lang="en", book_code="B", corpus=None, author=None, year=None, profile="sop", id_rule="sop/seq", target_profile="sop", target_contract="c1") | more
    return (book, key, seq, chunk, chunks, text, *fields.values())


def test_as_the_separate_checks(spark):
    rng = random.Random(5)
    rows = []
    for b in range(4):
        for k in range(60):
            seq = 0
            for _ in range(rng.randrange(1, 4)):
                chunks = rng.randrange(1, 4)
                for c in range(chunks):
                    for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 1, 1, 1, 2, 3]) if rng.random() < 0.3 else 1):
                        rows.append(block(f"b{b}", f"k{k}", seq, c, chunks if rng.random() < 0.97 else chunks + 1, rng.choice(["x", "x", "x", " ", None]) if rng.random() < 0.1 else "x"))
                    seq += 1
    df = frame(spark, rows)
    found = {(r.rule, r.book, r.detail.partition("#")[0] if r.rule == "empty text" else r.detail) for r in rules.violations(df, ["book"]).collect()}
    want = {tuple(r) for r in checks.book_violations(df, ["book"]).collect()}
    assert found == want and len({r for r, _, _ in want}) == 4
    # A number that stands three times is named once.
    each = [tuple(r) for r in rules.violations(df, ["book"]).where("rule = 'duplicate'").collect()]
    assert len(each) == len(set(each))


def test_one_scan_and_one_shuffle(spark, tmp_path):
    frame(spark, [block("b", "k", i, 0, 1) for i in range(50)]).write.parquet(f"{tmp_path}/blocks")
    df = rules.violations(spark.read.parquet(f"{tmp_path}/blocks"), ["book"], "c1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_books_and_report(spark):
    rows = [block("a", f"k{i}", 0, 0, 1, title=None, lang=" ", corpus="other", year=0, author="x") for i in range(30)]
    rows += [block("b", "k", 0, 0, 1, id_rule="bible/v1", target_profile="bible", target_contract=None)] * 2
    rows += [block("c", "v", 0, 0, 1, profile="bible", id_rule="bible/v1", target_profile="bible", corpus="other"), block("d", "v", 0, 0, 1, id_rule=None)]
    rows += [block("e", f"k{i:02}", 0, 0, 1, text=None) for i in range(25)]
    rows += [block("f", None, None, None, None), block("f", None, 0, 0, 1)]
    got = {(r.book, r.rule): (r.n, r.listed) for r in rules.report(rules.violations(frame(spark, rows), ["book"], "c1"), ["book"]).collect()}
    assert got == {
        ("a", "metadata"): (2, ["lang", "title"]),
        ("b", "id rule"): (1, ["bible/v1"]),
        ("b", "target"): (2, ["contract", "profile"]),
        ("b", "duplicate"): (1, ["k#0"]),
        ("b", "density"): (1, ["k"]),
        ("b", "partition"): (1, ["k"]),
        ("d", "id rule"): (1, ["none"]),
        ("e", "empty text"): (25, [f"k{i:02}#0" for i in range(10)]),
        ("f", "density"): (1, ["none"]),
        ("f", "partition"): (1, ["none"]),
    }


def test_without_fields(spark):
    df = frame(spark, [block("a", "k", 0, 0, 1)]).select("book", "para_key", "seq", "chunk", "chunks", "text", F.lit("x").alias("bad"))
    assert {(r.rule, r.detail) for r in rules.violations(df, ["book"]).collect()} == {("metadata", f) for f in rules.REQUIRED}
    assert rules.violations(df.limit(0), ["book"]).count() == 0
