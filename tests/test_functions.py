import random
import uuid

import pytest
from pyspark.sql import functions as F

from lectern.functions import ids, osis, vectors
from lectern.functions import text as T


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, expression, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(expression).first()[0]


CASES = [
    ("sop/plain", {"lang": "en", "book_code": "WDYS", "para_key": "1.1"}, "en:WDYS:1.1"),
    ("sop/plain", {"lang": "de", "book_code": "Ünïcödé-Büch", "para_key": "Kapítel§1"}, "de:Ünïcödé-Büch:Kapítel§1"),
    ("sop/seq", {"lang": "ko", "book_code": "테스트", "para_key": "1.1", "seq": 5}, "ko:테스트:1.1#5"),
    ("bible/v1", {"bible": "kjv", "osis": "Gen.1.1"}, "bible:kjv:Gen.1.1"),
]


@pytest.mark.parametrize(("rule", "fields", "want"), CASES)
def test_uid_and_uuid5(spark, rule, fields, want):
    df = spark.createDataFrame([tuple(fields.values())], list(fields)).select(ids.uid(ids.RULES[rule]).alias("u"))
    got = df.select("u", ids.uuid5(F.col("u"))).first()
    assert tuple(got) == (want, str(uuid.uuid5(uuid.NAMESPACE_DNS, want)))


def test_known_identifiers(spark):
    known = {"en:WDYS:1.1": "6cb14643-3cc8-5e9e-aa51-ba57cc137475", "de:GC:12.7": "0fb79068-d263-59e7-b88d-2d7e59d78607", "en:WDYS:1.1#3": "4c07d5a4-9553-55eb-bcb3-731258cabb9d"}
    df = spark.createDataFrame([(k,) for k in known], "u string").select("u", ids.uuid5(F.col("u")))
    assert dict(rows(df)) == known


def test_missing_field_is_an_error(spark):
    df = spark.createDataFrame([("en", None, "1.1")], "lang string, book_code string, para_key string")
    with pytest.raises(Exception, match="missing field"):
        df.select(ids.uid(ids.RULES["sop/plain"])).collect()


def test_sequence_of(spark):
    df = spark.createDataFrame([("a#3",), ("a",), ("a#b#12",), ("a#x",)], "u string")
    assert [r[0] for r in df.select(ids.sequence_of(F.col("u"))).collect()] == [3, 0, 12, 0]


def expand(spark, ref):
    return [r.key for r in osis.expand_refs(spark.createDataFrame([(ref,)], "ref string")).orderBy("key_pos").collect()]


def test_expand_refs(spark):
    assert expand(spark, "John.3.16") == ["John.3.16"]
    assert expand(spark, "John.3.16-18") == ["John.3.16", "John.3.17", "John.3.18"]
    assert expand(spark, "John.3.18-16") == []
    assert len(expand(spark, "Ps.23")) == 176 and len(expand(spark, "Ps.23-24")) == 352
    across = expand(spark, "John.3.175-John.4.2")
    assert across == ["John.3.175", "John.3.176", "John.4.1", "John.4.2"]
    for bad in ("John", "John.3.1-Mark.1.1", "x.y.z"):
        with pytest.raises(Exception, match="not a reference"):
            expand(spark, bad)


def test_strict_verses_and_order(spark):
    df = spark.createDataFrame([("Gen.1.1",), ("Gen.01.1",), ("Exod.22.3!a",), ("Foo.1.1",), ("Gen.1.0",)], "k string")
    assert [r[0] for r in df.select(osis.is_verse(F.col("k"))).collect()] == [True, False, True, False, False]
    keys = ["Rev.1.1", "Gen.2.1", "Gen.1.10", "Gen.1.9!b", "Gen.1.9", "Gen.1.9!a"]
    ordered = spark.createDataFrame([(k,) for k in keys], "k string").orderBy(osis.canonical_order(F.col("k")))
    assert [r[0] for r in ordered.collect()] == ["Gen.1.9", "Gen.1.9!a", "Gen.1.9!b", "Gen.1.10", "Gen.2.1", "Rev.1.1"]


def plain_split(text, target=220, most=300):
    import re

    if len(text.split()) <= most:
        return [text]
    parts, cur, n = [], [], 0
    for s in re.split("(?<=[.!?;:])[\"”’']?\\s+", text):
        w = len(s.split())
        if cur and n + w > target:
            parts, cur, n = [*parts, " ".join(cur)], [], 0
        cur.append(s)
        n += w
    parts += [" ".join(cur)] if cur else []
    out = []
    for p in parts:
        w = p.split()
        out += [p] if len(w) <= most else [" ".join(w[i : i + target]) for i in range(0, len(w), target)]
    return [p for p in out if p.strip()]


def test_split_long(spark):
    sentence = lambda n, tag: " ".join(f"{tag}{i}" for i in range(n)) + "."
    cases = ["short text.", " ".join(sentence(30, c) for c in "abcdefghijklmnop"), sentence(700, "w"), sentence(100, "a") + " " + sentence(350, "b") + ' "' + sentence(20, "c")]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select(T.split_long(F.col("t")))
    assert [r[0] for r in df.collect()] == [plain_split(c) for c in cases]


def test_gate(spark):
    good = "This is a plain sentence of readable words that passes every gate here."
    cases = {good: None, "too short": "short", "xkcd bcdfg hjklm npqrs tvwxz bcdfg hjklm npqrs": "damage", "Élève naïve à côté où ça été là près après très": "damage", good + " ж" * 10: "junk"}
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", T.gate_reason(F.col("t")))
    got = dict(rows(df))
    assert got[good] is None and got["too short"] == "short" and got["xkcd bcdfg hjklm npqrs tvwxz bcdfg hjklm npqrs"] == "damage" and got[good + " ж" * 10] == "junk"
    message = spark.createDataFrame([("two words",)], "t string").select(T.gate_message(F.col("t"))).first()[0]
    assert message == "too short (2 word(s) < 8)"


def test_citation_and_marks(spark):
    df = spark.createDataFrame([("Some text here. CHR 24.1",), ("no code",), ("[12]",)], "t string")
    code, page, para, before = T.citation(F.col("t"))
    got = rows(df.select(code, page, para, before, T.page_mark(F.col("t"))))
    assert got[0][:4] == ("CHR", 24, 1, "Some text here.") and got[1][0] is None and got[2][4] == 12
    keys = spark.createDataFrame([("5.12",), ("5",), ("a.b",)], "k string").select(T.page_para(F.col("k")).alias("p")).select("p.*")
    assert rows(keys) == [(5, 12), (0, 0), (0, 0)]


def test_folding(spark):
    assert one(spark, T.folded(F.col("t")), t="STRAßE") == "strasse"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(F.round(vectors.cosine(F.col("a"), F.col("b")), 6)).collect()]
    assert got == [0.707107, 0.0]
    tokens = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    pooled = tokens.select(vectors.mean_pool(F.col("v"), F.col("m"))).first()[0]
    assert [round(x, 6) for x in pooled] == [0.447214, 0.894427]


def test_measures(spark, monkeypatch):
    """Each count is what its pattern finds, also in texts that are cut; one look at the text, not a pattern for each count."""
    rng = random.Random(5)
    signs = list("aAeEbBxXyY'’ \t\x0b\x1c\x85\u00a0\u2003\u3000\ufeff^~`|\\{}<>.,é—§ж漢😀0") + ["word ", "McDonald ", "'TIS ", "xkcd "]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(40)))) for i in range(600)] + [(600, None), (601, ""), (602, "a" * 300 + " bCd" * 300)]
    docs = spark.createDataFrame(rows, "i long, text string").repartition(2)
    bad, found = T.damage_parts(F.col("text"))
    by_pattern = docs.select("i", T.word_count(F.col("text")).alias("words"), bad.alias("bad"), found.alias("found"), F.length("text").alias("chars"), F.length(F.regexp_replace("text", T.CLEAN, "")).alias("clean"))
    want = {r.i: tuple(r)[1:] for r in by_pattern.collect()}
    got = T.measured(docs, "text").select("i", "m.*")
    assert got.columns[1:] == list(T.MEASURES)
    assert {r.i: tuple(r)[1:] for r in got.collect()} == want
    monkeypatch.setattr(T, "BLOCK", 50)
    whole = [r for r in rows if r[1] is not None]
    assert [tuple(m) for m in T.measures([t for _, t in whole]).tolist()] == [want[i] for i, _ in whole]
    plan = T.measured(docs, "text").where(T.reason_of().isNotNull())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_measured(") == 1 and "regexp" not in plan
