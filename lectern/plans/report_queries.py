"""Queries of the reports on books, packs and calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import vectors as V
from ..operators import checks, rules
from ..sources import contract, packs
from .registry import Tables, query, scratch_folder

#: Each vector beside the following one, as a calibration beside its fixture; the last has none.
COMPARED = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT a.id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a LEFT JOIN v b ON b.id = a.id + 1)
"""


def _compared(t: Tables) -> DataFrame:
    mine = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("own"))
    other = t.embeddings.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("other"))
    return mine.join(other, "id", "left").select("id", F.round(V.cosine(F.col("own"), F.col("other")), 6).alias("cosine"))


@query(COMPARED + "SELECT count(*) AS n, count(*) FILTER (cosine IS NULL) AS missing, min(cosine) AS least, round(avg(cosine), 6) AS mean FROM c")
def calibration_summary(t: Tables) -> DataFrame:
    facts, _ = checks.cosine_summary(_compared(t))
    return facts.withColumn("mean", F.round("mean", 6))


@query(COMPARED + "SELECT id, cosine FROM c WHERE cosine IS NOT NULL ORDER BY cosine, id LIMIT 10")
def calibration_worst(t: Tables) -> DataFrame:
    """The ten worst entries: the limit is the report's own."""
    return checks.cosine_summary(_compared(t), worst=10)[1]


@query("""WITH v AS (SELECT 'c' || label AS collection, vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT collection, id, list_transform(e, lambda x: x + (id % 4) * 0.02::DOUBLE) AS e FROM v WHERE id % 9 <> 0),
j AS (SELECT collection, v.id, CASE WHEN v.id % 2 = 0 THEN 0.99::DOUBLE END AS expected, round(list_cosine_similarity(v.e, s.e), 6) AS cosine FROM v LEFT JOIN s USING (collection, id))
SELECT collection, id, cosine, CASE WHEN cosine IS NULL THEN 'missing' WHEN cosine < greatest(0.95::DOUBLE, coalesce(expected, 0)) THEN 'below' ELSE 'ok' END AS status FROM j""")
def canary_probe(t: Tables) -> DataFrame:
    """Vectors as canaries; what is stored lacks every ninth and lies a little beside three of four."""
    vectors = t.embeddings.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    stored = vectors.where("id % 9 <> 0").select("collection", "id", F.transform("e", lambda x: x + (F.col("id") % 4) * 0.02).alias("stored"))
    canaries = vectors.withColumn("cosine_expected_min", F.when(F.col("id") % 2 == 0, 0.99))
    return checks.canary_gate(canaries, stored, V.cosine(F.col("e"), F.col("stored"))).select("collection", "id", "cosine", "status")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def fixture_uncovered(t: Tables) -> DataFrame:
    fixture = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "bible").otherwise("sop").alias("profile"))
    points = t.embeddings.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    return checks.uncovered(fixture, points, "sop").select("id")


@query("""WITH b AS (SELECT source AS book, doc_id // 5 AS para_key, doc_id % 3 % 2 AS chunk, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS chunks FROM documents),
k AS (SELECT book, para_key, count(*) AS n, count(*) FILTER (chunk = 0) AS heads, count(*) FILTER (chunks > 1) AS split FROM b GROUP BY ALL)
SELECT book, sum(n)::BIGINT AS blocks, sum(heads)::BIGINT AS paragraphs, count(*) FILTER (heads > 1) AS collided, sum(split)::BIGINT AS split FROM k GROUP BY book""")
def inspect_counts(t: Tables) -> DataFrame:
    """Documents as blocks, five under one key."""
    blocks = t.documents.select(F.col("source").alias("book"), F.floor(F.col("doc_id") / 5).alias("para_key"), (F.col("doc_id") % 3 % 2).alias("chunk"), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1).alias("chunks"))
    return checks.inspected(blocks, ["book"])


@query("""WITH i AS (SELECT source AS book_code, count(*) AS paragraphs, min(n_chars) AS shortest FROM documents WHERE lang = 'en' AND source IS NOT NULL GROUP BY source),
p AS (SELECT DISTINCT source AS code, lang || ':' || source AS pair FROM documents WHERE lang <> 'en' AND source IS NOT NULL),
n AS (SELECT code, count(*) AS n, min(pair) AS first FROM p GROUP BY code)
SELECT book_code, paragraphs, shortest, coalesce(n, 0) AS translations, first AS first_translation FROM i LEFT JOIN n ON code = book_code""")
def books_described(t: Tables) -> DataFrame:
    """English sources as originals, the other languages of the same source as their translations."""
    docs = t.documents.where("source is not null")
    index = docs.where("lang = 'en'").groupBy(F.col("source").alias("book_code")).agg(F.count(F.lit(1)).alias("paragraphs"), F.min("n_chars").alias("shortest"))
    translations = docs.select("lang", F.col("source").alias("code"), F.col("source").alias("book_pair"))
    return checks.described(index, checks.paired(index.select(F.col("book_code").alias("code")), translations))


@query("""WITH b AS (SELECT conv_id::VARCHAR AS book, (turn // 3)::VARCHAR AS para_key, turn % 3 AS seq, CASE WHEN conv_id % 4 = 0 THEN 2 ELSE 3 END AS chunks, text FROM conversations WHERE conv_id % 7 <> 0 OR turn <> 1),
g AS (SELECT *, sum(CASE WHEN seq = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book, para_key ORDER BY seq) AS grp FROM b),
p AS (SELECT book, para_key, grp, count(*) AS n, min(chunks) AS a, max(chunks) AS z, min(seq) AS c, max(seq) AS d, count(DISTINCT seq) AS e FROM g GROUP BY ALL)
SELECT 'empty text' AS rule, book AS subject, para_key AS detail FROM b WHERE coalesce(trim(text), '') = ''
UNION ALL SELECT 'duplicate', book, para_key || '#' || seq FROM b GROUP BY book, para_key, seq HAVING count(*) > 1
UNION ALL SELECT 'density', book, para_key FROM b GROUP BY book, para_key HAVING min(seq) <> 0 OR max(seq) <> count(*) - 1 OR count(DISTINCT seq) <> count(*)
UNION ALL SELECT DISTINCT 'partition', book, para_key FROM p WHERE grp = 0 OR a <> z OR n <> z OR c <> 0 OR d <> n - 1 OR e <> n""")
def book_report(t: Tables) -> DataFrame:
    """Conversations as books, three turns to a paragraph; every seventh lacks its second turn."""
    seq = F.col("turn") % 3
    rows = t.conversations.where("conv_id % 7 <> 0 or turn <> 1")
    blocks = rows.select(F.col("conv_id").cast("string").alias("book"), F.floor(F.col("turn") / 3).cast("string").alias("para_key"), seq.alias("seq"), seq.alias("chunk"), F.when(F.col("conv_id") % 4 == 0, 2).otherwise(3).alias("chunks"), "text")
    return checks.book_violations(blocks, ["book"])


@query("""WITH v AS (SELECT count(DISTINCT coalesce(lang, '')) AS a, count(DISTINCT coalesce(source, '')) AS b FROM documents)
SELECT * FROM (SELECT 'profile' AS "column", a AS "values" FROM v UNION ALL SELECT 'id_rule', b FROM v) WHERE "values" > 1""")
def pack_agreement(t: Tables) -> DataFrame:
    return checks.agreement(t.documents.select(F.col("lang").alias("profile"), F.col("source").alias("id_rule")))


@query("""SELECT doc_id, '{"lang":' || coalesce('"' || lang || '"', 'null') || ',"book_code":' || coalesce('"' || source || '"', 'null') || ',"book_pair":null,"page":' || doc_id // 10 || ',"para":' || doc_id % 10
  || ',"para_key":"' || doc_id // 10 || '.' || doc_id % 10 || '","raw_text":' || coalesce('"' || md5(text) || '"', 'null') || ',"aligned":' || CASE WHEN doc_id % 2 = 0 THEN '["' || doc_id // 10 || '.1"]' ELSE 'null' END
  || coalesce(',"year":' || CASE WHEN doc_id % 3 = 0 THEN 1850 + doc_id % 50 END, '') || CASE WHEN doc_id % 4 = 0 THEN ',"chunk":1,"chunks":2' ELSE '' END || '}' AS payload FROM documents""")
def payloads(t: Tables) -> DataFrame:
    """Documents as blocks of books; a digest stands for the text."""
    page, para = F.floor(F.col("doc_id") / 10), F.col("doc_id") % 10
    blocks = t.documents.select(
        "doc_id", "lang", F.col("source").alias("book_code"), page.alias("page"), para.alias("para"), F.concat_ws(".", page.cast("string"), para.cast("string")).alias("para_key"),
        F.md5("text").alias("raw_text"), F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(page.cast("string"), F.lit(".1")))).alias("aligned"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 50 + 1850).alias("year"), F.lit(1).alias("chunk"), F.when(F.col("doc_id") % 4 == 0, 2).otherwise(1).alias("chunks"),
    )
    return blocks.select("doc_id", contract.payload("sop", blocks.columns).alias("payload"))


@query("""SELECT label::VARCHAR AS book_code, count(*) AS n, count(DISTINCT vec_id) AS uids, sum(vec_id)::BIGINT AS numbers,
round(sum(embedding[1]::DOUBLE), 4) AS first, round(sum(embedding[64]::DOUBLE), 4) AS last, 0::BIGINT AS problems FROM embeddings GROUP BY label""")
def pack_round_trip(t: Tables) -> DataFrame:
    """Vectors written as packs, checked and read again."""
    uid = F.concat(F.lit("en:v:"), F.col("vec_id").cast("string"))
    payload = F.to_json(F.struct(F.lit("en").alias("lang"), F.col("label").cast("string").alias("book_code"), F.col("vec_id").alias("number")))
    folder = scratch_folder(t)
    packs.write_packs(t.embeddings.select(uid.alias("uid"), ids.uuid5(uid).alias("id"), payload.alias("payload"), F.col("embedding").alias("vector")), folder, blockRows="1024")
    got = packs.read_packs(t._spark, folder).select("uid", F.from_json("payload", "book_code string, number bigint").alias("p"), "vector")
    sums = got.groupBy("p.book_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("uids"), F.sum("p.number").alias("numbers"), F.round(F.sum(F.element_at("vector", 1).cast("double")), 4).alias("first"), F.round(F.sum(F.element_at("vector", 64).cast("double")), 4).alias("last")
    )
    wrong = packs.pack_problems(t._spark, folder).agg(F.count(F.lit(1)).alias("problems"))
    return sums.crossJoin(F.broadcast(wrong))


#: Conversations as paragraphs of books of twenty; each turn is a piece.  Some lack a turn, have one twice, or belong to books with gaps in their fields.
RULED = """WITH c AS (SELECT conv_id // 20 AS book, conv_id::VARCHAR AS para_key, turn AS seq, turn AS chunk, count(*) OVER (PARTITION BY conv_id) AS chunks, CASE WHEN conv_id % 13 = 0 AND turn = 1 THEN ' ' ELSE text END AS text FROM conversations),
b AS (SELECT * FROM c WHERE para_key::BIGINT % 7 <> 0 OR seq <> 1 UNION ALL SELECT * FROM c WHERE para_key::BIGINT % 11 = 0 AND seq < 2),
p AS (SELECT *, sum(CASE WHEN chunk = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book, para_key ORDER BY seq) AS grp FROM b),
g AS (SELECT book, para_key, grp, count(*) AS n, min(chunks) AS a, max(chunks) AS z, min(chunk) AS c, max(chunk) AS d, count(DISTINCT chunk) AS e FROM p GROUP BY ALL),
v AS (SELECT book, 'empty text' AS rule, para_key || '#' || seq AS detail FROM b WHERE coalesce(trim(text), '') = ''
UNION SELECT book, 'duplicate', para_key || '#' || seq FROM b GROUP BY book, para_key, seq HAVING count(*) > 1
UNION SELECT book, 'density', para_key FROM b GROUP BY book, para_key HAVING min(seq) <> 0 OR max(seq) <> count(*) - 1 OR count(DISTINCT seq) <> count(*)
UNION SELECT book, 'partition', para_key FROM g WHERE grp = 0 OR a <> z OR n <> z OR c <> 0 OR d <> n - 1 OR e <> n
UNION SELECT book, 'metadata', 'title' FROM b WHERE book % 3 = 0 UNION SELECT book, 'metadata', 'author' FROM b WHERE book % 2 = 0
UNION SELECT book, 'id rule', 'bible/v1' FROM b WHERE book % 4 = 1 UNION SELECT book, 'target', 'contract' FROM b WHERE book % 5 = 2)
"""


@query(RULED + """SELECT book, rule, count(*) AS n, array_to_string(list_sort(list(detail))[1:10], ' ') AS listed FROM v GROUP BY book, rule""")
def rule_report(t: Tables) -> DataFrame:
    return rules.report(rules.violations(_ruled(t), ["book"], "c1"), ["book"]).withColumn("listed", F.array_join("listed", " "))


def _ruled(t: Tables) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    sizes = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunks"))
    rows = t.conversations.join(sizes, "conv_id").withColumn("text", F.when((conv % 13 == 0) & (turn == 1), " ").otherwise(F.col("text")))
    times = F.when((conv % 7 != 0) | (turn != 1), 1).otherwise(0) + F.when((conv % 11 == 0) & (turn < 2), 1).otherwise(0)
    rows = rows.withColumn("time", F.explode(F.array_repeat(F.lit(1), times)))
    book = F.floor(conv / 20)
    fields = [F.lit("B").alias("book_code"), F.lit("en").alias("lang"), F.when(book % 3 != 0, "t").alias("title"), F.lit("pioneers").alias("corpus"), F.when(book % 2 != 0, "a").alias("author"), F.lit(1900).alias("year")]
    fields += [F.lit("sop").alias("profile"), F.when(book % 4 == 1, "bible/v1").otherwise("sop/seq").alias("id_rule"), F.lit("sop").alias("target_profile"), F.when(book % 5 == 2, "c2").otherwise("c1").alias("target_contract")]
    return rows.select(book.alias("book"), conv.cast("string").alias("para_key"), turn.alias("seq"), turn.alias("chunk"), "chunks", "text", *fields)
