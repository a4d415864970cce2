"""Queries of imports: fixture plans, the check after an import, nested results, keys of composed books, pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import osis
from ..functions import text as T
from ..functions import vectors as V
from ..operators import checks, corpus, fixtures, nested, reports
from ..sources import books
from .registry import Tables, query
from .text_queries import LINES, WORDS, _lines

#: Documents as points of two profiles and two corpora; a text of more than 300 words counts as long.
FIXTURE = f"""WITH p AS (SELECT doc_id AS id, doc_id % 4 = 3 AS verse, lang, doc_id % 3 = 0 AS pioneer, source AS bible, {WORDS.format('text')} > 300 AS long FROM documents),
l AS (SELECT lang FROM p WHERE NOT verse AND NOT pioneer AND lang NOT IN ('en', 'de') GROUP BY lang ORDER BY lang LIMIT 4),
e AS (SELECT bible FROM p WHERE verse AND bible IS NOT NULL GROUP BY bible ORDER BY bible LIMIT 5),
c AS (SELECT CASE lang WHEN 'en' THEN 0 ELSE 1 END AS slot, '' AS part, id, 2 AS take FROM p WHERE NOT verse AND NOT pioneer AND lang IN ('en', 'de')
UNION ALL SELECT 2, lang, id, 1 FROM p WHERE NOT verse AND NOT pioneer AND lang IN (SELECT lang FROM l) UNION ALL SELECT 3, '', id, 2 FROM p WHERE NOT verse AND pioneer AND lang = 'en'
UNION ALL SELECT 4, bible, id, 1 FROM p WHERE verse AND bible IN (SELECT bible FROM e)),
t AS (SELECT slot, part, id FROM c QUALIFY row_number() OVER (PARTITION BY slot, part ORDER BY id) <= take),
z AS (SELECT min(id) AS id FROM p WHERE NOT verse AND pioneer AND lang = 'en' AND long AND id NOT IN (SELECT id FROM t))
"""


@query(FIXTURE + "SELECT slot, part, id FROM t UNION ALL SELECT 5, '', id FROM z WHERE id IS NOT NULL", long="slot")
def fixture_slots(t: Tables) -> DataFrame:
    """The usual plan of sixteen entries, as far as the tables have them."""
    verse, pioneer = F.col("doc_id") % 4 == 3, F.col("doc_id") % 3 == 0
    points = t.documents.select(F.col("doc_id").alias("id"), F.when(verse, "bible").otherwise("sop").alias("profile"), "lang", F.when(pioneer, "pioneers").otherwise("egw").alias("corpus"), F.col("source").alias("bible"), T.word_count(F.col("text")).alias("tokens"))
    return fixtures.fixture_plan(points, fixtures.usual_slots(F.col("tokens"), 300)).select("slot", "part", "id")


@query("""WITH p AS (SELECT vec_id AS id, 'b' || label AS book_code, label, embedding FROM embeddings),
n AS (SELECT book_code, label, count(*) AS n FROM p GROUP BY ALL)
SELECT book_code, 'count' AS problem, n + 1 || ' ' || n AS detail FROM n WHERE label % 3 = 0
UNION ALL SELECT book_code, 'metadata', 'title' FROM n WHERE label % 4 = 1
UNION ALL SELECT book_code, 'unreachable', id::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY book_code ORDER BY id) AS rn FROM p) WHERE rn <= 3 AND id % 5 = 0""")
def import_check(t: Tables) -> DataFrame:
    """Vectors as points of a book for each label; every fifth was stored as zeros, some books have a wrong count or no title."""
    stored = F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    title = F.when(F.col("label") % 4 != 1, "t")
    points = t.embeddings.select(F.col("vec_id").alias("id"), F.lit("en").alias("lang"), F.concat(F.lit("b"), "label").alias("book_code"), stored.alias("vector"), title.alias("title"), F.lit("a").alias("author"), F.lit("egw").alias("corpus"))
    manifest = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("en").alias("lang"), F.concat(F.lit("b"), "label").alias("book_code"), (F.col("n") + F.when(F.col("label") % 3 == 0, 1).otherwise(0)).alias("n"))
    return checks.after_import(manifest, points).drop("lang")


@query("""WITH b AS (SELECT lang, source AS code, 'T' || doc_id % 4 AS title, CASE WHEN doc_id % 3 = 1 THEN 'a' || doc_id % 7 END AS author, CASE WHEN doc_id % 5 = 2 THEN 1850 + doc_id % 50 END AS year,
  CASE WHEN lang <> 'en' AND doc_id % 2 = 0 THEN 'E' || doc_id % 6 END AS en_code, doc_id AS pos FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
t AS (SELECT lang, code, title, min(pos) AS pos FROM b GROUP BY ALL),
l AS (SELECT lang, code, string_agg('"' || title || '"', ',' ORDER BY pos) AS titles FROM t GROUP BY ALL),
e AS (SELECT lang, code, arg_min(author, pos) FILTER (author IS NOT NULL) AS author, arg_min(year, pos) FILTER (year IS NOT NULL) AS year, arg_min(en_code, pos) FILTER (en_code IS NOT NULL) AS en_code FROM b GROUP BY ALL),
c AS (SELECT lang, string_agg('"' || code || '":{"titles":[' || titles || ']' || coalesce(',"author":"' || author || '"', '') || coalesce(',"year":' || year, '') || coalesce(',"en_code":"' || en_code || '"', '') || '}', ',' ORDER BY code) AS j FROM e JOIN l USING (lang, code) GROUP BY lang)
SELECT coalesce('{' || string_agg('"' || lang || '":{' || j || '}', ',' ORDER BY lang) || '}', '{}') AS json FROM c""")
def titles_nested(t: Tables) -> DataFrame:
    """Documents as entries of a manifest, a book for each language and source."""
    n = F.col("doc_id")
    pair = F.when((F.col("lang") != "en") & (n % 2 == 0), F.concat(F.lit("X/ E"), n % 6))
    entries = t.documents.select("lang", F.col("source").alias("book_code"), F.concat(F.lit("T"), n % 4).alias("title"), F.when(n % 3 == 1, F.concat(F.lit("a"), n % 7)).alias("author"), F.when(n % 5 == 2, n % 50 + 1850).alias("year"), F.lit(None).cast("string").alias("corpus"), pair.alias("book_pair"), n.alias("pos"))
    return nested.titles_fragment(entries)


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS hit, o_orderpriority AS priority, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS pass FROM orders),
h AS (SELECT o_custkey, to_json(list({'hit': hit, 'priority': priority} ORDER BY hit) FILTER (pass = 1)) AS a, to_json(list({'hit': hit, 'priority': priority} ORDER BY hit) FILTER (pass = 2)) AS b FROM o GROUP BY o_custkey)
SELECT c_custkey AS query_id, '{"query":"' || c_name || '","hits":' || coalesce(a::VARCHAR, '[]') || ',"fallbacks":' || CASE WHEN a IS NULL THEN coalesce(b::VARCHAR, '[]') ELSE '[]' END || '}' AS json FROM customer LEFT JOIN h ON c_custkey = o_custkey""")
def answers_nested(t: Tables) -> DataFrame:
    """Customers as queries, their finished orders as hits and the others as fallbacks; customers without orders keep their place."""
    hits = t.orders.select(F.col("o_custkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("pass"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").alias("hit"), F.col("o_orderpriority").alias("priority"))
    found = nested.answers(t.customer.select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query")), hits, ["hit", "priority"])
    return found.select("query_id", nested.results_json(found).alias("json"))


@query("""WITH w AS (SELECT l_suppkey % 7 AS bible, min(l_suppkey % 7) AS bible_pos, l_orderkey AS osis, min(l_linenumber) AS key_pos FROM lineitem GROUP BY l_suppkey % 7, l_orderkey),
v AS (SELECT o_custkey % 7 AS bible, o_orderkey AS osis, o_orderpriority AS text FROM orders)
SELECT key_pos, bible_pos, bible, osis, text FROM v JOIN w USING (bible, osis)""")
def editions_joined(t: Tables) -> DataFrame:
    """Orders as verses of seven editions, line items as the keys that are asked of each."""
    wanted = t.lineitem.select((F.col("l_suppkey") % 7).alias("bible"), (F.col("l_suppkey") % 7).alias("bible_pos"), F.col("l_orderkey").alias("osis"), F.col("l_linenumber").alias("key_pos"))
    return nested.editions_union(t.orders.select((F.col("o_custkey") % 7).alias("bible"), F.col("o_orderkey").alias("osis"), F.col("o_orderpriority").alias("text")), wanted)


@query(LINES + """, b AS (SELECT doc_id, para, (para - 1) // 5 + 1 AS doc_no, CASE WHEN doc_id % 3 = 0 AND para % 4 = 3 THEN para END AS mark, doc_id % 3 = 1 AND para % 3 <> 2 AS coded FROM n),
g AS (SELECT *, count(mark) OVER (PARTITION BY doc_id ORDER BY para) AS marks, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para) AS page FROM b)
SELECT doc_id, para AS line, coded, CASE WHEN coded THEN para ELSE coalesce(page, doc_no) END AS page,
  CASE WHEN coded THEN doc_id % 9 ELSE sum(CASE WHEN coded THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, marks, CASE WHEN marks = 0 THEN doc_no END ORDER BY para) END AS para FROM g WHERE mark IS NULL""", long="line page para")
def book_keys(t: Tables) -> DataFrame:
    """Lines as blocks, five to a page of an EPUB: some books have page marks, some printed citations."""
    para, doc = F.col("para"), F.col("doc_id")
    text = F.when((doc % 3 == 0) & (para % 4 == 3), F.concat(F.lit("["), para, F.lit("]"))).when((doc % 3 == 1) & (para % 3 != 2), F.concat(F.lit("A line CHR "), para, F.lit("."), doc % 9)).otherwise("A line")
    blocks = _lines(t).select("doc_id", (F.floor((para - 1) / 5) + 1).cast("int").alias("doc_no"), ((para - 1) % 5).alias("pos"), para.alias("line"), text.alias("text"))
    return books.keyed_pages(blocks, "doc_id").select("doc_id", "line", "coded", "page", "para")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, 1 + vec_id % 8 AS k FROM embeddings),
m AS (SELECT vec_id, k, e[1:8] AS cls, list_transform(range(1, 9), lambda d: list_sum(list_transform(range(0, k), lambda i: e[i * 8 + d])) / k) AS mean FROM v),
n AS (SELECT *, sqrt(list_inner_product(mean, mean)) AS a, sqrt(list_inner_product(cls, cls)) AS b FROM m)
SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda d: d * mean[d] / a)), 5) AS mean_sum, round(list_sum(list_transform(range(1, 9), lambda d: d * cls[d] / b)), 5) AS cls_sum FROM n""")
def pooled(t: Tables) -> DataFrame:
    """Each vector as eight tokens of eight numbers, the first of which are real; pooled by their mean and by the first."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i < 1 + F.col("vec_id") % 8).cast("int"))
    rows = t.embeddings.select("vec_id", tokens.alias("v"), mask.alias("m"))
    weighed = lambda x: F.round(F.aggregate(F.transform(x, lambda y, i: y * (i + 1)), F.lit(0.0), lambda s, y: s + y), 5)
    return rows.select("vec_id", weighed(V.mean_pool(F.col("v"), F.col("m"))).alias("mean_sum"), weighed(V.cls_pool(F.col("v"))).alias("cls_sum"))


#: Orders as verse keys of editions, one for each nation of a customer; every eleventh key is none, every ninth verse is split.
COVERED = """WITH b AS (SELECT [""" + ", ".join(f"'{b}'" for b in osis.BOOKS) + """] AS l),
v AS (SELECT o_custkey % 25 AS edition, CASE WHEN o_orderkey % 11 = 0 THEN 'Odd.' || o_orderkey ELSE l[1 + o_orderkey % 60] || '.' || 1 + o_custkey % 20 || '.' || 1 + o_orderkey % 30 END AS key,
  o_orderkey % 11 <> 0 AS valid, 1 + o_orderkey % 60 AS book, 1 + o_custkey % 20 AS chapter, o_orderkey % 9 = 0 AS split FROM orders, b),
f AS (SELECT edition, count(DISTINCT book) FILTER (valid) AS books, count(DISTINCT (book, chapter)) FILTER (valid) AS chapters, count(*) FILTER (valid) AS verses, count(*) FILTER (split) AS split, count(*) FILTER (NOT valid) AS invalid, list(DISTINCT book) FILTER (valid) AS have FROM v GROUP BY edition)
"""


@query(COVERED + """SELECT edition, books, chapters, verses, split, invalid, array_to_string(list_transform(list_filter(range(1, 67), lambda i: NOT list_contains(coalesce(have, []), i)), lambda i: l[i]), ' ') AS missing FROM f, b""", long="books chapters verses split invalid")
def bible_coverage(t: Tables) -> DataFrame:
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    key = F.concat_ws(".", F.element_at(F.array(*map(F.lit, osis.BOOKS)), (n % 60 + 1).cast("int")), (c % 20 + 1).cast("string"), (n % 30 + 1).cast("string"))
    verses = t.orders.select((c % 25).alias("edition"), F.when(n % 11 == 0, F.concat(F.lit("Odd."), n)).otherwise(key).alias("key"), F.when(n % 9 == 0, 2).otherwise(1).alias("chunks"))
    return checks.coverage(verses, "edition", "key", "chunks").withColumn("missing", F.array_join("missing", " "))


@query("""SELECT o_orderkey, min(l_linenumber) AS pos, o_orderstatus FROM orders JOIN lineitem ON l_partkey = o_orderkey
WHERE coalesce(o_orderstatus = 'F' AND o_custkey % 2 = 0, false) OR coalesce(o_orderstatus = 'O' AND o_orderpriority LIKE '1%', false) GROUP BY o_orderkey, o_orderstatus""", long="pos")
def retrieved_ids(t: Tables) -> DataFrame:
    """Orders by a list of ids with repeats and gaps, if one of two groups of conditions holds."""
    either = corpus.any_of([[F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0], [F.col("o_orderstatus") == "O", F.col("o_orderpriority").startswith("1")]])
    points = t.orders.where(either).withColumnRenamed("o_orderkey", "id")
    found = corpus.retrieved(points, t.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("pos")))
    return found.select(F.col("id").alias("o_orderkey"), "pos", "o_orderstatus")


@query("""WITH f AS (SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang)
SELECT 0 AS line, '# Import' AS text UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| lang | n | chars |' UNION ALL SELECT 3, '|---|---|---|'
UNION ALL SELECT 3 + row_number() OVER (ORDER BY lang NULLS FIRST), '| ' || coalesce(lang, '') || ' | ' || n || ' | ' || chars || ' |' FROM f""", long="line")
def import_report(t: Tables) -> DataFrame:
    """Languages of an import as a report in Markdown."""
    facts = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return reports.markdown("Import", facts, ["lang"]).select("line", "text")
