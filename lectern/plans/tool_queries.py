"""The read tools and the preflight checks as queries: documents stand for the points of books, order lines for verses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks
from . import tools, versification
from .book_queries import BOOKS, _verses
from .registry import Tables, query

#: Points made of documents: ten paragraphs to a page, a German book for every source, paired with the English one.
POINTS = """WITH p AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'de' END AS lang, source AS book_code, (doc_id // 10)::INT AS page, (doc_id % 10)::INT AS para,
  (doc_id // 10) || '.' || (doc_id % 10) AS para_key, md5(coalesce(text, '')) AS raw_text, 'Book ' || source AS title FROM documents)
"""


def _points(t: Tables) -> DataFrame:
    page, para = F.floor(F.col("doc_id") / 10).cast("int"), (F.col("doc_id") % 10).cast("int")
    key = F.concat_ws(".", page.cast("string"), para.cast("string"))
    neighbour = F.concat_ws(".", F.floor((F.col("doc_id") - 1) / 10).cast("string"), ((F.col("doc_id") - 1) % 10).cast("string"))
    german = F.col("doc_id") % 2 == 1
    none = F.lit(None).cast("string")
    return t.documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(german, "de").otherwise("en").alias("lang"),
        F.col("source").alias("book_code"),
        F.when(german, F.col("source")).alias("book_pair"),
        page.alias("page"),
        para.alias("para"),
        key.alias("para_key"),
        F.md5(F.coalesce("text", F.lit(""))).alias("raw_text"),
        F.when(german, F.array(neighbour)).alias("aligned"),
        none.alias("corpus"),
        none.alias("author"),
        F.concat(F.lit("Book "), F.col("source")).alias("title"),
        none.alias("page_kind"),
        F.lit(0).alias("chunk"),
        F.array(F.concat(F.lit("Gen.1."), (F.col("doc_id") % 31 + 1).cast("string"))).alias("bible_refs"),
    )


@query(POINTS + "SELECT book_code, page, para, para_key, raw_text AS text FROM p WHERE lang = 'de' AND book_code = 'src1' AND page BETWEEN 0 AND 20")
def tool_book_paragraphs(t: Tables) -> DataFrame:
    """Pages 0 to 20 of one book, fewer paragraphs than the tool's limit."""
    return tools.sop_book_paragraphs(_points(t), "src1", 0, 20).select("book_code", "page", "para", "para_key", "text")


@query(POINTS + "SELECT lang, count(*) AS n FROM p GROUP BY lang")
def tool_list_languages(t: Tables) -> DataFrame:
    return tools.sop_list_books(_points(t))


@query(POINTS + "SELECT 'de' AS lang, book_code, count(*) AS paragraphs, 'Book ' || book_code AS title FROM p WHERE lang = 'de' AND contains(lower(book_code), 'src1') GROUP BY book_code")
def tool_list_books(t: Tables) -> DataFrame:
    """Books of a language that a search finds, with the English title of each."""
    return tools.sop_list_books(_points(t), "de", "SRC1").select("lang", "book_code", "paragraphs", "title")


@query(POINTS + """, b AS (SELECT *, row_number() OVER (ORDER BY page, para) AS rn FROM p WHERE lang = 'en' AND book_code = (SELECT source FROM documents WHERE doc_id = 40))
SELECT b.page, b.para_key, b.raw_text AS text, b.para_key = '4.0' AS is_target FROM b JOIN (SELECT rn FROM b WHERE para_key = '4.0') a ON b.rn BETWEEN a.rn - 2 AND a.rn + 2""")
def tool_context(t: Tables) -> DataFrame:
    """Two neighbours on each side of the paragraph of document 40, in its book."""
    book = t.documents.where("doc_id = 40").select("source").first()
    return tools.sop_context(_points(t), book.source if book else "", "4.0").select("page", "para_key", "text", "is_target")


@query("""WITH n AS (SELECT e.doc_id, e.source, e.text FROM documents d JOIN documents e ON e.doc_id = d.doc_id - 1 AND e.source = d.source WHERE d.doc_id % 2 = 1)
SELECT source AS book_pair, (doc_id // 10) || '.' || (doc_id % 10) AS en_key, md5(coalesce(text, '')) AS text FROM n ORDER BY doc_id LIMIT 1""")
def tool_parallel(t: Tables) -> DataFrame:
    """The English paragraph that the first German one with an original in its own book names."""
    before = t.documents.select((F.col("doc_id") + 1).alias("doc_id"), "source")
    book = t.documents.where("doc_id % 2 = 1").select("doc_id", "source").join(before, ["doc_id", "source"]).orderBy("doc_id").first()
    if book is None:
        return tools.sop_parallel(_points(t), "", "0.0").select("book_pair", "en_key", "text")
    return tools.sop_parallel(_points(t), book.source, f"{book.doc_id // 10}.{book.doc_id % 10}").select("book_pair", "en_key", "text")


@query("""WITH b AS (SELECT doc_id, 'b' || doc_id // 40 AS book, (doc_id // 10) || '.' || (doc_id % 10) AS key, md5(coalesce(text, '')) AS text FROM documents)
SELECT 'de' AS lang, x.book, x.key, x.text FROM b x JOIN b y ON x.doc_id = y.doc_id + 1 AND x.book = y.book AND x.doc_id % 2 = 1 AND y.book = 'b1' AND y.key = '4.2'
UNION ALL SELECT 'en', x.book, x.key, x.text FROM b x JOIN b y ON x.doc_id = y.doc_id - 1 AND x.book = y.book AND y.doc_id % 2 = 1 AND y.book = 'b1' AND y.key = '4.3'""")
def tool_parallel_both(t: Tables) -> DataFrame:
    """From English to German and back, forty documents to a book."""
    code = F.concat(F.lit("b"), F.floor(F.col("id").cast("long") / 40))
    points = _points(t).withColumns({"book_code": code, "book_pair": F.when(F.col("lang") == "de", code)})
    there = tools.sop_parallel(points, "b1", "4.2", "en", "de").select(F.lit("de").alias("lang"), F.col("t_book").alias("book"), F.col("t_key").alias("key"), "text")
    back = tools.sop_parallel(points, "b1", "4.3", "de", "en").select(F.lit("en").alias("lang"), F.col("book_pair").alias("book"), F.col("en_key").alias("key"), "text")
    return there.unionByName(back)


@query("""SELECT source AS book_code, (doc_id // 10)::INT AS page, (doc_id // 10) || '.' || (doc_id % 10) AS para_key FROM documents WHERE doc_id % 2 = 0 AND doc_id % 31 = 4 ORDER BY doc_id::VARCHAR LIMIT 200""")
def tool_by_bible_ref(t: Tables) -> DataFrame:
    """Paragraphs that cite a verse: at most 200, as the tool returns."""
    return tools.sop_by_bible_ref(_points(t), "Gen.1.5", "en", 200).select("book_code", "page", "para_key")


MAPPED = "[" + ", ".join(f"'{x}'" for x in sorted({r[0] for r in versification.rules()})) + "]"


def _bible(t: Tables) -> DataFrame:
    """Verses of the usual numbering, and an edition with its own that lacks every fifth."""
    key = F.concat_ws(".", "book", F.col("chapter").cast("string"), F.col("verse").cast("string"))
    rows = _verses(t).select(key.alias("osis"), F.explode(F.array(*map(F.lit, ("kjv", "synodal", "plain")))).alias("bible"), "verse")
    rows = rows.where("bible = 'kjv' or verse % 5 <> 0")
    return rows.select(F.concat_ws(":", "bible", "osis").alias("id"), "bible", "osis", F.md5(F.concat_ws(":", "bible", "osis")).alias("text"))


EDITIONS = f"""WITH v AS (SELECT DISTINCT {BOOKS}[(l_partkey % 66 + 1)::INT] AS book, (l_orderkey % 150 + 1)::INT AS chapter, (l_suppkey % 60 + 1)::INT AS verse FROM lineitem),
b AS (SELECT x.bible, book || '.' || chapter || '.' || verse AS osis, verse FROM v, (VALUES ('kjv'), ('synodal'), ('plain')) AS x(bible) WHERE x.bible = 'kjv' OR verse % 5 <> 0)
"""


@query(EDITIONS + f"SELECT bible, count(*) AS verses, list_contains({MAPPED}, bible) AS kjv_remapped FROM b GROUP BY bible")
def tool_list_translations(t: Tables) -> DataFrame:
    return tools.bible_list_translations(_bible(t))


@query(EDITIONS + "SELECT osis, bible, md5(bible || ':' || osis) AS text, osis AS kjv_osis FROM b WHERE bible IN ('plain', 'kjv') AND (osis LIKE 'Gen.1.%' OR osis LIKE 'Exod.2.%')")
def tool_bible_lookup(t: Tables) -> DataFrame:
    """Two chapters in two editions by their own numbering."""
    return tools.bible_lookup(_bible(t), "Gen.1; Exod.2", ["plain", "kjv"])[0]


@query(EDITIONS + """SELECT pos AS ref_pos, ref FROM (VALUES (0, 'Gen.1.1-Gen.1.9', 'Gen', 1, 1, 9), (1, 'Obad.149', 'Obad', 149, 1, 999), (2, 'Ps.400.1', 'Ps', 400, 1, 1), (3, 'Exod.2.5', 'Exod', 2, 5, 5), (4, 'Rev.3', 'Rev', 3, 1, 999)) AS r(pos, ref, book, chapter, lo, hi)
WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.bible = 'plain' AND starts_with(osis, r.book || '.' || r.chapter || '.') AND b.verse BETWEEN lo AND hi)""", long="ref_pos")
def tool_lookup_missing(t: Tables) -> DataFrame:
    """References that match nothing in an edition, in the order asked for."""
    return tools.bible_lookup(_bible(t), "Gen.1.1-Gen.1.9; Obad.149, Ps.400.1 ;Exod.2.5; Rev.3;", "plain")[1].select("ref_pos", "ref")


SCORED = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, p.label AS label, round(list_cosine_similarity(q.e, p.e), 6) AS score FROM v q JOIN v p ON q.vec_id IN (0, 1, 2))
"""


def _vectors(t: Tables) -> tuple[DataFrame, list[list[float]]]:
    """Embeddings as points of books (their labels), and the first three as queries."""
    none = F.lit(None).cast("string")
    points = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), F.lit("de").alias("lang"), F.col("label").cast("string").alias("book_code"), F.lit(1).alias("page"), F.col("vec_id").cast("string").alias("para_key"), F.col("vec_id").cast("string").alias("raw_text"), none.alias("corpus"), none.alias("author"), none.alias("page_kind"), F.col("embedding").alias("vector"))
    return points, [list(r.embedding) for r in t.embeddings.where("vec_id < 3").orderBy("vec_id").select("embedding").collect()]


@query(SCORED + """, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS rank FROM s WHERE label = 3 AND score >= 0.2) WHERE rank <= 3),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS rank FROM s WHERE score >= 0.5 AND query_id NOT IN (SELECT query_id FROM a)) WHERE rank <= 3)
SELECT query_id, id::VARCHAR AS para_key, round(score, 3) AS score, rank, 1 AS pass FROM a UNION ALL SELECT query_id, id::VARCHAR, round(score, 3), rank, 2 FROM b""", long="query_id rank")
def tool_lookup(t: Tables) -> DataFrame:
    """Three queries in one book at 0.2, and in all books at 0.5 where that finds nothing."""
    points, queries = _vectors(t)
    return tools.sop_lookup(points, queries, ["3"], min_score=0.2, limit=3).select("query_id", "para_key", "score", "rank", "pass")


@query(SCORED + "SELECT id::VARCHAR AS osis, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rank FROM s WHERE query_id = 1 AND score >= 0.1) WHERE rank <= 5", long="rank")
def tool_bible_search(t: Tables) -> DataFrame:
    points, queries = _vectors(t)
    verses = points.select("id", F.lit("kjv").alias("bible"), F.col("id").alias("osis"), F.col("id").alias("text"), "vector")
    return tools.bible_search(verses, queries[1], min_score=0.1).select("osis", "score", "rank")


@query("""WITH b AS (SELECT 'de' AS lang, 'c' || c_custkey AS book_code, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'n' || c_nationkey END AS book_pair, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'T' || (c_custkey % 500) END AS title,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS author, 's' || (c_custkey % 17) AS slug FROM customer),
s AS (SELECT 'de' AS lang, 'c' || s_suppkey AS book_code, 'T' || (s_suppkey % 300) AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' END AS author, 's' || (s_suppkey % 19) AS slug FROM supplier),
i AS (SELECT 'c' || o_custkey AS book_code, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey)
SELECT 'metadata' AS rule, lang || ':' || book_code AS subject, f AS detail FROM (SELECT *, unnest(list_filter([CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(trim(author), '') = '' THEN 'author' END], lambda x: x IS NOT NULL)) AS f FROM b)
UNION ALL SELECT 'no original', lang || ':' || book_code, '' FROM b WHERE book_pair IS NULL
UNION ALL SELECT 'collision', b.lang || ':' || b.book_code, b.slug FROM b JOIN s ON b.lang = s.lang AND b.book_code = s.book_code WHERE b.slug <> s.slug
UNION ALL SELECT DISTINCT 'same title', b.book_code, s.book_code FROM b JOIN s ON b.title = s.title AND b.book_code <> s.book_code WHERE coalesce(b.author = s.author, true)
UNION ALL SELECT 'overwrite', 'de:' || book_code, n::VARCHAR FROM i""")
def import_preflight(t: Tables) -> DataFrame:
    """Everything that refuses an import, in one table: customers as incoming books, suppliers as stored ones, orders as points."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    named = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    books = t.customer.select(
        F.lit("de").alias("lang"),
        named("c", c).alias("book_code"),
        F.when(c % 7 != 0, named("n", F.col("c_nationkey"))).alias("book_pair"),
        F.when(c % 11 == 0, "").otherwise(named("T", c % 500)).alias("title"),
        F.when(c % 13 != 0, F.col("c_mktsegment")).alias("author"),
        F.lit("x").alias("corpus"),
        named("s", c % 17).alias("slug"),
    )
    stored = t.supplier.select(F.lit("de").alias("lang"), named("c", s).alias("book_code"), named("T", s % 300).alias("title"), F.when(s % 2 == 0, "BUILDING").alias("author"), named("s", s % 19).alias("slug"))
    ids = t.orders.select(F.lit("de").alias("lang"), named("c", F.col("o_custkey")).alias("book_code"), F.col("o_orderkey").alias("id"))
    return checks.import_violations(books, stored, ids, ids.where("id % 3 = 0").select("id"))


@query("""WITH p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'de' END AS lang, source AS book_code FROM documents),
c AS (SELECT lang, book_code, count(*) AS found FROM p GROUP BY ALL), a AS (SELECT DISTINCT 'en' AS lang, source AS book_code, length(source) * 20 AS n FROM documents WHERE source IS NOT NULL)
SELECT 'count' AS rule, 'en:' || a.book_code AS subject, found::VARCHAR AS detail FROM a JOIN c ON a.lang = c.lang AND a.book_code = c.book_code WHERE found <> n
UNION ALL SELECT 'no points', 'en:' || a.book_code, '' FROM a WHERE a.book_code NOT IN (SELECT book_code FROM c WHERE lang = 'en' AND book_code IS NOT NULL)
UNION ALL SELECT 'paired', 'en:' || a.book_code, 'de:' || c.book_code FROM a JOIN c ON c.lang = 'de' AND c.book_code = a.book_code""")
def delete_preflight(t: Tables) -> DataFrame:
    """Everything that refuses the deletion of the English books: their German ones name them still."""
    points = _points(t)
    asked = t.documents.where("source is not null").select(F.lit("en").alias("lang"), F.col("source").alias("book_code"), (F.length("source") * 20).cast("long").alias("n")).distinct()
    return checks.delete_violations(asked, points)
