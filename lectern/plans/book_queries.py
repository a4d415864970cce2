"""Queries on books, verses, alignment and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import osis
from ..functions import text as T
from ..operators import checks, corpus
from . import versification
from .registry import Tables, query

RULES = "(VALUES " + ", ".join(f"('{t}', '{b}', {', '.join(map(str, n))})" for t, b, *n in versification.rules()) + ") AS r(target, book, kjv_ch, v_lo, v_hi, tgt_ch, delta, rule_ord)"
BOOKS = "[" + ", ".join(f"'{b}'" for b in osis.BOOKS) + "]"
#: Verse keys made of order lines: every book, chapters to 150, verses to 60.
VERSES = f"""WITH v AS (SELECT DISTINCT {BOOKS}[(l_partkey % 66 + 1)::INT] AS book, (l_orderkey % 150 + 1)::INT AS chapter, (l_suppkey % 60 + 1)::INT AS verse FROM lineitem),
t AS (SELECT * FROM v, (VALUES ('luther1912'), ('synodal'), ('ukrogienko'), ('other')) AS x(target)),
m AS (SELECT t.target, t.book, t.chapter, t.verse, coalesce(arg_min(tgt_ch, rule_ord), any_value(chapter))::INT AS ed_chapter, coalesce(any_value(verse) + arg_min(delta, rule_ord), any_value(verse))::INT AS ed_verse
  FROM t LEFT JOIN {RULES} ON r.target = t.target AND r.book = t.book AND r.kjv_ch = t.chapter AND t.verse BETWEEN r.v_lo AND r.v_hi GROUP BY t.target, t.book, t.chapter, t.verse)
"""


def _verses(t: Tables) -> DataFrame:
    book = F.element_at(F.array(*map(F.lit, osis.BOOKS)), (F.col("l_partkey") % 66 + 1).cast("int"))
    return t.lineitem.select(book.alias("book"), (F.col("l_orderkey") % 150 + 1).cast("int").alias("chapter"), (F.col("l_suppkey") % 60 + 1).cast("int").alias("verse")).distinct()


def _remapped(t: Tables) -> DataFrame:
    targets = F.explode(F.array(*map(F.lit, ("luther1912", "synodal", "ukrogienko", "other")))).alias("target")
    rules = versification.rule_table(t._spark)
    return versification.remap(_verses(t).select("*", targets), rules)


@query(VERSES + "SELECT target, book, chapter, verse, ed_chapter, ed_verse FROM m")
def verse_remap(t: Tables) -> DataFrame:
    return _remapped(t).select("target", "book", "chapter", "verse", "ed_chapter", "ed_verse")


@query(VERSES + "SELECT target, book, ed_chapter, ed_verse, max((chapter, verse))[1] AS chapter, max((chapter, verse))[2] AS verse FROM m WHERE target <> 'other' GROUP BY ALL")
def verse_remap_collision(t: Tables) -> DataFrame:
    """The way back: where two requested verses meet, the later one holds."""
    rows = _remapped(t).where("target <> 'other'").withColumn("key_pos", F.struct("chapter", "verse"))
    return versification.back_to_kjv(rows)


@query(VERSES + """, kjv AS (SELECT * FROM v WHERE (chapter + verse) % 3 <> 0), ed AS (SELECT DISTINCT book, chapter, verse FROM v WHERE verse % 2 = 0),
back AS (SELECT target, book, ed_chapter, ed_verse, max((chapter, verse)) AS k FROM m WHERE target = 'synodal' AND (chapter + verse) % 3 <> 0 GROUP BY ALL)
SELECT ed.book, ed.chapter, ed.verse, k[1] AS kjv_chapter, k[2] AS kjv_verse FROM ed JOIN back ON ed.book = back.book AND ed.chapter = back.ed_chapter AND ed.verse = back.ed_verse""")
def lookup_kjv(t: Tables) -> DataFrame:
    """Verses of an edition by the usual numbering: those that exist there, remapped, joined to the edition's own."""
    existing = _verses(t).where((F.col("chapter") + F.col("verse")) % 3 != 0)
    rows = versification.remap(existing.withColumn("target", F.lit("synodal")), versification.rule_table(t._spark)).withColumn("key_pos", F.struct("chapter", "verse"))
    back = versification.back_to_kjv(rows).select("book", F.col("ed_chapter"), F.col("ed_verse"), F.col("chapter").alias("kjv_chapter"), F.col("verse").alias("kjv_verse"))
    edition = _verses(t).where("verse % 2 = 0").withColumnsRenamed({"chapter": "ed_chapter", "verse": "ed_verse"})
    return edition.join(back, ["book", "ed_chapter", "ed_verse"]).select("book", F.col("ed_chapter").alias("chapter"), F.col("ed_verse").alias("verse"), "kjv_chapter", "kjv_verse")


@query(f"""WITH r AS (SELECT o_orderkey, o_orderkey % 5 AS kind, {BOOKS}[(o_custkey % 66 + 1)::INT] AS b, (o_orderkey % 20 + 1)::INT AS c, (o_custkey % 30 + 1)::INT AS v FROM orders)
SELECT o_orderkey, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 176 - v + 1 + 2 WHEN 3 THEN 176 ELSE 352 END::BIGINT AS keys,
  CASE WHEN kind < 3 THEN b || '.' || c || '.' || v ELSE b || '.' || c || '.1' END AS first_key,
  CASE kind WHEN 0 THEN b || '.' || c || '.' || v WHEN 1 THEN b || '.' || c || '.' || (v + 2) WHEN 2 THEN b || '.' || (c + 1) || '.2' WHEN 3 THEN b || '.' || c || '.176' ELSE b || '.' || (c + 1) || '.176' END AS last_key FROM r""")
def ref_expand(t: Tables) -> DataFrame:
    """References made of orders: a verse, a range, a range across chapters, a chapter, two chapters."""
    book = F.element_at(F.array(*map(F.lit, osis.BOOKS)), (F.col("o_custkey") % 66 + 1).cast("int"))
    c, v, kind = (F.col("o_orderkey") % 20 + 1), (F.col("o_custkey") % 30 + 1), F.col("o_orderkey") % 5
    at = F.concat_ws(".", book, c.cast("string"))
    verse = F.concat_ws(".", at, v.cast("string"))
    ref = (
        F.when(kind == 0, verse)
        .when(kind == 1, F.concat(verse, F.lit("-"), (v + 2).cast("string")))
        .when(kind == 2, F.concat(verse, F.lit("-"), F.concat_ws(".", book, (c + 1).cast("string"), F.lit("2"))))
        .when(kind == 3, at)
        .otherwise(F.concat(at, F.lit("-"), F.concat_ws(".", book, (c + 1).cast("string"))))
    )
    return osis.ref_bounds(t.orders.select("o_orderkey", ref.alias("ref"))).select("o_orderkey", "keys", "first_key", "last_key")


@query(f"""WITH e AS (SELECT DISTINCT {BOOKS}[(l_partkey % 66 + 1)::INT] || '.' || (l_orderkey % 150 + 1) || '.' || (l_suppkey % 60 + 1) AS key FROM lineitem),
r AS (SELECT DISTINCT {BOOKS}[(o_custkey % 66 + 1)::INT] AS b, (o_orderkey % 150 + 1) AS c, (o_custkey % 58 + 1) AS v FROM orders),
k AS (SELECT b || '.' || c || '.' || v || '-' || (v + 2) AS ref, b || '.' || c || '.' || unnest([v, v + 1, v + 2]) AS key FROM r)
SELECT ref FROM k LEFT JOIN e USING (key) GROUP BY ref HAVING count(e.key) = 0""")
def ref_not_found(t: Tables) -> DataFrame:
    book = F.element_at(F.array(*map(F.lit, osis.BOOKS)), (F.col("o_custkey") % 66 + 1).cast("int"))
    c, v = F.col("o_orderkey") % 150 + 1, F.col("o_custkey") % 58 + 1
    refs = t.orders.select(F.concat(F.concat_ws(".", book, c.cast("string"), v.cast("string")), F.lit("-"), (v + 2).cast("string")).alias("ref")).distinct()
    keys = osis.expand_refs(refs).select("ref", "key")
    existing = _verses(t).select(F.concat_ws(".", "book", "chapter", "verse").alias("key"))
    return refs.join(keys.join(existing, "key", "left_semi").select("ref").distinct(), "ref", "left_anti")


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def facet_exact(t: Tables) -> DataFrame:
    return corpus.facet(t.documents, "source").withColumnRenamed("source", "value")


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE n_chars BETWEEN 200 AND 4000 AND source NOT IN ('src1', 'src2') AND coalesce(lang <> 'fr', true) GROUP BY lang HAVING lang IS NOT NULL")
def facet_filtered(t: Tables) -> DataFrame:
    where = F.col("n_chars").between(200, 4000) & corpus.none_of(F.col("source").isin("src1", "src2"), F.col("lang") == "fr")
    return corpus.facet(t.documents, "lang", where).withColumnRenamed("lang", "value")


@query("SELECT lang, source AS book_code, count(*) AS paragraphs, arg_min(n_chars, doc_id) AS n_chars, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def book_index(t: Tables) -> DataFrame:
    points = t.documents.select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("book_code"), "n_chars", F.col("doc_id").alias("first_id"))
    return corpus.book_index(points, ["n_chars", "first_id"])


@query("""WITH b AS (SELECT s.lang, s.book_code, s.paragraphs, 'Title ' || s.book_code || ' ' || s.lang AS title, s.book_code AS book_pair FROM (SELECT lang, source AS book_code, count(*) AS paragraphs FROM documents GROUP BY ALL) s)
SELECT b.lang, b.book_code, b.paragraphs, b.title, e.title AS en_title FROM b LEFT JOIN (SELECT book_code, title FROM b WHERE lang = 'en') e ON b.book_pair = e.book_code
WHERE contains(lower(concat_ws(' ', b.book_code, b.title, e.title, 'Author', 'corpus')), lower('SRC1'))""")
def list_books_search(t: Tables) -> DataFrame:
    points = t.documents.select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("book_code"))
    index = corpus.book_index(points, ["id"]).drop("id").withColumns({"title": F.concat_ws(" ", F.lit("Title"), "book_code", "lang"), "book_pair": F.col("book_code"), "author": F.lit("Author"), "corpus": F.lit("corpus")})
    return corpus.list_books(index, "SRC1").select("lang", "book_code", "paragraphs", "title", "en_title")


@query("""WITH n AS (SELECT conv_id, turn, md5(text) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT a.conv_id AS anchor_id, b.conv_id, b.turn, b.digest, b.rn = a.rn AS is_target FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.rn BETWEEN a.rn - 1 AND a.rn + 2 WHERE a.turn = 2""")
def context_window(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", F.md5("text").alias("digest"))
    anchors = turns.where("turn = 2").select(F.col("conv_id").alias("anchor_id"), "conv_id", "turn")
    return corpus.context(turns, anchors, ["conv_id"], ["turn"], 1, 2).select("anchor_id", "conv_id", "turn", "digest", "is_target")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 4000")
def page_range(t: Tables) -> DataFrame:
    """Suppliers as books, orders as pages."""
    return t.lineitem.where(F.col("l_orderkey").between(1000, 4000)).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH n AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn, min(l_orderkey) OVER (PARTITION BY l_suppkey) AS f FROM lineitem),
c AS (SELECT l_suppkey, max(l_orderkey) FILTER (rn = 41) AS cut, any_value(f) AS f FROM n GROUP BY l_suppkey),
d AS (SELECT l_suppkey, CASE WHEN cut > f THEN cut WHEN cut = f THEN f + 1 END AS cut FROM c)
SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN cut <= 1000000000 THEN cut END AS next_page_from FROM n JOIN d USING (l_suppkey) WHERE cut IS NULL OR l_orderkey < cut""")
def page_range_truncated(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return corpus.page_cut(rows, ["l_suppkey"], "l_orderkey", ["l_linenumber", "l_partkey", "l_extendedprice"], F.lit(1_000_000_000), 40).select("l_suppkey", "l_orderkey", "l_linenumber", "next_page_from")


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """User turns as translated paragraphs that name the next two turns; assistant turns as originals."""
    key = lambda d: (F.col("turn") + d).cast("string")
    user = t.conversations.where("role = 'user'").select(F.lit("de").alias("lang"), F.col("conv_id").alias("book_pair"), F.col("conv_id").alias("book_code"), key(0).alias("para_key"), F.array(key(1), key(2)).alias("aligned"), F.length("text").alias("raw_text"))
    other = t.conversations.where("role = 'assistant'").select(F.col("conv_id").alias("book_code"), key(0).alias("para_key"), F.length("text").alias("raw_text"))
    return user, other


@query("SELECT u.conv_id AS book_pair, u.turn::VARCHAR AS para_key, (a.turn - u.turn - 1)::INT AS pos, a.turn::VARCHAR AS en_key, length(a.text) AS en_text FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn IN (u.turn + 1, u.turn + 2) WHERE u.role = 'user' AND a.role = 'assistant'", long="en_text")
def alignment_forward(t: Tables) -> DataFrame:
    user, other = _sides(t)
    return corpus.aligned_originals(user, other).select("book_pair", "para_key", "pos", "en_key", "en_text")


@query("SELECT a.conv_id AS book_code, a.turn::VARCHAR AS para_key, u.turn::VARCHAR AS t_key, length(u.text) AS t_text FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn IN (u.turn + 1, u.turn + 2) WHERE u.role = 'user' AND a.role = 'assistant'", long="t_text")
def alignment_reverse(t: Tables) -> DataFrame:
    user, other = _sides(t)
    return corpus.aligned_translations(other, user).select("book_code", "para_key", "t_key", "t_text")


@query("SELECT own_key, len(l) AS n, l[1] AS first, l[len(l)] AS last FROM (SELECT l_partkey AS own_key, list_sort(list(DISTINCT l_orderkey)) AS l FROM lineitem GROUP BY l_partkey)", long="n")
def invert_alignment(t: Tables) -> DataFrame:
    reverse = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("own"))
    rows = corpus.inverted(reverse, "l_orderkey", "own")
    return rows.select("own_key", F.size("aligned").alias("n"), F.element_at("aligned", 1).alias("first"), F.element_at("aligned", -1).alias("last"))


@query("""WITH r AS (SELECT DISTINCT p_brand, p_size AS lo, p_size + 4 AS hi, rank() OVER (ORDER BY p_size) AS ord FROM part WHERE p_partkey % 20 = 0 AND p_brand = 'Brand#11')
SELECT p_partkey, p_size, (SELECT min((ord, lo)) FROM r WHERE p.p_size BETWEEN lo AND hi)[2] AS band FROM part p""")
def range_rule_join(t: Tables) -> DataFrame:
    """First fitting range rule of a small rule table made of parts."""
    rules = t.part.where("p_partkey % 20 = 0 and p_brand = 'Brand#11'").select(F.col("p_size").alias("lo")).distinct()
    # Chapter 0 stands for no rule, as bands begin at 1.
    table = rules.select(F.lit("x").alias("target"), F.lit("x").alias("book"), F.lit(0).alias("kjv_ch"), F.col("lo").alias("v_lo"), (F.col("lo") + 4).alias("v_hi"), F.col("lo").alias("tgt_ch"), F.lit(0).alias("delta"), F.col("lo").alias("rule_ord"))
    verses = t.part.select("p_partkey", "p_size", F.lit("x").alias("target"), F.lit("x").alias("book"), F.lit(0).alias("chapter"), F.col("p_size").alias("verse"))
    return versification.remap(verses, table).select("p_partkey", "p_size", F.nullif("ed_chapter", F.lit(0)).alias("band"))


@query("SELECT conv_id, count(*) AS n, min(turn) AS lo, max(turn) AS hi FROM conversations WHERE role <> 'system' GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)")
def validate_density(t: Tables) -> DataFrame:
    return checks.density(t.conversations.where("role <> 'system'"), ["conv_id"], "turn").select("conv_id", "n", "lo", "hi")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def validate_duplicates(t: Tables) -> DataFrame:
    return checks.duplicates(t.lineitem, ["l_orderkey", "l_suppkey"])


@query("""WITH p AS (SELECT conv_id, turn, turn % 3 AS chunk, CASE WHEN conv_id % 4 = 0 THEN 2 ELSE 3 END AS chunks FROM conversations),
g AS (SELECT *, sum(CASE WHEN chunk = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM p)
SELECT conv_id, min(grp)::BIGINT AS first_bad FROM (SELECT conv_id, grp, count(*) AS n, min(chunks) AS a, max(chunks) AS b, min(chunk) AS c, max(chunk) AS d, count(DISTINCT chunk) AS e FROM g GROUP BY ALL) WHERE grp = 0 OR a <> b OR n <> b OR c <> 0 OR d <> n - 1 OR e <> n GROUP BY conv_id""")
def validate_partition(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", (F.col("turn") % 3).alias("chunk"), F.when(F.col("conv_id") % 4 == 0, 2).otherwise(3).alias("chunks"))
    return checks.partition_violations(rows, ["conv_id"], "turn", "chunk", "chunks")


@query(VERSES.split("t AS")[0].rstrip().rstrip(",") + f"""SELECT count(DISTINCT book) AS books, count(DISTINCT (book, chapter)) AS chapters, count(*) AS verses, count(*) FILTER (verse > 50) AS long_chapters, 66 - count(DISTINCT book) AS missing FROM v""")
def inspect_book(t: Tables) -> DataFrame:
    """Coverage: books, chapters and verses present, canonical books missing."""
    v = _verses(t)
    return v.agg(F.count_distinct("book").alias("books"), F.count_distinct("book", "chapter").alias("chapters"), F.count(F.lit(1)).alias("verses"), F.count_if(F.col("verse") > 50).alias("long_chapters"), (F.lit(66) - F.count_distinct("book")).alias("missing"))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'overwrite' ELSE 'new' END AS status FROM customer")
def preflight_split(t: Tables) -> DataFrame:
    stored = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return checks.overwrite_split(t.customer.select("c_custkey"), stored, "c_custkey")


@query("""SELECT c.c_custkey, CASE WHEN s.s_suppkey IS NULL THEN 'new' WHEN s.s_nationkey <> c.c_nationkey THEN 'collision' ELSE 're-index' END AS status FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey""")
def collision(t: Tables) -> DataFrame:
    incoming = t.customer.select("c_custkey", F.col("c_nationkey").alias("slug"))
    stored = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("slug"))
    return checks.identity_probe(incoming, stored, ["c_custkey"], "slug").select("c_custkey", "status")


@query("""SELECT c.c_custkey AS code, s.s_suppkey AS other_code FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_custkey <> s.s_suppkey
WHERE NOT coalesce(CASE WHEN c.c_acctbal > 0 THEN floor(c.c_acctbal / 1000)::INT END <> CASE WHEN s.s_acctbal > 0 THEN floor(s.s_acctbal / 1000)::INT END, false)""")
def same_title(t: Tables) -> DataFrame:
    author = lambda c: F.when(F.col(c) > 0, F.floor(F.col(c) / 1000).cast("int")).alias("author")
    incoming = t.customer.select(F.col("c_nationkey").alias("title"), F.col("c_custkey").alias("code"), author("c_acctbal"))
    stored = t.supplier.select(F.col("s_nationkey").alias("title"), F.col("s_suppkey").alias("code"), author("s_acctbal"))
    return checks.same_title(incoming, stored).select("code", "other_code")


@query("""SELECT n_nationkey AS code, list_sort(list(DISTINCT 'de:' || s_suppkey))[1] AS first, count(DISTINCT s_suppkey)::INT AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_suppkey % 3 <> 0 GROUP BY n_nationkey""")
def paired(t: Tables) -> DataFrame:
    translations = t.supplier.select(F.when(F.col("s_suppkey") % 3 == 0, "en").otherwise("de").alias("lang"), F.col("s_suppkey").cast("string").alias("code"), F.col("s_nationkey").alias("book_pair"))
    found = checks.paired(t.nation.select(F.col("n_nationkey").alias("code")), translations)
    return found.groupBy("code").agg(F.min("pair").alias("first"), F.count(F.lit(1)).cast("int").alias("n"))


@query("""WITH e AS (SELECT o_orderkey AS k, (o_orderkey % 4)::BIGINT AS n FROM orders WHERE o_orderkey % 10 <> 0), f AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(e.k, f.k) AS k, coalesce(e.n, 0) AS n_expected, coalesce(f.n, 0) AS n_found FROM e FULL OUTER JOIN f ON e.k = f.k WHERE coalesce(e.n, 0) <> coalesce(f.n, 0)""")
def manifest_reconcile(t: Tables) -> DataFrame:
    expected = t.orders.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4).alias("n"))
    found = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return checks.reconcile(expected, found, ["k"])


@query("""WITH old AS (SELECT o_orderkey AS id, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS id, o_custkey + 1 AS o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new""")
def upsert_merge(t: Tables) -> DataFrame:
    from ..operators.store import merged

    rows = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice")
    return merged(rows.where("id % 3 <> 0"), rows.where("id % 2 = 0").withColumn("o_custkey", F.col("o_custkey") + 1), "id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus = 'F' AND o_custkey % 2 = 0, false)")
def delete_books(t: Tables) -> DataFrame:
    gone = (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 2 == 0)
    return t.orders.where(corpus.none_of(gone)).select("o_orderkey", "o_orderstatus")


@query("""WITH q AS (SELECT item_id, text, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS n FROM benchmark),
d AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS n FROM documents),
f AS (SELECT item_id, doc_id, contains(d.text, q.text) AS exact FROM q JOIN d ON contains(' ' || d.n || ' ', ' ' || q.n || ' '))
SELECT q.item_id, CASE WHEN bool_or(exact) THEN 'exact' WHEN count(doc_id) > 0 THEN 'normalised' ELSE 'none' END AS verdict, count(doc_id) AS documents, min(doc_id) AS first_doc FROM q LEFT JOIN f USING (item_id) GROUP BY q.item_id""")
def quote_verify(t: Tables) -> DataFrame:
    from ..operators.quotes import verify

    return verify(t.benchmark, t.documents)


#: Words 11 to 50 of the longer documents as quotations of five kinds: as they stand, with another source, with two words changed, with words left out, made up.
QUOTED = """WITH d AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id AS item_id, doc_id % 5 AS kind, array_to_string(CASE WHEN doc_id % 5 = 3 THEN w[11:25] || w[36:50] ELSE w[11:50] END, ' ') AS t, CASE WHEN doc_id % 5 = 1 THEN doc_id + 1 ELSE doc_id END AS cited FROM d WHERE len(w) >= 60 AND doc_id % 10 < 5)
"""


@query(QUOTED + """SELECT item_id, CASE WHEN kind = 2 THEN 'wording differs' WHEN kind = 4 THEN 'not found'
  WHEN contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || t || ' ') THEN 'verified' WHEN kind = 3 THEN 'incomplete' ELSE 'wrong reference' END AS verdict,
  CASE kind WHEN 3 THEN 30 ELSE 40 END AS words FROM q LEFT JOIN d ON d.doc_id = q.cited""", long="words")
def quote_verdicts(t: Tables) -> DataFrame:
    from ..operators.quotes import tokens_of, verdicts

    kind, w = F.col("doc_id") % 5, F.slice("w", 11, 40)
    taken = t.documents.select("doc_id", tokens_of(F.col("text")).alias("w")).where("doc_id % 10 < 5 and size(w) >= 60")
    changed = F.transform(w, lambda x, i: F.when(i.isin(9, 29), F.lit("zzqx")).otherwise(x))
    made_up = F.transform(w, lambda x, i: F.concat(F.lit("zzqx"), i.cast("string"), F.col("doc_id").cast("string")))
    said = F.when(kind == 2, changed).when(kind == 3, F.concat(F.slice("w", 11, 15), F.slice("w", 36, 15))).when(kind == 4, made_up).otherwise(w)
    quotes = taken.select(F.col("doc_id").alias("item_id"), F.array_join(said, " ").alias("text"), F.when(kind == 1, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("cited"))
    return verdicts(quotes, t.documents).select("item_id", "verdict", "words")
