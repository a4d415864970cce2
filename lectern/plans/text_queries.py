"""Queries on documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import corpus
from ..sources import texts
from .registry import Tables, query

# Fixed pieces of the SQL: lines of documents, and a word list that skips empty words.
LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS text FROM l WHERE trim(line) <> ''),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS para, text FROM p)
"""
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
BAD = """len(list_filter(regexp_extract_all({0}, '[A-Za-z’'']+'), lambda w:
  (length(w) > 2 AND regexp_matches(substring(w, 2), '[A-Z]') AND NOT regexp_full_match(replace(replace(w, '’', ''), '''', ''), '[A-Z]+'))
  OR (length(w) > 3 AND NOT regexp_matches(w, '[aeiouyAEIOUY]')))) + len(regexp_extract_all({0}, '[\\^~`|\\\\{{}}<>]'))"""
FOUND = "len(regexp_extract_all({0}, '[A-Za-z’'']+'))"
DAMAGE = f"(CASE WHEN {FOUND} = 0 THEN 1.0::DOUBLE ELSE ({BAD})::DOUBLE / {FOUND} END)"
CLEANED = """length(regexp_replace({0}, '[^A-Za-z0-9\\s.,;:!?''’‘"“”()\\[\\]{{}}—–\\-/&%$#*@+=°£§¶†‡]', '', 'g'))"""
JUNK = f"(CASE WHEN length({{0}}) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {CLEANED} / length({{0}})::DOUBLE END)"
REASON = f"CASE WHEN {WORDS} < 8 THEN 'short' WHEN {DAMAGE} > 0.25 THEN 'damage' WHEN {JUNK} > 0.02 THEN 'junk' END"


def _lines(t: Tables) -> DataFrame:
    return corpus.paragraphs_of(t.documents.select("doc_id", "text"), "\n")


@query(LINES + "SELECT doc_id, para, md5(text) AS digest FROM n", long="para")
def paragraph_split(t: Tables) -> DataFrame:
    return _lines(t).select("doc_id", "para", F.md5("text").alias("digest"))


@query(f"SELECT doc_id, {WORDS.format('text')} AS words, length(text) AS chars FROM documents", long="chars words")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.word_count(F.col("text")).alias("words"), F.length("text").alias("chars"))


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?;:])(?:["”’''])?\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)
SELECT doc_id, len(parts) AS sentences, list_max(list_transform(parts, lambda x: length(x))) AS longest FROM s""", long="longest sentences")
def sentence_split(t: Tables) -> DataFrame:
    parts = T.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(parts).alias("sentences"), F.array_max(F.transform(parts, F.length)).alias("longest"))


@query(LINES + f"SELECT doc_id, para, {REASON.format('text')} AS reason FROM n", long="para")
def quality_gate(t: Tables) -> DataFrame:
    return T.measured(_lines(t), "text").select("doc_id", "para", T.reason_of().alias("reason"))


@query(f"SELECT doc_id, {BAD.format('text')} AS bad, {FOUND.format('text')} AS words, round({DAMAGE.format('text')}, 6) AS damage, round({JUNK.format('text')}, 6) AS junk FROM documents", long="words bad")
def damage_score(t: Tables) -> DataFrame:
    rows = T.measured(t.documents.select("doc_id", "text"), "text")
    return rows.select("doc_id", F.col("m.bad").alias("bad"), F.col("m.found").alias("words"), F.round(T.damage_of(), 6).alias("damage"), F.round(T.junk_of(), 6).alias("junk"))


@query(LINES + f"SELECT doc_id, para, reason, substring(text, 1, 80) AS preview FROM (SELECT *, {REASON.format('text')} AS reason FROM n) WHERE reason IS NOT NULL", long="para")
def dropped_detail(t: Tables) -> DataFrame:
    reasons = T.measured(_lines(t), "text").withColumn("reason", T.reason_of()).where("reason is not null")
    return reasons.select("doc_id", "para", "reason", F.substring("text", 1, 80).alias("preview"))


@query(
    LINES
    + f""", g AS (SELECT *, {REASON.format('text')} AS reason, {WORDS.format('text')} AS w, {BAD.format('text')} AS bad, {FOUND.format('text')} AS f FROM n)
SELECT doc_id, count(*) AS blocks_in, count(reason) AS dropped, coalesce(sum(w) FILTER (reason IS NULL), 0)::BIGINT AS words,
  round(CASE WHEN coalesce(sum(f) FILTER (reason IS NULL), 0) = 0 THEN 0 ELSE sum(bad) FILTER (reason IS NULL) / sum(f) FILTER (reason IS NULL) END, 6)::DOUBLE AS damage FROM g GROUP BY doc_id"""
)
def extraction_stats(t: Tables) -> DataFrame:
    rows = T.measured(_lines(t), "text").select("doc_id", T.reason_of().alias("reason"), F.col("m.words").alias("w"), F.col("m.bad").alias("bad"), F.col("m.found").alias("f"))
    kept = lambda c: F.sum(F.when(F.col("reason").isNull(), F.col(c)))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks_in"), F.count("reason").alias("dropped"), F.coalesce(kept("w"), F.lit(0)).alias("words"), F.round(F.when(F.coalesce(kept("f"), F.lit(0)) == 0, 0.0).otherwise(kept("bad") / kept("f")), 6).alias("damage"))


@query(f"""WITH s AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(text, '([.!?;:])["”’'']?[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: {{'done': []::VARCHAR[], 'open': x, 'n': {WORDS.format('x')}}}) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_reduce(l, lambda a, b: CASE WHEN a.n + b.n > 220 THEN {{'done': list_append(a.done, a.open), 'open': b.open, 'n': b.n}} ELSE {{'done': a.done, 'open': a.open || ' ' || b.open, 'n': a.n + b.n}} END) AS r FROM s WHERE {WORDS.format('text')} > 300),
q AS (SELECT doc_id, generate_subscripts(r.done, 1) AS i, unnest(r.done) AS t FROM p UNION ALL SELECT doc_id, len(r.done) + 1, r.open FROM p),
w AS (SELECT *, regexp_extract_all(t, '\\S+') AS v FROM q),
c AS (SELECT doc_id, i, 0 AS j, t FROM w WHERE len(v) <= 300 UNION ALL SELECT doc_id, i, j, array_to_string(v[j + 1:j + 220], ' ') FROM (SELECT *, unnest(range(0, len(v), 220)) AS j FROM w WHERE len(v) > 300)),
o AS (SELECT doc_id, i, j, t FROM c WHERE trim(t) <> '' UNION ALL SELECT doc_id, 0, 0, text FROM s WHERE {WORDS.format('text')} <= 300)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS seq, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk,
  count(*) OVER (PARTITION BY doc_id) AS chunks, {WORDS.format('t')} AS words, md5(t) AS digest FROM o""", long="seq chunk chunks words")
def chunk_long(t: Tables) -> DataFrame:
    docs = t.documents.where("text is not null").select("doc_id", F.lit("1.1").alias("para_key"), F.lit(0).alias("pos"), "text")
    return corpus.chunks_of(docs, ["doc_id", "para_key"], ["pos"]).select("doc_id", "seq", "chunk", "chunks", "words", F.md5("text").alias("digest"))


@query(LINES + f"""SELECT doc_id, (1 + sum(h) OVER (PARTITION BY doc_id ORDER BY para))::BIGINT AS page, para, h = 1 AS heading,
  CASE WHEN h = 1 THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, g, h ORDER BY para) END AS in_page
FROM (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY para) AS g FROM (SELECT doc_id, para, CASE WHEN {WORDS.format('text')} < 8 THEN 1 ELSE 0 END AS h FROM n))""", long="para")
def heading_numbering(t: Tables) -> DataFrame:
    """Short lines as headings: they start a page and restart the paragraphs."""
    marked = _lines(t).select("doc_id", "para", F.when(T.word_count(F.col("text")) < 8, F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text")).alias("text"))
    lines = marked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    rows = texts.markdown_blocks(lines, "doc_id")
    return rows.select("doc_id", "page", (F.col("pos") + 1).alias("para"), "heading", F.col("para").alias("in_page"))


@query(LINES + """, m AS (SELECT doc_id, para, text, CASE WHEN para % 4 = 3 THEN length(text) % 1000 END AS mark FROM n),
g AS (SELECT *, count(mark) OVER (PARTITION BY doc_id ORDER BY para) AS grp FROM m)
SELECT doc_id, para AS pos, coalesce(max(mark) OVER (PARTITION BY doc_id, grp), 0) AS page,
  row_number() OVER (PARTITION BY doc_id, grp, mark IS NULL ORDER BY para) AS para FROM g QUALIFY mark IS NULL""", long="para pos")
def page_carry_forward(t: Tables) -> DataFrame:
    """Every fourth line stands for a printed page mark."""
    mark = F.concat(F.lit("["), (F.length("text") % 1000).cast("string"), F.lit("]"))
    rows = _lines(t).select("doc_id", F.col("para").alias("pos"), F.when(F.col("para") % 4 == 3, mark).otherwise(F.concat(F.lit("x"), F.col("text"))).alias("text"))
    return texts.carried_pages(rows, "doc_id").select("doc_id", "pos", "page", "para")


@query()
def html_blocks(t: Tables) -> DataFrame:
    """The block pattern refers back to its tag, which the SQL engine's patterns cannot; tested on pages with known blocks."""
    return texts.html_blocks(t.pages.select("page_id", "html")).select("page_id", "pos", F.md5("text").alias("digest"), F.length("text").alias("chars"))


@query("""SELECT page_id, regexp_matches(html, '(?i)' || 'produced in EPUB format by the Internet Archive|relies on optical character recognition|scanned and converted to EPUB format automatically|this page is estimated to be|The Internet Archive was founded in 1996|archive\\.org/details|Online Distributed Proofreading Team|pgdp\\.net|Project Gutenberg') AS boilerplate,
  len(regexp_extract_all(lower(html), '<p[ >]')) AS paragraphs FROM pages""", long="paragraphs")
def boilerplate_drop(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.is_boilerplate(F.col("html")).alias("boilerplate"), F.size(F.regexp_extract_all(F.lower("html"), F.lit("<p[ >]"), F.lit(0))).alias("paragraphs"))


@query("""WITH r AS (SELECT l_orderkey, string_agg(l_linenumber || ' ' || l_partkey || ' ' || l_suppkey || ' ' || l_returnflag || ' ' || l_quantity::INT || ',', ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line FROM lineitem GROUP BY 1),
w AS (SELECT l_orderkey, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS tokens FROM r)
SELECT l_orderkey, len(tokens) AS tokens, len(tokens) > 20 AND len(list_filter(tokens, lambda w: regexp_full_match(w, '[\\d.,;:—–-]+'))) > 0.35 * len(tokens) AS numeric_line FROM w""", long="tokens")
def numeric_line_drop(t: Tables) -> DataFrame:
    """Order lines as text: mostly numbers, as an index is."""
    piece = F.concat_ws(" ", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",")))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", piece.alias("p")))), lambda x: x["p"]), " ").alias("line"))
    return lines.select("l_orderkey", T.word_count(F.col("line")).alias("tokens"), T.is_numeric_line(F.col("line")).alias("numeric_line"))


@query("""WITH b AS (SELECT doc_id % 100 AS book, doc_id AS pos, CASE WHEN doc_id % 5 < 4 THEN upper(substring(lang, 1, 1)) || substring(lang, 2) || (doc_id % 7 // 4) END AS code FROM documents),
c AS (SELECT book, code, count(*) AS n, min(pos) AS first FROM b WHERE code IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC, first) = 1)
SELECT book, code, n, blocks FROM best JOIN (SELECT book, count(*) AS blocks FROM b GROUP BY book) USING (book) WHERE n >= 0.4 * blocks""")
def citation_code_mode(t: Tables) -> DataFrame:
    """A printed reference after most documents, its code made of language and number."""
    code = F.concat(F.initcap("lang"), F.floor(F.col("doc_id") % 7 / 4).cast("string"))
    text = F.when(F.col("doc_id") % 5 < 4, F.concat(F.lit("text "), code, F.lit(" 12.3"))).otherwise("text")
    blocks = t.documents.select((F.col("doc_id") % 100).alias("book"), F.col("doc_id").alias("pos"), text.alias("text"))
    return corpus.citation_mode(blocks, ["book"], "pos")


@query("""WITH u AS (SELECT doc_id, lang || ':' || source || ':' || (doc_id // 10) || '.' || (doc_id % 10) || '#' || (doc_id % 4) AS uid FROM documents),
h AS (SELECT doc_id, uid, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(uid)) AS h FROM u)
SELECT doc_id, uid, (doc_id % 4)::INT AS seq, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' ||
  substring('89ab89ab89ab89ab', ('0x' || substring(h, 17, 1))::INT + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS id FROM h""")
def point_ids_uuid5(t: Tables) -> DataFrame:
    key = F.concat_ws(".", F.floor(F.col("doc_id") / 10).cast("string"), (F.col("doc_id") % 10).cast("string"))
    rows = t.documents.select("doc_id", ids.uid(ids.RULES["sop/seq"], lang=F.col("lang"), book_code=F.col("source"), para_key=key, seq=F.col("doc_id") % 4).alias("uid"))
    return rows.select("doc_id", "uid", ids.sequence_of(F.col("uid")).alias("seq"), ids.uuid5(F.col("uid")).alias("id"))


@query("""WITH w AS (SELECT doc_id, text, list_contains(string_split(lower(text), ' '), 'the') AS hit FROM documents)
SELECT doc_id, length(text) AS chars FROM w WHERE hit ORDER BY doc_id LIMIT 200""", long="chars")
def citation_search(t: Tables) -> DataFrame:
    """Documents whose list of words holds one: at most 200, as the tool returns."""
    return t.documents.where(F.array_contains(F.split(F.lower("text"), " "), "the")).select("doc_id", F.length("text").alias("chars")).orderBy("doc_id").limit(200)


@query("""WITH k AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normal FROM documents)
SELECT doc_id, source, copies FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY normal) AS copies, row_number() OVER (PARTITION BY normal ORDER BY source, doc_id) AS rn FROM k) WHERE rn = 1 AND copies > 1""")
def dedupe_compilations(t: Tables) -> DataFrame:
    """Texts that occur more than once, kept where the smallest source has them; counted before the shuffle."""
    keyed = t.documents.select(F.sha2(T.normal_form(F.col("text")), 256).alias("k"), F.struct("source", "doc_id").alias("p"))
    best = keyed.groupBy("k").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return best.select("p.doc_id", "p.source", "copies")
