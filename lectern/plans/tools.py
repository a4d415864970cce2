"""The read tools: functions of point tables that return DataFrames.

sop points: id, lang, book_code, book_pair, page, para, para_key, raw_text, aligned, corpus, author, title, page_kind,
chunk, bible_refs, vector.  bible points: id, bible, osis, text, vector.  Arguments are checked on the driver; a wrong one
raises ValueError.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import osis
from ..functions import text as T
from ..operators import corpus, search
from . import versification

FALLBACK_SCORE = 0.50
MAX_QUERIES, MAX_PARAGRAPHS, MAX_NEIGHBOURS = 50, 400, 20
PROVENANCE = ("corpus", "author", "page_kind")


def clamp(n: int, lo: int, hi: int) -> int:
    return min(max(n, lo), hi)


def provenance() -> list:
    return [T.truthy(F.col(c)).alias(c) for c in PROVENANCE]


def normalized(points: DataFrame) -> DataFrame:
    """Points without a corpus belong to the main one and its author; an English book is its own original."""
    main = T.truthy(F.col("corpus")).isNull()
    return points.withColumns(
        {
            "author": F.when(main & T.truthy(F.col("author")).isNull(), "Ellen G. White").otherwise(F.col("author")),
            "corpus": F.when(main, "egw").otherwise(F.col("corpus")),
            "book_pair": F.when((F.col("lang") == "en") & T.truthy(F.col("book_pair")).isNull(), F.col("book_code")).otherwise(F.col("book_pair")),
        }
    )


def query_table(spark: SparkSession, queries: list, default_codes: list[str] | None) -> DataFrame:
    """Queries (a vector, or {'vector', 'codes'}) as rows (query_id, vector, codes) in the order given."""
    if not queries:
        raise ValueError("no query given")
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries")
    rows = [(i, *((q["vector"], q.get("codes") or default_codes) if isinstance(q, dict) else (q, default_codes))) for i, q in enumerate(queries)]
    return spark.createDataFrame([(i, [float(x) for x in v], c) for i, v, c in rows], "query_id bigint, vector array<double>, codes array<string>")


def sop_lookup(points: DataFrame, queries: list, codes: list[str] | None = None, lang: str = "de", min_score: float = 0.55, limit: int = 1) -> DataFrame:
    """Semantic lookup in two passes: in the given books at min_score, then in all books at 0.50 for queries without a hit."""
    limit = clamp(limit, 1, 20)
    asked = query_table(points.sparkSession, queries, codes)
    own = points.where(F.col("lang") == lang)
    vectors = own.select("id", "vector", "book_code")
    per_code = asked.withColumn("book_code", F.explode_outer("codes"))
    named, free = per_code.where("book_code is not null"), per_code.where("book_code is null")
    # Each (query, code) is a search of its own; the best of a query's codes are ranked together.
    numbered = named.withColumn("qc", F.col("query_id") * 10_000 + F.row_number().over(Window.partitionBy("query_id").orderBy("book_code")))
    by_code = search.cosine_topk(vectors, numbered.select(F.col("qc").alias("query_id"), "vector", "book_code"), limit, min_score, ("book_code",)).withColumn("query_id", F.floor(F.col("query_id") / 10_000))
    anywhere = search.cosine_topk(vectors, free.select("query_id", "vector"), limit, min_score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    first = by_code.unionByName(anywhere).withColumn("rank", rank).where(F.col("rank") <= limit).withColumn("pass", F.lit(1))
    empty = asked.join(first.select("query_id").distinct(), "query_id", "left_anti")
    second = search.cosine_topk(vectors, empty.select("query_id", "vector"), limit, FALLBACK_SCORE).withColumn("pass", F.lit(2))
    hits = first.unionByName(second).withColumnRenamed("id", "point")
    shown = own.select(F.col("id").alias("point"), "book_code", "page", "para_key", F.col("raw_text").alias("text"), *provenance())
    return hits.join(shown, "point").drop("point").withColumn("score", F.round("score", 3)).orderBy("query_id", "rank")


def sop_book_paragraphs(points: DataFrame, book_code: str, page_from: int, page_to: int | None = None, lang: str = "de") -> DataFrame:
    """The paragraphs of a page range, cut at a page after 400; next_page_from tells where to go on."""
    last = page_from if page_to is None else page_to
    rows = points.where((F.col("lang") == lang) & (F.col("book_code") == book_code) & F.col("page").between(page_from, last))
    cut = corpus.page_cut(rows, ["lang", "book_code"], "page", ["para", "chunk", "id"], F.lit(last), MAX_PARAGRAPHS)
    return cut.select("book_code", "page", "para", "para_key", F.col("raw_text").alias("text"), *provenance(), "next_page_from").orderBy("page", "para")


def sop_list_books(points: DataFrame, lang: str | None = None, find: str | None = None) -> DataFrame:
    """Languages with their counts, or the books of a language, or the books that a search finds."""
    if lang is None and find is None:
        return corpus.facet(points, "lang").orderBy("lang")
    index = corpus.book_index(normalized(points), ["title", "author", "corpus", "book_pair", "page_kind"])
    books = corpus.list_books(index, find)
    return (books if lang is None else books.where(F.col("lang") == lang)).orderBy("lang", "book_code")


def sop_context(points: DataFrame, book_code: str, para_key: str, lang: str = "en", before: int = 2, after: int = 2) -> DataFrame:
    """Neighbours of a paragraph in book order; every piece of the paragraph is marked."""
    if not re.fullmatch(r"\d+\.\w+", para_key):
        raise ValueError("para_key must be PAGE.PARA")
    before, after = clamp(before, 0, MAX_NEIGHBOURS), clamp(after, 0, MAX_NEIGHBOURS)
    book = points.where((F.col("lang") == lang) & (F.col("book_code") == book_code)).withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    anchor = book.where(F.col("para_key") == para_key).orderBy("page", "para", "chunk").limit(1).select(F.lit(0).alias("anchor_id"), "lang", "book_code", "page", "para", "chunk")
    rows = corpus.context(book, anchor, ["lang", "book_code"], ["page", "para", "chunk"], before, after)
    return rows.select("page", "para", "para_key", F.col("raw_text").alias("text"), (F.col("para_key") == para_key).alias("is_target")).orderBy("page", "para")


def sop_parallel(points: DataFrame, book_code: str, para_key: str, lang: str = "de", target_lang: str = "en") -> DataFrame:
    """The aligned paragraphs in the other language; only German and English are aligned."""
    if {lang, target_lang} != {"de", "en"}:
        raise ValueError("only de and en are aligned")
    own = points.where((F.col("lang") == lang) & (F.col("book_code") == book_code) & (F.col("para_key") == para_key))
    other = points.where(F.col("lang") == target_lang)
    if lang == "de":
        return corpus.aligned_originals(own, other).select("book_pair", "en_key", F.col("en_text").alias("text")).orderBy("en_key")
    return corpus.aligned_translations(own, other).select("t_book", "t_key", F.col("t_text").alias("text")).orderBy("t_book", "t_key")


def sop_by_bible_ref(points: DataFrame, ref: str, lang: str = "en", limit: int = 20) -> DataFrame:
    """Paragraphs that cite a verse."""
    rows = points.where((F.col("lang") == lang) & F.array_contains("bible_refs", ref))
    return rows.select("book_code", "page", "para_key", F.col("raw_text").alias("text"), *provenance(), "id").orderBy("id").limit(clamp(limit, 1, 200)).drop("id")


def bible_list_translations(verses: DataFrame) -> DataFrame:
    mapped = sorted({r[0] for r in versification.rules()})
    return corpus.facet(verses, "bible").select("bible", F.col("n").alias("verses"), F.col("bible").isin(mapped).alias("kjv_remapped")).orderBy("bible")


def bible_search(verses: DataFrame, vector: list[float], bible: str | None = None, limit: int = 5, min_score: float = 0.5) -> DataFrame:
    own = verses if bible is None else verses.where(F.col("bible") == bible)
    query = query_table(verses.sparkSession, [vector], None).select("query_id", "vector")
    hits = search.cosine_topk(own.select("id", "vector"), query, clamp(limit, 1, 20), min_score)
    return own.withColumn("point", F.col("id")).join(hits.select(F.col("id").alias("point"), "score", "rank"), "point").select("osis", "bible", "text", "score", "rank").orderBy("rank")


def _requested(spark: SparkSession, ref: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The references asked for, their keys, and each key with the position of its first mention."""
    asked = spark.createDataFrame([(ref,)], "refs string").select(F.posexplode(osis.split_refs(F.col("refs"))).alias("ref_pos", "ref"))
    expanded = osis.expand_refs(asked)
    keys = expanded.groupBy("key").agg(F.min(F.struct("ref_pos", "key_pos")).alias("pos"))
    n = keys.limit(osis.MAX_KEYS + 1).count()
    if not n:
        raise ValueError("no reference given")
    if n > osis.MAX_KEYS:
        raise ValueError(f"more than {osis.MAX_KEYS} verses are asked for")
    return asked, expanded, keys


def bible_lookup(verses: DataFrame, ref: str, bible: str | list[str] | None = None, numbering: str = "edition") -> tuple[DataFrame, DataFrame]:
    """(verses found in order, references that matched nothing); with numbering 'kjv' each edition's own numbers are found
    from the usual ones, and kjv_osis tells the way back."""
    if numbering not in ("edition", "kjv"):
        raise ValueError("numbering must be 'edition' or 'kjv'")
    spark = verses.sparkSession
    asked, expanded, keys = _requested(spark, ref)
    bibles = [bible] if isinstance(bible, str) else list(bible or [])
    own = verses if not bibles else verses.where(F.col("bible").isin(bibles))
    own = corpus.first_per(own, ["bible", "osis"], [F.col("id")])
    if numbering == "edition":
        found = own.join(keys.withColumnRenamed("key", "osis"), "osis").withColumn("kjv_osis", F.col("osis"))
    else:
        there = verses.where("bible = 'kjv'").select(F.col("osis").alias("key")).distinct()
        part = F.split("key", "\\.")
        existing = keys.join(there, "key", "left_semi").select("key", "pos", part[0].alias("book"), part[1].cast("int").alias("chapter"), part[2].cast("int").alias("verse"))
        targets = own.select(F.col("bible").alias("target")).distinct()
        # A few editions meet at most MAX_KEYS keys.
        moved = versification.remap(existing.crossJoin(F.broadcast(targets)), versification.rule_table(spark))
        edition_key = F.concat_ws(".", "book", F.col("ed_chapter").cast("string"), F.col("ed_verse").cast("string"))
        back = moved.withColumn("osis", edition_key).groupBy(F.col("target").alias("bible"), "osis").agg(F.max_by(F.struct("key", "pos"), "pos").alias("k"))
        found = own.join(back, ["bible", "osis"]).select(*own.columns, F.col("k.key").alias("kjv_osis"), F.col("k.pos").alias("pos"))
    order = F.array_position(F.array(*map(F.lit, bibles)), F.col("bible")) if bibles else F.lit(0)
    shown = found.withColumn("_b", F.when(order == 0, len(bibles) + 1).otherwise(order)).orderBy("pos", "_b", "bible").select("osis", "bible", "text", "kjv_osis")
    hit = expanded.join(found.select(F.col("kjv_osis").alias("key")).distinct(), "key", "left_semi").select("ref_pos").distinct()
    missing = asked.join(hit, "ref_pos", "left_anti").orderBy("ref_pos")
    return shown, missing
