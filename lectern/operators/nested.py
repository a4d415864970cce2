"""Results as nested values: maps of maps where the first value wins, answers in the order of their questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def first_values(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each key the first value of each column that is not null, in the given order: columns are judged apart."""
    place = F.struct(*order)
    firsts = [F.expr(f"min_by(`{c}`, _place) filter (where `{c}` is not null)").alias(c) for c in columns]
    return rows.withColumn("_place", place).groupBy(*key).agg(*firsts)


def titles_fragment(books: DataFrame, order: str = "pos") -> DataFrame:
    """One row with the JSON {language: {code: {titles, author, year, corpus, en_code}}} of the books of a pack, in `json`.

    books: lang, book_code, title, author, year, corpus, book_pair and `order`, where they stand in the pack.  Titles are all different
    ones in their order; of the others the first that is not null counts, and fields without one are left out.  en_code is the part behind
    the slash of the pair of a book that is not English.  Books without a language are left out; no books give an empty object.
    Languages and codes come in order.  The pack's books are what is gathered, never points.
    """
    books = books.where("lang is not null and book_code is not null")
    pair = F.trim(F.when((F.col("lang") != "en") & F.col("book_pair").contains("/"), F.expr("substring(book_pair, instr(book_pair, '/') + 1)")))
    books = books.withColumn("en_code", F.when(pair != "", pair))
    titles = books.where("title is not null").groupBy("lang", "book_code", "title").agg(F.min(order).alias("at"))
    titles = titles.groupBy("lang", "book_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]).alias("titles"))
    rest = first_values(books, ["lang", "book_code"], [order], ["author", "year", "corpus", "en_code"])
    entry = F.struct(F.coalesce("titles", F.array().cast("array<string>")).alias("titles"), "author", "year", "corpus", "en_code")
    by_code = rest.join(titles, ["lang", "book_code"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("book_code", entry.alias("entry")))).alias("codes"))
    languages = F.transform(F.array_sort(F.collect_list(F.struct("lang", "codes"))), lambda x: F.struct(x["lang"], F.map_from_entries(x["codes"])))
    whole = by_code.agg(F.map_from_entries(languages).alias("all"))
    return whole.select(F.to_json("all", {"ignoreNullFields": "true"}).alias("json"))


def answers(queries: DataFrame, hits: DataFrame, columns: list[str]) -> DataFrame:
    """(query_id, query, hits, fallbacks): every query in its place, with the hits of the first pass and, if there are none, those of the second.

    queries: query_id and query; hits: query_id, pass (1 or 2), rank and `columns`.  Lists keep the order of rank; queries without hits
    have empty ones.  A list is as long as the limit of the search, which is the caller's.
    """
    hit = F.struct("rank", F.struct(*columns).alias("hit"))
    listed = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("pass") == n, hit))), lambda x: x["hit"])
    by_query = hits.groupBy("query_id").agg(listed(1).alias("hits"), listed(2).alias("fallbacks"))
    found = queries.select("query_id", "query").join(by_query, "query_id", "left")
    nothing = F.array().cast(by_query.schema["hits"].dataType)
    own = F.coalesce("hits", nothing)
    return found.select("query_id", "query", own.alias("hits"), F.when(F.size(own) > 0, nothing).otherwise(F.coalesce("fallbacks", nothing)).alias("fallbacks"))


def results_json(found: DataFrame) -> Column:
    """The JSON text of one answer: its query, hits and fallbacks; fields of a hit without a value are left out."""
    return F.to_json(F.struct("query", "hits", "fallbacks"), {"ignoreNullFields": "true"})


def editions_union(verses: DataFrame, wanted: DataFrame) -> DataFrame:
    """Verses of several editions, each by its own list of keys: (key_pos, bible_pos, bible, osis, text), every verse of an edition once.

    wanted: bible, bible_pos, osis (as the edition numbers it) and key_pos.  Branches that name the same verse of an edition
    give it once, at the first place that asked for it.
    """
    asked = wanted.groupBy("bible", "osis").agg(F.min("bible_pos").alias("bible_pos"), F.min("key_pos").alias("key_pos"))
    first = Window.partitionBy("bible", "osis").orderBy("text")
    return verses.join(asked, ["bible", "osis"]).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("key_pos", "bible_pos", "bible", "osis", "text")


def ordered_specs(asked: DataFrame, pos: str, *columns: str) -> DataFrame:
    """Book specifications in the order given, blank fields as null, each once at its first place."""
    plain = asked.select(pos, *[T.truthy(T.stripped(F.col(c).cast("string"))).alias(c) for c in columns])
    return plain.groupBy(*columns).agg(F.min(pos).alias(pos)).select(pos, *columns)
