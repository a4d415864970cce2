"""Operators on paragraphs, books and their alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def facet(df: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """Exact counts of each value; null values are skipped."""
    df = df if where is None else df.where(where)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def none_of(*conditions: Column) -> Column:
    """must_not: a condition that is null does not match, so the row stays."""
    keep = F.lit(True)
    for c in conditions:
        keep = keep & ~F.coalesce(c, F.lit(False))
    return keep


def any_of(groups: list[list[Column]]) -> Column:
    """should: at least one of the groups of conditions, of which each must hold; a condition that is null does not."""
    found = F.lit(False)
    for conditions in groups:
        every = F.lit(True)
        for c in conditions:
            every = every & F.coalesce(c, F.lit(False))
        found = found | every
    return found


def retrieved(points: DataFrame, ids: DataFrame, pos: str = "pos") -> DataFrame:
    """Points of a list of ids (id and `pos`), in its order by `pos`: missing ids are left out, one that is asked for twice comes once."""
    first = ids.where("id is not null").groupBy("id").agg(F.min(pos).alias(pos))
    return points.join(first, "id")


def attributable(points: DataFrame, corpus: str = "egw") -> DataFrame:
    """Points whose words may be given under the main author's name: those of the main corpus; one without a corpus belongs to it."""
    return points.where(F.coalesce(F.nullif(F.col("corpus"), F.lit("")), F.lit(corpus)) == corpus)


def is_empty(column: Column, array: bool = False) -> Column:
    return column.isNull() | ((F.size(column) == 0) if array else (column == ""))


def book_index(points: DataFrame, meta: list[str], order: str = "id") -> DataFrame:
    """For each language and book the number of paragraphs and the metadata of its first point."""
    return points.groupBy("lang", "book_code").agg(F.count(F.lit(1)).alias("paragraphs"), F.min_by(F.struct(*meta), order).alias("m")).select("lang", "book_code", "paragraphs", "m.*")


def list_books(index: DataFrame, search: str | None = None) -> DataFrame:
    """Books with the English title of a translation; `search` is looked for in code, titles, author and corpus, case-folded."""
    english = index.where("lang = 'en'").select(F.col("book_code").alias("book_pair"), F.col("title").alias("en_title"))
    books = index.join(english, "book_pair", "left")
    if search is not None:
        books = books.where(T.folded(F.concat_ws(" ", "book_code", "title", "en_title", "author", "corpus")).contains(T.folded(F.lit(search))))
    return books


def context(paragraphs: DataFrame, anchors: DataFrame, book: list[str], order: list[str], before: int = 2, after: int = 2) -> DataFrame:
    """Neighbours of each anchor in book order, with is_target; anchors hold the book and order columns and anchor_id.

    Positions come from one window for each book; the join is on book and position, so it stays an equality.
    """
    placed = paragraphs.withColumn("_rn", F.row_number().over(Window.partitionBy(*book).orderBy(*order)))
    wanted = placed.join(anchors, [*book, *order]).select("anchor_id", *book, F.col("_rn").alias("_at"), F.explode(F.sequence(F.col("_rn") - before, F.col("_rn") + after)).alias("_rn"))
    return wanted.join(placed, [*book, "_rn"]).withColumn("is_target", F.col("_rn") == F.col("_at")).drop("_rn", "_at")


def page_cut(paragraphs: DataFrame, book: list[str], page: str, order: list[str], page_to: Column, most: int = 400) -> DataFrame:
    """At most `most` paragraphs of each book, cut before the page that would exceed them; a first page that alone
    exceeds them comes whole.  Adds next_page_from: where to go on, if that is not past `page_to`."""
    w = Window.partitionBy(*book)
    rows = paragraphs.withColumn("_rn", F.row_number().over(w.orderBy(page, *order)))
    rows = rows.withColumns({"_cut": F.max(F.when(F.col("_rn") == most + 1, F.col(page))).over(w), "_first": F.min(page).over(w)})
    rows = rows.withColumn("_cut", F.when(F.col("_cut") > F.col("_first"), F.col("_cut")).when(F.col("_cut").isNotNull(), F.col("_first") + 1))
    kept = rows.where(F.col("_cut").isNull() | (F.col(page) < F.col("_cut")))
    return kept.withColumn("next_page_from", F.when(F.col("_cut") <= page_to, F.col("_cut"))).drop("_rn", "_cut", "_first")


def aligned_originals(translated: DataFrame, originals: DataFrame) -> DataFrame:
    """Each translated paragraph with the originals it names: translated has book_pair, para_key and aligned (array of keys)."""
    wanted = translated.select("lang", "book_pair", "para_key", F.posexplode("aligned").alias("pos", "en_key"))
    right = originals.select(F.col("book_code").alias("book_pair"), F.col("para_key").alias("en_key"), F.col("raw_text").alias("en_text"))
    return wanted.join(right, ["book_pair", "en_key"])


def aligned_translations(originals: DataFrame, translated: DataFrame) -> DataFrame:
    """Each original paragraph with the translated ones that name it."""
    named = translated.select(F.col("book_pair").alias("book_code"), F.explode("aligned").alias("para_key"), F.col("book_code").alias("t_book"), F.col("para_key").alias("t_key"), F.col("raw_text").alias("t_text"))
    return originals.select("book_code", "para_key").join(named, ["book_code", "para_key"])


def inverted(reverse: DataFrame, en_key: str, own_keys: str) -> DataFrame:
    """{original key: [own keys]} as {own key: [original keys]}: (own_key, aligned), keys sorted."""
    pairs = reverse.select(F.col(en_key).alias("en_key"), F.explode(own_keys).alias("own_key")).distinct()
    return pairs.groupBy("own_key").agg(F.array_sort(F.collect_list("en_key")).alias("aligned"))


def paragraphs_of(docs: DataFrame, separator: str = "\\n\\s*\\n+") -> DataFrame:
    """Split text into trimmed paragraphs numbered from 1; empty ones take no number, ones that a gate drops later do."""
    clean = F.transform(F.split("text", separator), lambda p: F.regexp_replace(T.stripped(p), "[ \\t]+", " "))
    # The outer form, as for the other the optimiser makes all paragraphs a second time to ask whether there are any.
    rows = docs.withColumn("_p", F.filter(clean, lambda p: p != "")).select(*[c for c in docs.columns if c != "text"], F.posexplode_outer("_p").alias("para", "text"))
    return rows.where("text is not null").withColumn("para", F.col("para") + 1)


def chunks_of(paragraphs: DataFrame, key: list[str], order: list[str], limits: T.Limits = T.Limits()) -> DataFrame:
    """Pieces of paragraphs with chunk (in the paragraph), chunks and seq (over all paragraphs that share a key, in order)."""
    pieces = paragraphs.withColumn("_pieces", T.split_long(F.col("text"), limits)).withColumn("chunks", F.size("_pieces"))
    before = F.coalesce(F.sum("chunks").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("_base", before).select(*paragraphs.drop("text").columns, "chunks", "_base", F.posexplode("_pieces").alias("chunk", "text"))
    return rows.withColumn("seq", F.col("_base") + F.col("chunk")).drop("_base").withColumn("words", T.word_count(F.col("text")))


def citation_mode(blocks: DataFrame, book: list[str], order: str, least: float = 0.4) -> DataFrame:
    """The inline citation code of each book: the most frequent, the first seen of equals, if enough blocks carry it."""
    code, *_ = T.citation(F.col("text"))
    coded = blocks.withColumn("code", code)
    total = coded.groupBy(*book).agg(F.count(F.lit(1)).alias("blocks"))
    counts = coded.where("code is not null").groupBy(*book, "code").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(*book).agg(F.min(F.struct((-F.col("n")).alias("minus"), "first", "code")).alias("b")).select(*book, F.col("b.code").alias("code"), (-F.col("b.minus")).alias("n"))
    return best.join(total, book).where(F.col("n") >= least * F.col("blocks"))


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
