"""Validation and reconciliation: each returns rows that tell what is wrong, or counts that should agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def density(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Keys whose numbers are not exactly 0 .. n - 1."""
    found = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("lo"), F.max(seq).alias("hi"), F.count_distinct(seq).alias("distinct"))
    return found.where((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("distinct") != F.col("n")))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def partition_violations(df: DataFrame, key: list[str], seq: str, chunk: str, chunks: str) -> DataFrame:
    """Keys whose pieces are not whole paragraphs: each starts at chunk 0, has `chunks` pieces numbered 0 .. chunks - 1."""
    w = Window.partitionBy(*key).orderBy(seq)
    groups = df.withColumn("_group", F.sum(F.when(F.col(chunk) == 0, 1).otherwise(0)).over(w))
    per = groups.groupBy(*key, "_group").agg(F.count(F.lit(1)).alias("pieces"), F.min(chunks).alias("lo"), F.max(chunks).alias("hi"), F.min(chunk).alias("first"), F.max(chunk).alias("last"), F.count_distinct(chunk).alias("distinct"))
    bad = (F.col("_group") == 0) | (F.col("lo") != F.col("hi")) | (F.col("pieces") != F.col("hi")) | (F.col("first") != 0) | (F.col("last") != F.col("pieces") - 1) | (F.col("distinct") != F.col("pieces"))
    return per.where(bad).groupBy(*key).agg(F.min("_group").alias("first_bad"))


def required_missing(present: Column, required: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), present))


def unknown_keys(present: Column, known: list[str]) -> Column:
    return F.array_sort(F.array_except(present, F.array(*map(F.lit, known))))


def listed(problems: DataFrame, key: list[str], text: str, most: int = 10) -> DataFrame:
    """Problems of each key with at most `most` of them listed: a report, ranked before it is gathered."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(text))
    short = problems.withColumn("_rn", rank).where(F.col("_rn") <= most)
    return short.groupBy(*key).agg(F.array_sort(F.collect_list(text)).alias("listed")).join(problems.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)


def reconcile(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Counts of both sides (column n) where they differ, missing as 0."""
    both = expected.select(*key, F.col("n").alias("n_expected")).join(found.select(*key, F.col("n").alias("n_found")), key, "full_outer")
    return both.withColumns({"n_expected": F.coalesce("n_expected", F.lit(0)), "n_found": F.coalesce("n_found", F.lit(0))}).where("n_expected <> n_found")


def overwrite_split(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows with `status` 'overwrite' or 'new'."""
    ids = stored.select(key).distinct().withColumn("_there", F.lit(True))
    return incoming.join(ids, key, "left").withColumn("status", F.when(F.col("_there"), "overwrite").otherwise("new")).drop("_there")


def identity_probe(incoming: DataFrame, stored: DataFrame, key: list[str], slug: str) -> DataFrame:
    """'new', 're-index' (same or unknown slug) or 'collision' (both slugs known and different)."""
    there = stored.select(*key, F.col(slug).alias("_slug"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "new").when(F.col("_slug").isNotNull() & F.col(slug).isNotNull() & (F.col("_slug") != F.col(slug)), "collision").otherwise("re-index")
    return incoming.join(there, key, "left").withColumn("status", status).drop("_slug", "_there")


#: Rows of holders that are broadcast at most; beyond, the incoming codes of each title are dealt to so many parts.
BROADCAST_HOLDERS, DEALT = 1 << 20, 32
#: What an author is met by: the same author, one who is not known by one who is, any by one who is not known.
SAME, UNKNOWN, ANY = range(3)


def _authors(df: DataFrame, sure: list[int], unsure: list[int]) -> DataFrame:
    """Rows (title, code, kind, author, several) by which codes meet, of the kinds `sure` if all authors of a code are known, else
    `unsure`: SAME for each author, other kinds without one.  `several` holds the authors where they are more than one."""
    per = df.groupBy("title", "code").agg(F.collect_set("author").alias("authors"), F.count_if(F.col("author").isNull()).alias("unknown"))
    kinds = F.when(F.col("unknown") == 0, F.array(*map(F.lit, sure))).otherwise(F.array(*map(F.lit, unsure)))
    rows = per.select("title", "code", "authors", F.explode(kinds).alias("kind"))
    said = F.when(F.col("kind") == SAME, F.col("authors")).otherwise(F.array(F.lit(None).cast(df.schema["author"].dataType)))
    return rows.select("title", "code", "kind", F.when(F.size("authors") > 1, F.col("authors")).alias("several"), F.explode(said).alias("author"))


def same_title(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Holders of an incoming title under another code, unless both authors are known and differ: title, code, other_code.

    Points are brought down to one row for each title and code before they meet.  A pair is met by one key only and written where it is
    met: pairs, of which a title that many codes hold has a great many, are neither shuffled nor kept.
    """
    mine = _authors(incoming, [SAME, UNKNOWN], [ANY])
    other = _authors(stored, [SAME, ANY], [UNKNOWN, ANY]).withColumnsRenamed({c: f"other_{c}" for c in ("title", "code", "kind", "several", "author")})
    keys = (F.col("title") == F.col("other_title")) & (F.col("kind") == F.col("other_kind")) & F.col("author").eqNullSafe(F.col("other_author"))
    if other.count() <= BROADCAST_HOLDERS:
        other = F.broadcast(other)
    else:
        mine = mine.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(DEALT)).cast("int"))
        other = other.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        keys = keys & (F.col("part") == F.col("other_part"))
    # Of authors that two codes share the first one counts.
    once = F.coalesce(F.col("author") == F.array_min(F.array_intersect("several", "other_several")), F.lit(True))
    return mine.join(other, keys & (F.col("code") != F.col("other_code")) & ((F.col("kind") != SAME) | once)).select("title", "code", "other_code")


def paired(originals: DataFrame, translations: DataFrame) -> DataFrame:
    """(code, pair) for each translation that names an original, each pair once."""
    named = translations.where("lang <> 'en'").select(F.col("book_pair").alias("code"), F.concat_ws(":", "lang", "code").alias("pair")).distinct()
    return originals.select("code").distinct().join(named, "code")


def cosine_gate(vectors: DataFrame, fixture: DataFrame, cosine: Column, least: float, expected: float | None = None) -> DataFrame:
    """Left join on id: problems 'missing' or 'below' for each fixture entry; 'suspicious' between `least` and `expected`."""
    joined = fixture.join(vectors, "id", "left").withColumn("cosine", F.round(cosine, 6))
    status = F.when(F.col("cosine").isNull(), "missing").when(F.col("cosine") < least, "below")
    if expected is not None:
        status = status.when(F.col("cosine") < expected, "suspicious")
    return joined.withColumn("status", status.otherwise("ok"))


def cosine_summary(compared: DataFrame, cosine: str = "cosine", worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """(least, mean and number of the cosines of a calibration, its `worst` entries by id): null cosines count as missing."""
    facts = compared.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(cosine).isNull()).alias("missing"), F.min(cosine).alias("least"), F.avg(cosine).alias("mean"))
    return facts, compared.where(F.col(cosine).isNotNull()).orderBy(cosine, "id").limit(worst)


def canary_gate(canaries: DataFrame, stored: DataFrame, cosine: Column) -> DataFrame:
    """Canaries of a first-version pack by collection and id: 'missing', 'below' the larger of 0.95 and the cosine that the pack
    expects, or 'ok'."""
    joined = canaries.join(stored, ["collection", "id"], "left").withColumn("cosine", F.round(cosine, 6))
    least = F.greatest(F.lit(0.95), F.coalesce("cosine_expected_min", F.lit(0.0)))
    return joined.withColumn("status", F.when(F.col("cosine").isNull(), "missing").when(F.col("cosine") < least, "below").otherwise("ok"))


def uncovered(fixture: DataFrame, points: DataFrame, profile: str) -> DataFrame:
    """Fixture entries of a profile that the points lack."""
    return fixture.where(F.col("profile") == profile).join(points.select("id"), "id", "left_anti")


def inspected(blocks: DataFrame, book: list[str]) -> DataFrame:
    """For each book its blocks, paragraphs (first pieces), keys that several paragraphs share, and blocks of split paragraphs."""
    keys = blocks.groupBy(*book, "para_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("chunk") == 0).alias("heads"), F.count_if(F.col("chunks") > 1).alias("split"))
    return keys.groupBy(*book).agg(F.sum("n").alias("blocks"), F.sum("heads").alias("paragraphs"), F.count_if(F.col("heads") > 1).alias("collided"), F.sum("split").alias("split"))


def coverage(verses: DataFrame, edition: str, key: str, chunks: str | None = None) -> DataFrame:
    """For each edition its books, chapters and verses, how many of its keys are no verses, how many verses are split, and the canonical
    books that it lacks, in canonical order.  The books of an edition are at most those of the canon, whatever its size."""
    from ..functions import osis

    valid = osis.is_verse(F.col(key))
    book, chapter = F.substring_index(key, ".", 1), F.substring_index(key, ".", 2)
    rows = verses.select(edition, F.col(key).alias("_key"), F.when(valid, book).alias("_book"), F.when(valid, chapter).alias("_chapter"), (F.coalesce(F.col(chunks), F.lit(1)) > 1 if chunks else F.lit(False)).alias("_split"))
    by_chapter = rows.groupBy(edition, "_book", "_chapter").agg(F.count(F.lit(1)).alias("n"), F.count_if("_split").alias("split"))
    facts = by_chapter.groupBy(edition).agg(
        F.collect_set("_book").alias("_books"), F.count("_chapter").alias("chapters"), F.sum(F.when(F.col("_book").isNotNull(), F.col("n")).otherwise(0)).alias("verses"),
        F.sum("split").alias("split"), F.sum(F.when(F.col("_book").isNull(), F.col("n")).otherwise(0)).alias("invalid"),
    )
    missing = F.array_except(F.array(*map(F.lit, osis.BOOKS)), "_books")
    return facts.select(edition, F.size("_books").alias("books"), "chapters", "verses", "split", "invalid", missing.alias("missing"))


def described(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Books of an index with the number of their translations and the first of them."""
    named = pairs.groupBy(F.col("code").alias("book_code")).agg(F.count(F.lit(1)).alias("translations"), F.min("pair").alias("first_translation"))
    return index.join(named, "book_code", "left").withColumn("translations", F.coalesce("translations", F.lit(0)))


def after_import(books: DataFrame, points: DataFrame, sample: int = 3, required: tuple[str, ...] = ("title", "author", "corpus"), near: int = 1) -> DataFrame:
    """What is wrong with books that were imported: (lang, book_code, problem, detail).

    'count': the table has another number of points than the manifest (detail: expected and found); 'metadata': a required field that
    the book's first point lacks; 'unreachable': a stored point that a search with its own vector, among the points of its language
    and book, does not find among the `near` first, where a point that is exactly as near counts as itself (detail: the id).  Of each
    book the `sample` smallest ids are searched for, so queries grow with the books and not with their points.

    books: lang, book_code, n; points: id, lang, book_code, vector and the required fields.
    """
    from .search import cosine_topk

    key = ["lang", "book_code"]
    asked = books.select(*key, F.col("n").alias("want"))
    facts = points.groupBy(*key).agg(F.count(F.lit(1)).alias("got"), F.min_by(F.struct(*required), "id").alias("m"))
    both = asked.join(facts, key, "left").withColumn("got", F.coalesce("got", F.lit(0)))
    counts = both.where("got <> want").select(*key, F.lit("count").alias("problem"), F.concat_ws(" ", F.col("want").cast("string"), F.col("got").cast("string")).alias("detail"))
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f"m.{c}").cast("string")), F.lit("")) == "", c) for c in required]))
    gaps = both.where("got > 0").select(*key, F.lit("metadata").alias("problem"), F.explode(lacking).alias("detail"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    mine = points.join(F.broadcast(asked.select(*key)), key, "left_semi").withColumn("_rn", rank).where(F.col("_rn") <= sample).select("id", "vector", *key)
    # The search leaves out the query's own id, so the sample asks under names of its own.
    queries = mine.select(F.concat(F.lit("?"), F.col("id").cast("string")).alias("query_id"), F.coalesce("vector", F.array().cast("array<float>")).alias("vector"), *key, F.col("id").alias("own"))
    whole = queries.where("size(vector) > 0")
    there = points.select(F.col("id").cast("string").alias("id"), "vector", *key).where("size(vector) > 0")
    hits = cosine_topk(there, whole.select("query_id", "vector", *key), near, None, tuple(key))
    self_score = F.when(F.expr("exists(vector, x -> x <> 0)"), 1.0)
    best = hits.groupBy("query_id").agg(F.max(F.struct("score", "id")).alias("b"), F.collect_set("id").alias("ids"))
    judged = queries.join(best, "query_id", "left").withColumn("self", self_score)
    found = F.coalesce(F.array_contains("ids", F.col("own").cast("string")) & F.col("self").isNotNull(), F.lit(False)) | F.coalesce(F.col("b.score") >= F.col("self"), F.lit(False))
    lost = judged.where(~found).select(*key, F.lit("unreachable").alias("problem"), F.col("own").cast("string").alias("detail"))
    return counts.unionByName(gaps).unionByName(lost)


# ---- one table of violations: rule, subject, detail

VIOLATION = ("rule", "subject", "detail")


def violation(df: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def metadata_violations(books: DataFrame, required: tuple[str, ...] = ("title", "author", "corpus")) -> DataFrame:
    """Books of a manifest that lack a field, translations without an original, and originals with a slash in their name."""
    book = F.concat_ws(":", "lang", "book_code")
    gaps = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in required]), lambda x: x.isNotNull())
    missing = books.select("*", F.explode(gaps).alias("field"))
    alone = books.where((F.col("lang") != "en") & (F.coalesce("book_pair", F.lit("")) == ""))
    slash = books.where(F.col("book_pair").contains("/"))
    return (
        violation(missing, "metadata", book, F.col("field"))
        .unionByName(violation(alone, "no original", book, F.lit("")))
        .unionByName(violation(slash, "pair code", book, F.col("book_pair")))
    )


def import_violations(books: DataFrame, stored: DataFrame, incoming_ids: DataFrame, stored_ids: DataFrame, overwrite: bool = False) -> DataFrame:
    """What refuses an import, as one table: incomplete metadata, another work under a known code, a title held by another code,
    and, unless `overwrite`, points that would be overwritten (one row for each book with their number).

    books, stored: lang, book_code, book_pair, title, author, corpus, slug; incoming_ids: lang, book_code, id; stored_ids: id.
    """
    book = F.concat_ws(":", "lang", "book_code")
    clash = identity_probe(books, stored.select("lang", "book_code", "slug").distinct(), ["lang", "book_code"], "slug").where("status = 'collision'")
    of = lambda df: df.select(F.concat_ws("|", "lang", "title").alias("title"), F.col("book_code").alias("code"), "author").where("title is not null")
    twins = same_title(of(books), of(stored))
    made = metadata_violations(books).unionByName(violation(clash, "collision", book, F.col("slug"))).unionByName(violation(twins, "same title", F.col("code"), F.col("other_code")))
    if overwrite:
        return made
    there = incoming_ids.join(stored_ids.select("id").distinct(), "id", "left_semi").groupBy("lang", "book_code").agg(F.count(F.lit(1)).alias("n"))
    return made.unionByName(violation(there, "overwrite", book, F.col("n")))


def delete_violations(asked: DataFrame, points: DataFrame) -> DataFrame:
    """What refuses a deletion: books without points, another number of points than was stated, originals that translations
    still name.  asked: lang, book_code, n (the number expected, or null); points: lang, book_code, book_pair."""
    book = F.concat_ws(":", "lang", "book_code")
    counts = points.groupBy("lang", "book_code").agg(F.count(F.lit(1)).alias("found"))
    both = asked.dropDuplicates(["lang", "book_code"]).join(counts, ["lang", "book_code"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    named = points.where("lang <> 'en' and book_pair is not null").select(F.col("lang").alias("t_lang"), F.col("book_code").alias("t_code"), F.col("book_pair").alias("book_code")).distinct()
    # A translation that goes, too, names nothing any more.
    kept = named.join(asked.select(F.col("lang").alias("t_lang"), F.col("book_code").alias("t_code")), ["t_lang", "t_code"], "left_anti")
    held = asked.where("lang = 'en'").join(kept, "book_code")
    return (
        violation(both.where("found = 0"), "no points", book, F.lit(""))
        .unionByName(violation(both.where("found > 0 and found <> n"), "count", book, F.col("found")))
        .unionByName(violation(held, "paired", book, F.concat_ws(":", "t_lang", "t_code")))
    )


def left_over(asked: DataFrame, points: DataFrame) -> DataFrame:
    """Books that still have points after their deletion, with the number: none, if all went well."""
    return points.join(asked.select("lang", "book_code").distinct(), ["lang", "book_code"], "left_semi").groupBy("lang", "book_code").agg(F.count(F.lit(1)).alias("n"))


def book_violations(blocks: DataFrame, book: list[str]) -> DataFrame:
    """One report on the blocks of books (book, para_key, page, seq, chunk, chunks, text): empty texts, sequence numbers that occur
    twice or are not dense, and pieces that do not make whole paragraphs."""
    name = F.concat_ws(":", *book)
    empty = blocks.where(F.coalesce(F.trim("text"), F.lit("")) == "")
    twice = duplicates(blocks, [*book, "para_key", "seq"])
    gaps = density(blocks, [*book, "para_key"], "seq")
    parts = partition_violations(blocks, [*book, "para_key"], "seq", "chunk", "chunks")
    return (
        violation(empty, "empty text", name, F.col("para_key"))
        .unionByName(violation(twice, "duplicate", name, F.concat_ws("#", "para_key", F.col("seq").cast("string"))))
        .unionByName(violation(gaps, "density", name, F.col("para_key")))
        .unionByName(violation(parts, "partition", name, F.col("para_key")))
    )


def bible_violations(verses: DataFrame, edition: str, key: str) -> DataFrame:
    """Rules of an edition: a proper name, strict verse keys, no key twice, no page, author or split of its own."""
    from ..functions import osis

    name = F.col(edition)
    extra = F.filter(F.array(*[F.when(F.col(c).isNotNull(), c) for c in ("page", "para", "author", "title", "book_pair") if c in verses.columns]), lambda x: x.isNotNull())
    made = violation(verses.select(edition).distinct().where(~osis.is_edition(name)), "edition", name, F.lit(""))
    made = made.unionByName(violation(verses.where(~osis.is_verse(F.col(key))), "key", name, F.col(key)))
    made = made.unionByName(violation(duplicates(verses, [edition, key]), "duplicate", name, F.col(key)))
    made = made.unionByName(violation(verses.select(edition, key, F.explode(extra).alias("field")), "forbidden", name, F.concat_ws(" ", key, "field")))
    if "chunks" in verses.columns:
        made = made.unionByName(violation(verses.where("chunks > 1"), "split", name, F.col(key)))
    return made


def agreement(books: DataFrame, columns: tuple[str, ...] = ("profile", "id_rule")) -> DataFrame:
    """Columns in which the books of one pack do not agree, with the number of different values."""
    facts = books.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns])
    return facts.select(F.inline(rows)).where("values > 1")
