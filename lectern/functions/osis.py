"""Scripture references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The canonical books, in canonical order; the pattern of a reference; the verses of the longest chapter.
BOOKS = (
    "Gen Exod Lev Num Deut Josh Judg Ruth 1Sam 2Sam 1Kgs 2Kgs 1Chr 2Chr Ezra Neh Esth Job Ps Prov Eccl Song Isa Jer "
    "Lam Ezek Dan Hos Joel Amos Obad Jonah Mic Nah Hab Zeph Hag Zech Mal Matt Mark Luke John Acts Rom 1Cor 2Cor Gal "
    "Eph Phil Col 1Thess 2Thess 1Tim 2Tim Titus Phlm Heb Jas 1Pet 2Pet 1John 2John 3John Jude Rev"
).split()
REFERENCE = "^([1-4]?[A-Za-z]+)\\.(\\d+)(?:\\.(\\d+))?$"
#: No chapter has more verses; open chapters expand to as many keys.
LONGEST_CHAPTER = 176
#: Keys that one lookup may ask for.
MAX_KEYS = 2000


def is_verse(key: Column) -> Column:
    """A strict verse key: known book, no leading zeros, an optional grain."""
    return key.rlike(f"^({'|'.join(BOOKS)})\\.[1-9]\\d*\\.[1-9]\\d*(![a-z]+)?$")


def is_edition(name: Column) -> Column:
    return name.rlike("^[a-z0-9][a-z0-9_-]*$")


def book_number(book: Column) -> Column:
    """Place in the canon from 1; 0 for an unknown book."""
    return F.array_position(F.array(*map(F.lit, BOOKS)), book)


def canonical_order(key: Column) -> Column:
    """What canonical sorting compares: book, chapter, verse, grain."""
    base, grain = F.split(key, "!")[0], F.coalesce(F.get(F.split(key, "!"), F.lit(1)), F.lit(""))
    part = F.split(base, "\\.")
    return F.struct(book_number(part[0]).alias("book"), part[1].try_cast("long").alias("chapter"), part[2].try_cast("long").alias("verse"), grain.alias("grain"))


def split_refs(refs: Column) -> Column:
    return F.filter(F.transform(F.split(refs, "[;,]"), lambda r: F.trim(r)), lambda r: r != "")


def bounded_refs(refs: DataFrame) -> DataFrame:
    """Add _book, _c1, _v1, _c2, _v2 (the first and last chapter and, where named, verse) to a table with a column `ref`.

    A reference that is none, or a range over two books, is an error.
    """
    start, end = F.substring_index("ref", "-", 1), F.when(F.col("ref").contains("-"), F.expr("substring(ref, instr(ref, '-') + 1)")).otherwise("")
    whole = end.rlike(REFERENCE)
    number = end.rlike("^\\d+$")
    refs = refs.withColumns(
        {
            "_book": F.regexp_extract(start, REFERENCE, 1),
            "_c1": F.regexp_extract(start, REFERENCE, 2).try_cast("int"),
            "_v1": F.regexp_extract(start, REFERENCE, 3).try_cast("int"),
            "_end": end,
            "_bad": ~start.rlike(REFERENCE) | ((end != "") & ~number & (~whole | (F.regexp_extract(end, REFERENCE, 1) != F.regexp_extract(start, REFERENCE, 1)))),
        }
    )
    n = F.when(number, end.try_cast("int"))
    c2 = F.when(F.col("_end") == "", F.col("_c1")).when(number, F.when(F.col("_v1").isNotNull(), F.col("_c1")).otherwise(n)).otherwise(F.regexp_extract(end, REFERENCE, 2).try_cast("int"))
    v2 = F.when(F.col("_end") == "", F.col("_v1")).when(number, F.when(F.col("_v1").isNotNull(), n)).otherwise(F.regexp_extract(end, REFERENCE, 3).try_cast("int"))
    refs = refs.withColumn("_c2", F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("not a reference: "), F.col("ref"))).cast("int")).otherwise(c2)).withColumn("_v2", v2)
    return refs.drop("_end", "_bad")


def key_of(book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat_ws(".", book, chapter.cast("string"), verse.cast("string"))


def ref_bounds(refs: DataFrame) -> DataFrame:
    """Add keys (how many keys a reference stands for), first_key and last_key, without making the keys; 0 and null for none."""
    refs = bounded_refs(refs)
    lo, hi = F.coalesce("_v1", F.lit(1)), F.coalesce("_v2", F.lit(LONGEST_CHAPTER))
    one = F.col("_c1") == F.col("_c2")
    long = lambda x: x.cast("long")
    # The first chapter may begin, and the last one end, beyond its bound: then it has no keys.
    head, tail = F.greatest(LONGEST_CHAPTER - long(lo) + 1, F.lit(0)), F.greatest(long(hi), F.lit(0))
    between = (long(F.col("_c2")) - long(F.col("_c1")) - 1) * LONGEST_CHAPTER
    keys = F.when(F.col("_c2") < F.col("_c1"), F.lit(0)).when(one, F.greatest(long(hi) - long(lo) + 1, F.lit(0))).otherwise(head + between + tail)
    refs = refs.withColumns({"keys": keys.cast("long"), "_lo": lo, "_hi": hi})
    after = ~one & (F.col("_lo") > LONGEST_CHAPTER)  # the first chapter has none
    before = ~one & (F.col("_hi") < 1)
    first = F.when(after, key_of(F.col("_book"), F.col("_c1") + 1, F.lit(1))).otherwise(key_of(F.col("_book"), F.col("_c1"), F.col("_lo")))
    last = F.when(before, key_of(F.col("_book"), F.col("_c2") - 1, F.lit(LONGEST_CHAPTER))).otherwise(key_of(F.col("_book"), F.col("_c2"), F.col("_hi")))
    shown = [c for c in refs.columns if not c.startswith("_")]
    return refs.withColumns({"first_key": F.when(F.col("keys") > 0, first), "last_key": F.when(F.col("keys") > 0, last)}).select(*shown, "first_key", "last_key")


def expand_refs(refs: DataFrame) -> DataFrame:
    """Add (key_pos, key) rows to a table with a column `ref`: a verse, a range, chapters or a range across chapters.

    A reversed range expands to nothing; keys past a chapter's end match nothing later; see bounded_refs() for errors.
    """
    refs = bounded_refs(refs)
    chapters = F.when(F.col("_c2") >= F.col("_c1"), F.sequence("_c1", "_c2"))
    refs = refs.withColumn("_ch", F.explode(chapters))
    lo = F.when((F.col("_ch") == F.col("_c1")) & F.col("_v1").isNotNull(), F.col("_v1")).otherwise(1)
    hi = F.when((F.col("_ch") == F.col("_c2")) & F.col("_v2").isNotNull(), F.col("_v2")).otherwise(LONGEST_CHAPTER)
    refs = refs.withColumn("_verse", F.explode(F.when(hi >= lo, F.sequence(lo, hi))))
    key = key_of(F.col("_book"), F.col("_ch"), F.col("_verse"))
    pos = F.struct(F.col("_ch").alias("chapter"), F.col("_verse").alias("verse")).alias("key_pos")
    return refs.select(*[c for c in refs.columns if not c.startswith("_")], pos, key.alias("key"))
