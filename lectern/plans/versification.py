"""Verse numbering of editions that differ from the usual English one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST = 200  # beyond any chapter's last verse
# Book, chapter, first and last verse, chapter in the edition, shift of the verse number.
HEBREW = (
    ("Gen", 31, 55, 55, 32, -54),
    ("Gen", 32, 1, 32, 32, 1),
    ("Exod", 8, 1, 4, 7, 25),
    ("Exod", 8, 5, 32, 8, -4),
    ("Exod", 22, 1, 1, 21, 36),
    ("Exod", 22, 2, 31, 22, -1),
    ("Lev", 6, 1, 7, 5, 19),
    ("Lev", 6, 8, 30, 6, -7),
    ("Num", 16, 36, 50, 17, -35),
    ("Num", 17, 1, 13, 17, 15),
    ("Num", 29, 40, 40, 30, -39),
    ("Num", 30, 1, 16, 30, 1),
    ("Deut", 12, 32, 32, 13, -31),
    ("Deut", 13, 1, 18, 13, 1),
    ("Deut", 22, 30, 30, 23, -29),
    ("Deut", 23, 1, 25, 23, 1),
    ("Deut", 29, 1, 1, 28, 68),
    ("Deut", 29, 2, 29, 29, -1),
    ("1Sam", 21, 1, 15, 21, 1),
    ("1Sam", 23, 29, 29, 24, -28),
    ("1Sam", 24, 1, 22, 24, 1),
    ("2Sam", 18, 33, 33, 19, -32),
    ("2Sam", 19, 1, 43, 19, 1),
    ("1Kgs", 4, 21, 34, 5, -20),
    ("1Kgs", 5, 1, 18, 5, 14),
    ("1Kgs", 22, 44, 60, 22, 1),
    ("2Kgs", 11, 21, 21, 12, -20),
    ("2Kgs", 12, 1, 21, 12, 1),
    ("1Chr", 6, 1, 15, 5, 26),
    ("1Chr", 6, 16, 81, 6, -15),
    ("2Chr", 2, 1, 1, 1, 17),
    ("2Chr", 2, 2, 18, 2, -1),
    ("2Chr", 14, 1, 1, 13, 22),
    ("2Chr", 14, 2, 15, 14, -1),
    ("Neh", 4, 1, 6, 3, 32),
    ("Neh", 4, 7, 23, 4, -6),
    ("Neh", 9, 38, 38, 10, -37),
    ("Neh", 10, 1, 39, 10, 1),
    ("Job", 41, 1, 8, 40, 24),
    ("Job", 41, 9, 34, 41, -8),
    ("Eccl", 5, 1, 1, 4, 16),
    ("Eccl", 5, 2, 20, 5, -1),
    ("Song", 6, 13, 13, 7, -12),
    ("Song", 7, 1, 13, 7, 1),
    ("Isa", 9, 1, 1, 8, 22),
    ("Isa", 9, 2, 21, 9, -1),
    ("Isa", 64, 1, 1, 63, 18),
    ("Isa", 64, 2, 12, 64, -1),
    ("Jer", 9, 1, 1, 8, 22),
    ("Jer", 9, 2, 26, 9, -1),
    ("Ezek", 20, 45, 49, 21, -44),
    ("Ezek", 21, 1, 32, 21, 5),
    ("Hos", 1, 10, 11, 2, -9),
    ("Hos", 2, 1, 23, 2, 2),
    ("Hos", 11, 12, 12, 12, -11),
    ("Hos", 12, 1, 14, 12, 1),
    ("Hos", 13, 16, 16, 14, -15),
    ("Hos", 14, 1, 9, 14, 1),
    ("Joel", 2, 28, 32, 3, -27),
    ("Joel", 3, 1, 21, 4, 0),
    ("Jonah", 1, 17, 17, 2, -16),
    ("Jonah", 2, 1, 10, 2, 1),
    ("Mic", 5, 1, 1, 4, 13),
    ("Mic", 5, 2, 15, 5, -1),
    ("Nah", 1, 15, 15, 2, -14),
    ("Nah", 2, 1, 13, 2, 1),
    ("Zech", 1, 18, 21, 2, -17),
    ("Zech", 2, 1, 13, 2, 4),
    ("Mal", 4, 1, 6, 3, 18),
    ("Dan", 4, 1, 3, 3, 30),
    ("Dan", 4, 4, 37, 4, -3),
    ("Dan", 5, 31, 31, 6, -30),
    ("Dan", 6, 1, 28, 6, 1),
    ("Acts", 19, 41, 41, 19, -1),
    ("2Cor", 13, 13, 14, 13, -1),
)
# Psalms whose superscription counts as one verse, or as two.
ONE_VERSE = (
    3, 4, 5, 6, 7, 8, 9, 12, 13, 18, 19, 20, 21, 22, 30, 31, 34, 36, 38, 39, 40, 41, 42, 44, 45, 46, 47, 48, 49, 53,
    55, 56, 57, 58, 59, 61, 62, 63, 64, 65, 67, 68, 69, 70, 75, 76, 77, 80, 81, 83, 84, 85, 88, 89, 92, 102, 108,
    140, 142,
)
TWO_VERSES = (51, 52, 54, 60)
# First and last psalm, first and last verse, shift of the psalm's number, shift of the verse number.
GREEK_PSALMS = (
    (1, 9, 1, LAST, 0, 0),
    (10, 10, 1, LAST, -1, 21),
    (11, 113, 1, LAST, -1, 0),
    (114, 114, 1, LAST, -1, 0),
    (115, 115, 1, LAST, -2, 8),
    (116, 116, 1, 9, -2, 0),
    (116, 116, 10, LAST, -1, -9),
    (117, 146, 1, LAST, -1, 0),
    (147, 147, 1, 11, -1, 0),
    (147, 147, 12, LAST, 0, -11),
    (148, 150, 1, LAST, 0, 0),
)
# The books in which the Septuagint-numbered edition follows the Hebrew division.
SHARED_BOOKS = ("1Sam", "2Cor", "Acts", "Eccl", "Job", "Jonah", "Song")

RULES = "target string, book string, kjv_ch int, v_lo int, v_hi int, tgt_ch int, delta int, rule_ord int"


def rules() -> list[tuple]:
    """All rules as rows of RULES; of the rules that fit a verse the one with the smallest rule_ord holds."""
    heading = {n: 1 for n in ONE_VERSE} | {n: 2 for n in TWO_VERSES}
    psalms = [("Ps", n, 1, LAST, n, shift) for n, shift in heading.items()]
    greek = [("Ps", n, lo, hi, n + to, shift + heading.get(n, 0)) for first, last, lo, hi, to, shift in GREEK_PSALMS for n in range(first, last + 1)]
    editions = {
        "luther1912": [*psalms, *HEBREW],
        "ukrogienko": [*psalms, *(r for r in HEBREW if r[0] != "Mal")],
        "synodal": [*(r for r in HEBREW if r[0] in SHARED_BOOKS), *greek, ("Rom", 16, 25, 27, 14, -1)],
    }
    return [(target, *rule, i) for target, own in editions.items() for i, rule in enumerate(own)]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), RULES)


def remap(verses: DataFrame, table: DataFrame) -> DataFrame:
    """Add ed_chapter and ed_verse to (target, book, chapter, verse, ...): the first fitting rule, else the same numbers.

    The rules are a table of a few hundred rows, so they are broadcast; each verse meets only the rules of its chapter.
    """
    grouped = table.groupBy("target", "book", "kjv_ch").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "v_lo", "v_hi", "tgt_ch", "delta"))).alias("_rules"))
    joined = verses.join(F.broadcast(grouped.withColumnRenamed("kjv_ch", "chapter")), ["target", "book", "chapter"], "left")
    rule = F.get(F.filter("_rules", lambda r: F.col("verse").between(r["v_lo"], r["v_hi"])), F.lit(0))
    joined = joined.withColumn("_rule", rule)
    return joined.withColumns({"ed_chapter": F.coalesce("_rule.tgt_ch", "chapter"), "ed_verse": F.coalesce(F.col("verse") + F.col("_rule.delta"), "verse")}).drop("_rules", "_rule")


def back_to_kjv(remapped: DataFrame) -> DataFrame:
    """(target, book, ed_chapter, ed_verse) -> the requested key; where several meet, the last requested holds.

    Numbering is not injective, so an earlier key may lose its way back.  Needs key_pos for the order of requests.
    """
    return remapped.groupBy("target", "book", "ed_chapter", "ed_verse").agg(F.max_by(F.struct("chapter", "verse"), "key_pos").alias("kjv")).select("target", "book", "ed_chapter", "ed_verse", F.col("kjv.chapter").alias("chapter"), F.col("kjv.verse").alias("verse"))


def suffix_parts(part: Column) -> tuple[Column, Column]:
    """'Isa.46.9a' or 'Isa.46.9.a' as (verse key, suffix)."""
    pattern = "^([^.]+\\.[^.]+\\.\\d+)(\\.?[A-Za-z]+)$"
    return F.when(part.rlike(pattern), F.regexp_extract(part, pattern, 1)).otherwise(part), F.regexp_extract(part, pattern, 2)


def remap_refs(refs: DataFrame, table: DataFrame) -> DataFrame:
    """Add `remapped` and `moved` to (target, ref): each side of a range is remapped, and keeps its letters; a reference that
    no rule touches stays exactly as it is."""
    sides = refs.withColumn("_id", F.monotonically_increasing_id()).select("*", F.posexplode(F.split("ref", "-", 2)).alias("_side", "_part"))
    core, suffix = suffix_parts(F.col("_part"))
    number = lambda i: F.regexp_extract(core, "^([^.]+)\\.(\\d+)\\.(\\d+)$", i)
    sides = sides.withColumns({"book": number(1), "chapter": number(2).try_cast("int"), "verse": number(3).try_cast("int"), "_suffix": suffix})
    out = remap(sides, table)
    moved = F.coalesce((F.col("ed_chapter") != F.col("chapter")) | (F.col("ed_verse") != F.col("verse")), F.lit(False))
    piece = F.when(moved, F.concat(F.col("book"), F.lit("."), F.col("ed_chapter").cast("string"), F.lit("."), F.col("ed_verse").cast("string"), F.col("_suffix"))).otherwise(F.col("_part"))
    joined = out.groupBy("_id", *refs.columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_side", piece.alias("p")))), lambda x: x["p"]), "-").alias("remapped"))
    return joined.withColumn("moved", F.col("remapped") != F.col("ref")).drop("_id")
