"""All rules on the blocks of books in one pass.

Blocks are dealt out once, by book and paragraph key, and sorted there; every rule reads running values of that order (the sequence number
before, the pieces of the paragraph so far) or totals of the key, so further rules cost columns, not scans.  A
hot book is no hot key, as its paragraphs are dealt apart.  Only what is wrong goes on to the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fields that every book must have, those that works of another corpus than DEFAULT_CORPUS must have, and the id rules of each profile (fixed values).
REQUIRED = ("book_code", "lang", "title")
REQUIRED_OTHERS = ("author", "year")
DEFAULT_CORPUS = "egw"
ID_RULES = {"sop": ("sop/plain", "sop/seq"), "bible": ("bible/v1",)}
#: Of each book and rule so many violations are named in a report.
LISTED = 10


def _said(column: Column) -> Column:
    return F.coalesce(T.stripped(column.cast("string")), F.lit("")) != ""


def _fields(columns: list[str], profile: Column) -> Column:
    """Names of the required fields that are null or blank, or no columns at all."""
    there = lambda c: _said(F.col(c)) if c in columns else F.lit(False)
    corpus = F.coalesce(F.nullif(F.col("corpus"), F.lit("")), F.lit(DEFAULT_CORPUS)) if "corpus" in columns else F.lit(DEFAULT_CORPUS)
    other = (profile != "bible") & (corpus != DEFAULT_CORPUS)
    return F.array_compact(F.array(*[F.when(~there(c), c) for c in REQUIRED], *[F.when(other & ~there(c), c) for c in REQUIRED_OTHERS]))


def violations(blocks: DataFrame, book: list[str], contract: str | None = None) -> DataFrame:
    """(book columns, rule, detail) for everything wrong with the blocks of books, in one scan and one shuffle.

    blocks: the book columns, para_key, seq, chunk, chunks and text, and on each block the fields of its book (title, lang, author, year,
    corpus, profile, id_rule, target_profile, target_contract) as far as there are.  Rules, with what `detail` names:
    'empty text' and 'duplicate' (para_key#seq), 'density' (para_key whose numbers are not 0 .. n - 1), 'partition' (para_key whose
    pieces are not whole paragraphs, each numbered 0 .. chunks - 1), 'metadata' (the field), 'id rule' (one that the profile
    does not know), 'target' (another profile or, if `contract` is given, contract than the book's).  What is wrong with a book
    as a whole comes once for each of its keys; report() names it once.  Null keys are keys of their own, a null seq or chunk breaks its rules.
    """
    columns = blocks.columns
    key = [*book, "para_key"]
    profile = F.coalesce(F.col("profile"), F.lit("sop")) if "profile" in columns else F.lit("sop")
    whole = []
    if "id_rule" in columns:
        allowed = F.coalesce(*[F.when(profile == p, F.array(*map(F.lit, rules))) for p, rules in ID_RULES.items()], F.array().cast("array<string>"))
        whole.append(F.when(~F.coalesce(F.array_contains(allowed, F.col("id_rule")), F.lit(False)), F.struct(F.lit("id rule").alias("rule"), F.coalesce("id_rule", F.lit("none")).alias("detail"))))
    targets = [("target_profile", profile)] + ([("target_contract", F.lit(contract))] if contract else [])
    whole += [F.when(~F.col(c).eqNullSafe(want), F.struct(F.lit("target").alias("rule"), F.lit(c.removeprefix("target_")).alias("detail"))) for c, want in targets if c in columns]
    gaps = F.transform(_fields(columns, profile), lambda f: F.struct(F.lit("metadata").alias("rule"), f.alias("detail")))
    of_book = F.concat(gaps, F.array_compact(F.array(*whole))) if whole else gaps
    # What the windows carry: the text itself and the fields of the book end here.
    rows = blocks.select(*key, "seq", "chunk", "chunks", (~_said(F.col("text"))).alias("blank"), of_book.alias("of_book"))
    order, all_, last = Window.partitionBy(*key).orderBy("seq"), Window.partitionBy(*key), F.col("chunk") == 0
    rows = rows.withColumns({"before": F.lag("seq").over(order), "rn": F.row_number().over(order), "part": F.sum(F.when(last, 1).otherwise(0)).over(order)})
    rows = rows.withColumn("again", (F.col("rn") > 1) & F.col("seq").eqNullSafe(F.col("before")))
    piece, of_part = Window.partitionBy(*key, "part").orderBy("chunk"), Window.partitionBy(*key, "part")
    rows = rows.withColumns({"nth": F.dense_rank().over(piece)})
    n, of = F.count(F.lit(1)).over(of_part), lambda f, c: f(c).over(of_part)
    bad = (F.col("part") == 0) | (of(F.min, "chunks") != of(F.max, "chunks")) | (n != of(F.max, "chunks")) | (of(F.min, "chunk") != 0) | (of(F.max, "chunk") != n - 1) | (of(F.max, "nth") != n)
    rows = rows.withColumn("bad", F.coalesce(bad, F.lit(True)))
    total = F.count(F.lit(1)).over(all_)
    sparse = (F.min("seq").over(all_) != 0) | (F.max("seq").over(all_) != total - 1) | (F.count("seq").over(all_) != total) | F.max("again").over(all_)
    # A number that stands three times is one duplicate: its second place tells.
    rows = rows.withColumns({"sparse": F.coalesce(sparse, F.lit(True)), "uneven": F.max("bad").over(all_), "second": F.col("again") & ~F.coalesce(F.lag("again").over(Window.partitionBy(*key).orderBy("rn")), F.lit(False))})
    place = F.concat_ws("#", F.col("para_key").cast("string"), F.col("seq").cast("string"))
    once = F.col("rn") == 1
    tell = lambda when, rule, detail: F.when(when, F.struct(F.lit(rule).alias("rule"), F.coalesce(detail, F.lit("none")).alias("detail")))
    name = F.col("para_key").cast("string")
    own = F.array_compact(F.array(tell(F.col("blank"), "empty text", place), tell(F.col("second"), "duplicate", place), tell(once & F.col("sparse"), "density", name), tell(once & F.col("uneven"), "partition", name)))
    return rows.select(*book, F.explode(F.concat(own, F.when(once, F.col("of_book")).otherwise(F.slice("of_book", 1, 0)))).alias("v")).select(*book, "v.rule", "v.detail")


def report(found: DataFrame, book: list[str], most: int = LISTED) -> DataFrame:
    """For each book and rule how many different violations there are, and the first `most` of them by name.

    Equal ones are combined before the shuffle; only what is wrong with the books is looked at.
    """
    each = found.groupBy(*book, "rule", "detail").agg(F.count(F.lit(1)).alias("times"))
    group = Window.partitionBy(*book, "rule")
    ranked = each.withColumns({"rn": F.row_number().over(group.orderBy("detail")), "n": F.count(F.lit(1)).over(group)}).where(F.col("rn") <= most)
    return ranked.groupBy(*book, "rule").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("detail")).alias("listed"))
