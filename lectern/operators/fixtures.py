"""The plan of a calibration fixture: slots as data, filled first come, first served."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewer entries than this are no fixture.
LEAST = 8


@dataclass(frozen=True)
class Slot:
    """What one kind of entry must be: `take` rows that match `where`, or, for each of the first `most` values of `each`, so many."""

    note: str
    where: Column
    take: int = 1
    each: Column | None = None
    most: int = 1


def usual_slots(tokens: Column, limit: int = 512) -> list[Slot]:
    """The sixteen entries of the usual plan (numbers are fixed values): the main corpus in two languages and four others, two pioneers,
    five editions and one text over the token limit."""
    corpus, lang, profile = F.col("corpus"), F.col("lang"), F.col("profile")
    main = (profile == "sop") & (corpus == "egw")
    pioneer = (profile == "sop") & (corpus == "pioneers") & (lang == "en")
    return [
        Slot("main en", main & (lang == "en"), 2),
        Slot("main de", main & (lang == "de"), 2),
        Slot("main, other languages", main & ~lang.isin("en", "de"), 1, lang, 4),
        Slot("pioneer", pioneer, 2),
        Slot("edition", profile == "bible", 1, F.col("bible"), 5),
        Slot("pioneer, long", pioneer & (tokens > limit), 1),
    ]


def fixture_plan(points: DataFrame, slots: list[Slot], id_: str = "id", least: int = LEAST) -> DataFrame:
    """(slot, part, note, id) of the rows that fill the slots, each row once.

    A row may fit several slots: slots are served in their order, and each takes the smallest ids that no slot before it took.  The points
    are scanned once; of each slot only as many rows as it could ever need, its own and those that the slots before may take away,
    pass the shuffle, so what is gathered for the assignment is bounded by the plan.  Fewer than `least` entries fail the job; rows
    with a null id and repeated ids count once or not at all.
    """
    fits = []
    before = 0
    for number, s in enumerate(slots):
        parts = s.most if s.each is not None else 1
        need = s.take + before + (parts - 1) * s.take
        part = s.each.cast("string") if s.each is not None else F.lit("")
        fits.append(F.when(s.where & part.isNotNull(), F.struct(F.lit(number).alias("slot"), part.alias("part"), F.lit(s.take).alias("take"), F.lit(parts).alias("most"), F.lit(need).alias("need"))))
        before += parts * s.take
    rows = points.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.explode(F.array_compact(F.array(*fits))).alias("f")).select("id", "f.*")
    # Values of `each` in their order; the smallest need is enough to see which they are.
    named = rows.groupBy("slot", "part", "most").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy("part"))).where(F.col("rank") <= F.col("most"))
    place = F.row_number().over(Window.partitionBy("slot", "part").orderBy("id"))
    reach = max([s.take * (s.most if s.each is not None else 1) for s in slots], default=0) + before
    near = rows.dropDuplicates(["slot", "part", "id"]).withColumn("place", place).where((F.col("place") <= F.lit(reach)) & (F.col("place") <= F.col("need")))
    near = near.join(F.broadcast(named.select("slot", "part", "rank")), ["slot", "part"])
    gathered = near.agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "id", "part", "take"))).alias("rows"))
    kind = points.schema[id_].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("taken"), F.array().cast("array<string>").alias("filled"), F.array().cast(f"array<struct<slot:int,part:string,id:{kind}>>").alias("chosen"))

    def serve(state: Column, row: Column) -> Column:
        key = F.concat_ws("/", row["slot"].cast("string"), row["part"])
        free = (F.size(F.filter(state["filled"], lambda k: k == key)) < row["take"]) & ~F.array_contains(state["taken"], row["id"])
        more = F.struct(
            F.concat(state["taken"], F.array(row["id"])).alias("taken"), F.concat(state["filled"], F.array(key)).alias("filled"),
            F.concat(state["chosen"], F.array(F.struct(row["slot"].alias("slot"), row["part"].alias("part"), row["id"].alias("id")))).alias("chosen"),
        )
        return F.when(free, more).otherwise(state)

    chosen = gathered.select(F.aggregate("rows", start, serve, lambda s: s["chosen"]).alias("chosen"))
    enough = F.when(F.size("chosen") >= least, F.col("chosen")).otherwise(F.raise_error(F.concat(F.lit(f"a fixture needs {least} entries, found "), F.size("chosen").cast("string"))).cast(chosen.schema["chosen"].dataType))
    note = F.element_at(F.array(*[F.lit(s.note) for s in slots]), F.col("slot") + 1)
    return chosen.select(F.inline(enough)).select("slot", "part", note.alias("note"), "id")
