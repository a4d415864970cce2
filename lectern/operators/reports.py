"""Small tables as reports: Markdown lines, JSON text, and files of either."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A report is read by people: so many rows at most make one.
MOST = 10_000


def markdown(title: str, facts: DataFrame, order: list[str]) -> DataFrame:
    """(line, text): a heading and a table with a row for each fact, nulls empty and bars escaped, in the given order."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in facts.columns]), F.lit(" |"))
    names = [f"# {title}", "", f"| {' | '.join(facts.columns)} |", "|" + "---|" * len(facts.columns)]
    head = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(t).alias("text")) for i, t in enumerate(names)])
    top = facts.sparkSession.range(1).select(F.inline(head))
    # One window over a report's rows, which bounded() holds to MOST.
    rows = bounded(facts).select((F.row_number().over(Window.orderBy(*order)) + (len(names) - 1)).alias("line"), row.alias("text"))
    return top.unionByName(rows)


def bounded(facts: DataFrame) -> DataFrame:
    """The same rows; more than MOST fail the job, as they are no report."""
    n = facts.agg(F.count(F.lit(1)).alias("_n"))
    ok = F.when(F.col("_n") <= MOST, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"a report has at most {MOST} rows, not "), F.col("_n").cast("string"))).cast("boolean"))
    return facts.crossJoin(F.broadcast(n.select(ok.alias("_ok")))).where("_ok").drop("_ok")


def json_text(facts: DataFrame, order: list[str]) -> DataFrame:
    """One row, `json`: the facts as an array of objects in the given order, with null fields."""
    listed = bounded(facts).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*facts.columns).alias("f")))).alias("l"))
    return listed.select(F.to_json(F.transform("l", lambda x: x["f"]), {"ignoreNullFields": "false"}).alias("json"))


def write_report(title: str, facts: DataFrame, order: list[str], path: str) -> None:
    """Both forms under a folder that all executors reach: report.md and report.json, each a folder of one text file."""
    markdown(title, facts, order).coalesce(1).sortWithinPartitions("line").select("text").write.mode("overwrite").text(f"{path}/report.md")
    json_text(facts, order).coalesce(1).write.mode("overwrite").text(f"{path}/report.json")
