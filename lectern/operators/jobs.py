"""Job log: numbering, polling, progress and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Add seq, dense from 0 for each job."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(job).orderBy(*order)) - 1)


def poll(events: DataFrame, cursors: DataFrame, job: str) -> DataFrame:
    """For each (job, after) the number of events past the cursor and the next cursor."""
    joined = cursors.join(events, job, "left")
    past = F.col("seq") > F.col("after")
    return joined.groupBy(job, "after").agg(F.count(F.when(past, 1)).alias("n"), F.coalesce(F.max(F.when(past, F.col("seq"))) + 1, F.first("after") + 1).alias("next"))


def weighted_progress(stages: DataFrame, job: str, weight: Column, fraction: Column) -> DataFrame:
    return stages.groupBy(job).agg((F.sum(weight * fraction) / F.sum(weight)).alias("progress"))


def monotone(events: DataFrame, job: str, order: list[str], percent: str) -> DataFrame:
    """Replace a percentage by the largest so far."""
    w = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(percent, F.max(percent).over(w))


def beyond_newest(rows: DataFrame, group: list[str], order: list[Column], keep: int) -> DataFrame:
    """What retention drops: all but the newest `keep` of each group."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") > keep).drop("_rn")


def upload_gaps(parts: DataFrame, upload: str, number: str) -> DataFrame:
    """Parts of an upload that do not follow the one before; a repeated part is no gap."""
    w = Window.partitionBy(upload).orderBy(number)
    step = F.col(number) - F.coalesce(F.lag(number).over(w), F.lit(-1))
    return parts.dropDuplicates([upload, number]).withColumn("step", step).where("step > 1")


#: Stages of an import in order; those marked True run again when a job is resumed.
STAGES = (("open", True), ("contract", True), ("probe", True), ("preflight", False), ("write", False), ("verify", False), ("report", False))


def interrupted(jobs: DataFrame) -> DataFrame:
    """After a restart: jobs that were running or waiting are interrupted; nothing else changes."""
    return jobs.withColumn("status", F.when(F.col("status").isin("running", "queued"), "interrupted").otherwise(F.col("status")))


def stages_to_run(log: DataFrame, job: str) -> DataFrame:
    """(job, stage, position) that a resumed job still has to run: all that were never 'ok', and those that always run."""
    table = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), F.lit(always).alias("always")) for i, (name, always) in enumerate(STAGES)])
    wanted = log.select(job).distinct().select(job, F.inline(table))
    done = log.where("status = 'ok'").select(job, "stage").distinct()
    return wanted.where("always").unionByName(wanted.where("not always").join(done, [job, "stage"], "left_anti")).select(job, "stage", "position")


def run_stages(stages: dict, done: set[str], log) -> None:
    """Run the stages of an import (name -> function) in order, leaving out those that are done; `log(stage, status)` is told
    of each, and a failure ends the run after it is logged."""
    for name, always in STAGES:
        if name not in stages or (name in done and not always):
            continue
        log(name, "running")
        try:
            stages[name]()
        except Exception:
            log(name, "failed")
            raise
        log(name, "ok")


def pace(events: DataFrame, job: str) -> DataFrame:
    """For each job units done, rate (units a second since its first event) and eta_s (seconds left at that rate, null without one).

    events: job, elapsed_s, done, total."""
    last = events.groupBy(job).agg(F.max("done").alias("done"), F.max("total").alias("total"), F.max("elapsed_s").alias("elapsed_s"))
    rate = F.when(F.col("elapsed_s") > 0, F.col("done") / F.col("elapsed_s"))
    return last.withColumn("rate", rate).withColumn("eta_s", F.when(F.col("rate") > 0, F.greatest(F.col("total") - F.col("done"), F.lit(0)) / F.col("rate")))
