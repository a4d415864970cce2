"""Queries on the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import checks, jobs
from .registry import Tables, query

SEQ = "WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events) "


@query(SEQ + "SELECT event_id, user_id, seq FROM s", long="seq")
def event_log_seq(t: Tables) -> DataFrame:
    return jobs.numbered(t.events.select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "seq")


@query(SEQ + ", c AS (SELECT DISTINCT user_id, user_id % 20 AS after FROM events) SELECT c.user_id, after, count(*) FILTER (seq > after) AS n, coalesce(max(seq) FILTER (seq > after) + 1, after + 1) AS next FROM c LEFT JOIN s USING (user_id) GROUP BY c.user_id, after")
def event_poll(t: Tables) -> DataFrame:
    numbered = jobs.numbered(t.events.select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"])
    cursors = t.events.select("user_id", (F.col("user_id") % 20).alias("after")).distinct()
    return jobs.poll(numbered, cursors, "user_id")


@query("""WITH w AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 5.0 WHEN 'click' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, least(abs(value) / 100.0, 1.0)::DOUBLE AS frac FROM events)
SELECT user_id, round(sum(weight * frac) / sum(weight), 6) AS progress FROM w GROUP BY user_id""")
def progress_weighted(t: Tables) -> DataFrame:
    weight = F.when(F.col("event_type") == "purchase", 5.0).when(F.col("event_type") == "click", 2.0).otherwise(1.0)
    rows = jobs.weighted_progress(t.events, "user_id", weight, F.least(F.abs("value") / 100.0, F.lit(1.0)))
    return rows.select("user_id", F.round("progress", 6).alias("progress"))


@query("SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS value FROM events")
def progress_monotone(t: Tables) -> DataFrame:
    rows = jobs.monotone(t.events.select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value")
    return rows.select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'purchase') WHERE rn > 3")
def retention_prune(t: Tables) -> DataFrame:
    done = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return jobs.beyond_newest(done, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("event_id", "user_id")


@query("SELECT user_id, count(*) FILTER (value > 10) AS live, max(ts) AS last_used FROM events GROUP BY user_id")
def live_sessions(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count_if(F.col("value") > 10).alias("live"), F.max("ts").alias("last_used"))


@query("""WITH k AS (SELECT DISTINCT event_type, user_id FROM events)
SELECT event_type, len(l) AS jobs, l[1] AS first, l[len(l)] AS last FROM (SELECT event_type, list_sort(list(user_id)) AS l FROM k GROUP BY event_type)""", long="jobs")
def packs_with_jobs(t: Tables) -> DataFrame:
    """What each pack was imported by: distinct first, so no repeated id is gathered."""
    pairs = t.events.select("event_type", "user_id").distinct()
    return pairs.groupBy("event_type").agg(F.count(F.lit(1)).cast("int").alias("jobs"), F.min("user_id").alias("first"), F.max("user_id").alias("last"))


@query("""WITH k AS (SELECT event_id, json_keys(props) AS keys FROM events)
SELECT event_id, array_to_string(list_sort(list_filter(['k', 'page', 'ref'], lambda x: NOT list_contains(keys, x))), ',') AS missing, array_to_string(list_sort(list_filter(keys, lambda x: NOT list_contains(['k', 'page', 'ref'], x))), ',') AS unknown FROM k""")
def payload_keys(t: Tables) -> DataFrame:
    """Required keys that a payload lacks, and keys that are not known."""
    present = F.json_object_keys("props")
    known = ["k", "page", "ref"]
    rows = t.events.select("event_id", F.array_join(checks.required_missing(present, known), ",").alias("missing"), F.array_join(checks.unknown_keys(present, known), ",").alias("unknown"))
    return rows


@query("WITH s AS (SELECT user_id, event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS step FROM events) SELECT user_id, event_id, step FROM s WHERE step > 1")
def upload_gaps(t: Tables) -> DataFrame:
    return jobs.upload_gaps(t.events.select("user_id", "event_id"), "user_id", "event_id").select("user_id", "event_id", "step")


@query("""WITH s AS (SELECT event_id, user_id, date_trunc('hour', ts) AS hour, value FROM events)
SELECT hour, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY hour""")
def event_stream_hours(t: Tables) -> DataFrame:
    """The batch form of streaming.events.hourly, which a file stream runs with the same expressions."""
    from ..streaming.events import hourly

    return hourly(t.events).select("hour", "n", F.round("total", 4).alias("total"))


@query()
def token_batches(t: Tables) -> DataFrame:
    """Batches under a token budget are cut greedily, which SQL has not; tested against a plain loop."""
    from ..operators.batches import plan_batches

    return plan_batches(t.documents.select(F.col("doc_id").alias("id"), F.ceil(F.length("text") / 4).alias("tokens")), 8192)


@query("""SELECT lang, source AS book_code, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ALL""")
def manifest_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", F.col("source").alias("book_code")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""WITH x AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, n_chars > 2000 ORDER BY doc_id) AS rn, n_chars > 2000 AS long FROM documents)
SELECT lang, long, doc_id FROM x WHERE rn <= 2""")
def fixture_export(t: Tables) -> DataFrame:
    """The first two points of each slot (language, long or short), by id."""
    slot = Window.partitionBy("lang", "long").orderBy("doc_id")
    rows = t.documents.select("lang", (F.col("n_chars") > 2000).alias("long"), "doc_id").withColumn("rn", F.row_number().over(slot))
    return rows.where("rn <= 2").drop("rn")
