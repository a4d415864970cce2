"""Queries on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import checks, search
from .registry import Tables, query

SCORES = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, q.label AS q_label, p.label AS p_label,
             round(list_cosine_similarity(q.e, p.e), 6) AS score
      FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0)
"""


def _points(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


@query(SCORES + "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5", long="rank")
def semantic_topk(t: Tables) -> DataFrame:
    return search.cosine_topk(_points(t), _queries(t), 5)


@query(
    SCORES
    + """, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE q_label = p_label AND score >= 0.3) WHERE rank <= 3),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.2 AND query_id NOT IN (SELECT query_id FROM a)) WHERE rank <= 3)
SELECT query_id, id, score, rank, 1 AS pass FROM a UNION ALL SELECT query_id, id, score, rank, 2 FROM b""",
    long="rank",
)
def semantic_lookup_two_pass(t: Tables) -> DataFrame:
    return search.two_pass(_points(t), _queries(t), 3, 0.3, ("label",), fallback=0.2)


@query(SCORES + "SELECT query_id, id, score, CASE WHEN score >= 0.9 THEN 'strong' WHEN score >= 0.85 THEN 'likely' ELSE 'weak' END AS band FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE q_label = p_label AND score >= 0.2) WHERE rank <= 20")
def semantic_threshold_filtered(t: Tables) -> DataFrame:
    found = search.cosine_topk(_points(t), _queries(t), 20, 0.2, ("label",))
    return found.select("query_id", "id", "score", search.band(F.col("score")).alias("band"))


@query("""SELECT label, count(*) AS n, round(min(x), 6) AS least, round(max(x), 6) AS most, round(avg(x), 6) AS mean
FROM (SELECT label, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda e: e * e))) AS x FROM embeddings) GROUP BY label""")
def vector_norm_stats(t: Tables) -> DataFrame:
    x = t.embeddings.select("label", V.norm(F.col("embedding")).alias("x"))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"), F.round(F.avg("x"), 6).alias("mean"))


@query("""WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY label)
SELECT m.label, i, round(x / size, 6) AS value FROM m JOIN n USING (label)""", long="i")
def mean_pooled_labels(t: Tables) -> DataFrame:
    mean = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    size = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return mean.join(size, "label").select("label", (F.col("i") + 1).alias("i"), F.round(F.col("x") / F.col("size"), 6).alias("value"))


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
f AS (SELECT id + 1 AS id, e FROM v WHERE id % 50 = 0)
SELECT f.id, round(list_cosine_similarity(f.e, v.e), 6) AS cosine,
  CASE WHEN v.id IS NULL THEN 'missing' WHEN round(list_cosine_similarity(f.e, v.e), 6) < 0.3 THEN 'below' WHEN round(list_cosine_similarity(f.e, v.e), 6) < 0.6 THEN 'suspicious' ELSE 'ok' END AS status
FROM f LEFT JOIN v ON f.id = v.id""")
def calibration_gate(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("stored"))
    fixture = t.embeddings.where("vec_id % 50 = 0").select((F.col("vec_id") + 1).alias("id"), "embedding")
    return checks.cosine_gate(vectors, fixture, V.cosine(F.col("stored"), F.col("embedding")), 0.3, 0.6).select("id", "cosine", "status")
