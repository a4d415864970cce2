"""Bundles: a folder of points with their vectors, and a manifest that tells what must be in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "schema string, profile string, id_rule string, dim int, count bigint, books array<struct<lang:string,book_code:string,n:bigint>>"


def manifest_of(points: DataFrame, profile: str, id_rule: str) -> DataFrame:
    """One row: counts by book and in all, the dimension; made by aggregation."""
    books = points.groupBy("lang", "book_code").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"))
    return books.agg(F.lit("bundle/2").alias("schema"), F.lit(profile).alias("profile"), F.lit(id_rule).alias("id_rule"), F.max("dim").alias("dim"), F.sum("n").alias("count"), F.array_sort(F.collect_list(F.struct("lang", "book_code", "n"))).alias("books"))


def write_bundle(points: DataFrame, path: str, profile: str, id_rule: str) -> None:
    """Points first, the manifest last: a bundle without a manifest is not finished."""
    points.write.parquet(f"{path}/points")
    stored = points.sparkSession.read.parquet(f"{path}/points")
    manifest_of(stored, profile, id_rule).coalesce(1).write.json(f"{path}/manifest")


def check_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Books whose count differs from the manifest's, by language and code, in either direction."""
    from ..operators.checks import reconcile

    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    expected = manifest.select(F.inline("books"))
    found = spark.read.parquet(f"{path}/points").groupBy("lang", "book_code").agg(F.count(F.lit(1)).alias("n"))
    return reconcile(expected, found, ["lang", "book_code"])


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The points, once the counts are right."""
    if not check_bundle(spark, path).isEmpty():
        raise ValueError(f"{path} does not hold what its manifest says")
    return spark.read.parquet(f"{path}/points")
