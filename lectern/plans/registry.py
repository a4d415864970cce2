"""Where queries register themselves, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def scratch_folder(t: Tables) -> str:
    """A new folder that driver and executors share, for a query that writes files; it goes when the driver ends."""
    spark = t._spark
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/scratch-{uuid.uuid4().hex}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return where.toString()


def widened(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: df[c].cast("long") for c in columns}) if columns else df


def query(sql: str | None = None, long: str = ""):
    """Register a function of Tables under its name; the columns `long` are widened to the type that the SQL gives."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: widened(f(Tables(spark, folder)), long.split())
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep
