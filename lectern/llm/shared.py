"""Tables that outlive a lost executor, and ways to deal rows out evenly."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key that holds more than this part of all rows is joined by a broadcast; so many keys at most are broadcast.
HOT_KEYS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.  On one machine, where none is set, one beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and no executor holds the only copy.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def consumed(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more, and let go of the shuffle files of what was made of them.

    Spark drops the files of a shuffle when the driver's garbage collection finds that nobody holds it.
    """
    for t in tables:
        if path := getattr(t, "_saved_at", None):
            removed(t.sparkSession, path)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lean_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound the Arrow batches that tasks exchange with Python, by rows and by bytes: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, so that extra columns never clash with its own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def document_columns(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string, and nothing else."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucket_of(column: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def split_join(rows: DataFrame, table: DataFrame, key: list[str], n: str) -> DataFrame:
    """Inner join of rows with a table that has one row for each key and, in `n`, how many rows hold it.

    Rows of a hot key stay where they are and meet its row by a broadcast; as the counts add up to the rows, no more
    than HOT_KEYS keys can hold more than that part of them.  All others are shuffled by key.  `n` is not returned.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot, cold = table.where(F.col(n) > total // HOT_KEYS).drop(n), table.where(F.col(n) <= total // HOT_KEYS).drop(n)
    if hot.isEmpty():
        return rows.join(cold.hint("shuffle_hash"), key)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold.hint("shuffle_hash"), key))
