"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def components(links: DataFrame) -> DataFrame:
    """(id, label) for each end of a link, label being the smallest id that can be reached.

    Links are (a, b) pairs of longs in any order, repeated or not.  Each round takes the
    smallest label among the neighbours and then the label of that label, so labels travel
    twice as far in each round; the tables of a round go to the shared folder.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("low"))
        parent = labels.select(F.col("id").alias("low"), F.col("label").alias("up"))
        moved = saved(lower.join(parent, "low").select("id", F.col("up").alias("label"), (F.col("up") < F.col("label")).alias("moved")), "labels")
        labels = moved.select("id", "label")
        if moved.where("moved").isEmpty():
            return labels
