"""Batches of texts under a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one shard; batches never cross shards.
SHARD_ROWS = 50_000


def plan_batches(texts: DataFrame, budget: int) -> DataFrame:
    """(id, tokens, shard, batch): in each shard, longest first, as many texts to a batch as the longest of it allows.

    A text longer than the budget is a batch of its own.  Shards are by hash, so their size is bounded and the
    order of a shard, by length and id, does not depend on partitions.
    """
    shards = max(1, -(-texts.count() // SHARD_ROWS))

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tokens", "id"], ascending=[False, True], ignore_index=True)
        tokens, batch, at, number = part["tokens"].to_numpy(), [], 0, 0
        while at < len(tokens):
            n = min(max(1, budget // max(1, int(tokens[at]))), len(tokens) - at)
            batch += [number] * n
            at, number = at + n, number + 1
        return part.assign(batch=batch)[["id", "tokens", "shard", "batch"]]

    sharded = texts.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("tokens")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(cut, "id bigint, tokens bigint, shard bigint, batch bigint")
