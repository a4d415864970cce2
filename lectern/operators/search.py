"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that travel to every task at once; more take several passes.
QUERIES_AT_ONCE = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
    return np.where(size > 0, x / np.where(size > 0, size, 1), 0)


def cosine_topk(points: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, equal: tuple[str, ...] = (), block: int = QUERIES_AT_ONCE) -> DataFrame:
    """For each query its k most similar points: query_id, id, score (rounded to 6 digits).

    points: id, vector and the columns `equal`; queries: query_id, vector and the same columns, which must agree
    (null agrees with nothing).  A point is no hit for the query of its own id (ids may be of any type).  The threshold is
    inclusive and ties go to the smaller id; both look at the rounded score.  One scan of the points for each `block`
    queries: products of matrices in each task, which keeps the k best of each query and hands on no more than these.
    """
    n = queries.count()
    parts = max(1, -(-n // block))
    found = None
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, score double"
    for part in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        table = own.select("query_id", "vector", *equal).toArrow()  # about `block` rows
        if not table.num_rows and parts > 1:
            continue
        hits = points.select("id", "vector", *equal).where("vector is not null").mapInArrow(_scan(points.sparkSession.sparkContext.broadcast(table), k, min_score, equal), schema)
        found = hits if found is None else found.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Products of queries and points that one step makes.
PRODUCTS = 1 << 22


def _codes(column: pa.Array, known: dict) -> np.ndarray:
    """Values as numbers under which they are known; -1 for null and for values that no query has."""
    return np.array([known.get(v, -1) for v in column.to_pylist()], np.int64)


def _scan(shared, k: int, min_score: float | None, equal: tuple[str, ...]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if not table.num_rows:
            return
        names, q = np.array(table.column("query_id").to_pylist(), object), _unit(_matrix(table.column("vector")))
        known = [{v: i for i, v in enumerate(dict.fromkeys(table.column(c).to_pylist())) if v is not None} for c in equal]
        asked = [np.where((code := _codes(table.column(c), d)) < 0, -2, code) for c, d in zip(equal, known, strict=True)]
        of_name = {v: i for i, v in enumerate(names)}
        best, ids = np.full((len(names), k), -np.inf), np.full((len(names), k), None, object)
        for batch in batches:
            width = max(1, PRODUCTS // len(names))
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                here = np.array(part.column("id").to_pylist(), object)
                score = np.round(q @ _unit(_matrix(part.column("vector"))).T, 6)
                for code, c, d in zip(asked, equal, known, strict=True):
                    score[code[:, None] != _codes(part.column(c), d)[None, :]] = -np.inf
                if min_score is not None:
                    score[score < min_score] = -np.inf
                own = _codes(part.column("id"), of_name)
                score[own[own >= 0], np.flatnonzero(own >= 0)] = -np.inf
                if len(of_name) < len(names):  # a query_id that occurs twice
                    score[names[:, None] == here[None, :]] = -np.inf
                least = best[:, -1] if score.shape[1] <= k else np.maximum(best[:, -1], np.partition(score, -k, axis=1)[:, -k])
                row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                for r in np.unique(row).tolist():
                    mine = col[row == r] if len(row) < 4096 else col[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
                    pool = [*((-s, i) for s, i in zip(best[r], ids[r], strict=True) if s > -np.inf), *((-score[r, c], here[c]) for c in mine.tolist())]
                    pool = sorted(pool)[:k]
                    best[r, : len(pool)], ids[r, : len(pool)] = [-s for s, _ in pool], [i for _, i in pool]
        row, col = np.nonzero(best > -np.inf)
        types = table.schema.field("query_id").type
        yield pa.RecordBatch.from_arrays([pa.array(names[row].tolist(), types), pa.array(ids[row, col].tolist()), pa.array(best[row, col])], names=["query_id", "id", "score"])

    return task


def two_pass(points: DataFrame, queries: DataFrame, k: int, min_score: float, equal: tuple[str, ...], fallback: float = 0.50) -> DataFrame:
    """First within the columns `equal` at min_score; queries without a hit again without them, at the fallback threshold."""
    first = cosine_topk(points, queries, k, min_score, equal).withColumn("pass", F.lit(1))
    empty = queries.join(first.select("query_id").distinct(), "query_id", "left_anti")
    second = cosine_topk(points.select("id", "vector"), empty.select("query_id", "vector"), k, fallback).withColumn("pass", F.lit(2))
    return first.unionByName(second)


def band(score: Column) -> Column:
    """How much a score is worth."""
    return F.when(score >= 0.90, "strong").when(score >= 0.85, "likely").otherwise("weak")
