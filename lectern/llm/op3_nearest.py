"""Approximate nearest neighbours by stable projections and kd-trees.

A vector is projected onto a few Gaussian directions, and a kd-tree divides the projections into cells.  The top
of the tree is fitted on a bounded sample and deals every vector to the one cell that it falls into; inside a cell the same
splitting goes on down to leaves.  The squared projected distance of a point at distance d is
d * d times a chi-square variable.  So once the next projected neighbour lies so far out that a point as near as
the current k-th would almost surely have come before, the search stops: that test bounds the cells that a
query travels to, the leaves that it opens there, and the points that are verified on the original vectors.

Each query first searches its own cell, and then, with the k-th score from there, the cells within its stopping
radius.  Largest inner products become smallest distances by one more coordinate,
sqrt(M * M - |x| * |x|) with M the largest norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import lean_batches, saved

DIRECTIONS, LEAF = 16, 64
#: Vectors that a cell is meant to hold, rows of the sample that the top of the tree is fitted on, cells at most.
CELL_ROWS, SAMPLE, CELLS = 8192, 65536, 4096
#: Doubles of one group of vectors or of queries in a task, and of one gather in a search; queries and leaves that meet at once.
GROUP_DOUBLES, GATHER, QUERIES_AT_ONCE, LEAVES_AT_ONCE = 1 << 23, 1 << 20, 256, 16


def chi_square_cdf(x: np.ndarray, freedom: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_limit(sure: float) -> float:
    """The value that a chi-square variable exceeds with a chance of 1 - sure."""
    lo, hi = 0.0, 1400.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(np.array(mid), DIRECTIONS) < sure else (lo, mid)
    return hi


def projection(width: int) -> np.ndarray:
    """Gaussian directions for vectors of this width and the coordinate that is added."""
    return np.random.default_rng(3).standard_normal((width + 1, DIRECTIONS))


def projected(x: np.ndarray, norm: float) -> np.ndarray:
    """Projections of vectors, the added coordinate included."""
    gauss = projection(x.shape[1])
    lift = np.sqrt(np.maximum(norm * norm - np.einsum("nd,nd->n", x, x), 0))
    return x @ gauss[:-1] + lift[:, None] * gauss[-1]


def split(points: np.ndarray, smallest: int, most: int = 1 << 30) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows of a kd-tree's leaves, the widest side split at its median, and the half-open box of space of each."""
    leaves, todo = [], [(np.arange(len(points)), np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf))]
    while todo:
        own, low, high = todo.pop(0)
        side = int(np.argmax(np.ptp(points[own], axis=0))) if len(own) else 0
        cut = float(np.median(points[own, side])) if len(own) else 0.0
        left = points[own, side] < cut
        if len(own) <= smallest or len(leaves) + len(todo) + 2 > most or not left.any():
            leaves.append((own, low, high))
            continue
        lower, upper = high.copy(), low.copy()
        lower[side] = upper[side] = cut
        todo += [(own[left], low, lower), (own[~left], upper, high)]
    return [x for x, _, _ in leaves], np.stack([x for _, x, _ in leaves]), np.stack([x for _, _, x in leaves])


def box_distances(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(at), len(low)))
    for k in range(at.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, k] - at[:, None, k], at[:, None, k] - high[None, :, k]), 0)
        out += gap * gap
    return out


class Cells:
    """The top of the tree: boxes that divide all of space."""

    def __init__(self, sample: np.ndarray, cells: int):
        _, self.low, self.high = split(sample, max(1, len(sample) // cells), cells) if len(sample) else ([], np.full((1, DIRECTIONS), -np.inf), np.full((1, DIRECTIONS), np.inf))

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int32)
        for i in range(0, len(points), 1024):
            part = points[i : i + 1024]
            inside = np.ones((len(part), len(self.low)), bool)
            for k in range(DIRECTIONS):
                inside &= (part[:, None, k] >= self.low[None, :, k]) & (part[:, None, k] < self.high[None, :, k])
            out[i : i + 1024] = inside.argmax(axis=1)
        return out


class Block:
    """The vectors of one task: their projections in the leaves of a kd-tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float):
        self.ids, self.x, self.norm, self.verified = ids, x, norm, 0
        self.points = projected(x, norm)
        leaves, *_ = split(self.points, LEAF)
        self.size = np.array([len(own) for own in leaves])
        self.rows = np.full((len(leaves), int(self.size.max())), -1)
        for i, own in enumerate(leaves):
            self.rows[i, : len(own)] = own
        self.low = np.stack([self.points[own].min(axis=0) for own in leaves])
        self.high = np.stack([self.points[own].max(axis=0) for own in leaves])

    def search(self, names: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score) with up to k found neighbours of each query; `bound` is a k-th score known before, or -inf."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        at = q @ projection(q.shape[1])[:-1]
        # Queries that lie together open the same leaves.
        order = np.argsort(box_distances(at, self.low, self.high).argmin(axis=1), kind="stable")
        for i in range(0, len(q), QUERIES_AT_ONCE):
            own = order[i : i + QUERIES_AT_ONCE]
            row, name, score = self._search(names[own], q[own], at[own], bound[own], k, limit)
            out.append((own[row], name, score))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _search(self, names: np.ndarray, q: np.ndarray, at: np.ndarray, bound: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        box = box_distances(at, self.low, self.high)
        far = self.norm * self.norm + np.einsum("qd,qd->q", q, q)
        score, found = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        # Each query's own leaf gives a first k-th score.
        own = box.argmin(axis=1)
        for leaf in np.unique(own).tolist():
            query, rows = np.flatnonzero(own == leaf), self.rows[leaf][self.rows[leaf] >= 0]
            other = self.ids[rows][None, :] != names[query, None]
            self.verified += int(other.sum())
            self._merge(score, found, query, np.where(other, q[query] @ self.x[rows].T, -np.inf), rows, q, k)
        # Then leaves from the nearest outwards, a few at a time; each query leaves out those beyond its own radius.
        leaves = np.argsort(box.min(axis=0) + box.mean(axis=0), kind="stable")
        for i in range(0, len(leaves), LEAVES_AT_ONCE):
            some = leaves[i : i + LEAVES_AT_ONCE]
            # The stopping test: beyond this projected distance a point as near as the k-th is too unlikely.
            kth = np.maximum(score[:, -1], bound)
            radius = np.where(np.isfinite(kth), np.maximum(far - 2 * np.where(np.isfinite(kth), kth, 0), 1e-300) * limit, np.inf)
            open_ = (box[:, some] <= radius[:, None]) & (some[None, :] != own[:, None])
            query, leaf = np.flatnonzero(open_.any(axis=1)), some[open_.any(axis=0)]
            if not len(query):
                continue
            taken = self.rows[leaf] >= 0
            rows, of = self.rows[leaf][taken], np.repeat(leaf, taken.sum(axis=1))
            gap = np.einsum("qd,qd->q", at[query], at[query])[:, None] + np.einsum("pd,pd->p", self.points[rows], self.points[rows])[None, :] - 2 * (at[query] @ self.points[rows].T)
            near = (gap <= radius[query, None] * (1 + 1e-9) + 1e-9) & (of[None, :] != own[query, None]) & (self.ids[rows][None, :] != names[query, None])
            self.verified += int(near.sum())
            # Where only a few are near these are looked at one by one, else by one product of matrices.
            value = np.full(near.shape, -np.inf)
            if near.mean() > 0.05:
                value[near] = (q[query] @ self.x[rows].T)[near]
            else:
                a, b = np.nonzero(near)
                for j in range(0, len(a), GATHER // self.x.shape[1] + 1):
                    part = slice(j, j + GATHER // self.x.shape[1] + 1)
                    value[a[part], b[part]] = np.einsum("pd,pd->p", self.x[rows[b[part]]], q[query[a[part]]])
            self._merge(score, found, query, value, rows, q, k)
        query, place = np.nonzero(np.isfinite(score))
        return query, found[query, place], score[query, place]

    def _merge(self, score: np.ndarray, found: np.ndarray, query: np.ndarray, value: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int) -> None:
        """Take up what is among the k best of its query, ties to smaller ids; products are made anew, so that equal vectors have equal scores."""
        least = np.maximum(score[query, -1], np.partition(value, -k, axis=1)[:, -k] if value.shape[1] > k else -np.inf)
        a, b = np.nonzero((value > -np.inf) & (value >= (least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0)) - 1e-300)[:, None]))
        touched = np.unique(a)
        old = query[touched]
        row = np.concatenate([np.repeat(touched, k), a])
        exact = np.einsum("pd,pd->p", self.x[rows[b]], q[query[a]])
        new_score, new_name = np.concatenate([score[old].ravel(), exact]), np.concatenate([found[old].ravel(), self.ids[rows[b]]])
        order = np.lexsort((new_name, -new_score, row))
        row, new_score, new_name = row[order], new_score[order], new_name[order]
        place = np.searchsorted(row, touched)[:, None] + np.arange(k)[None, :]
        score[old], found[old] = new_score[place], new_name[place]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1)


def _placed(df: DataFrame, shared, norm: float | None) -> DataFrame:
    """Add the cell of each vector; queries (no norm) lie in the plane of the added coordinate."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), batch.num_rows)
                points = x @ projection(x.shape[1])[:-1] if norm is None else projected(x, norm)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.of(points))], names=["vec_id", "embedding", "cell"])

    return df.select("vec_id", "embedding").mapInArrow(task, "vec_id long, embedding array<double>, cell int")


def _searched(vectors: DataFrame, queries: DataFrame, norm: float, width: int, k: int, sure: float) -> DataFrame:
    """(query_id, vec_id, score) of the queries in the cells they are dealt to; a cell with many vectors or queries is several groups."""
    limit, rows = chi_square_limit(sure), max(256, GROUP_DOUBLES // width)
    sizes = vectors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / min(rows, 2 * CELL_ROWS)).alias("x_parts"))
    visits = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).alias("q_parts"))
    parts = F.broadcast(sizes.join(visits, "cell"))  # a row for each cell, CELLS at most
    split_by = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = vectors.join(parts, "cell").select("cell", split_by("x_parts").alias("x_part"), every("q_parts").alias("q_part"), "vec_id", "embedding")
    right = queries.join(parts, "cell").select("cell", every("x_parts").alias("x_part"), split_by("q_parts").alias("q_part"), "vec_id", "embedding", "kth")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        r, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        names = b.column("vec_id").to_numpy()
        if a.num_rows and b.num_rows:
            block = Block(a.column("vec_id").to_numpy(), _matrix(a.column("embedding"), a.num_rows), norm)
            bound = b.column("kth").fill_null(-np.inf).to_numpy()
            r, v, s = block.search(names, _matrix(b.column("embedding"), b.num_rows), bound, k, limit)
        return pa.table({"query_id": pa.array(names[r], pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ["cell", "x_part", "q_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; of one vec_id with several vectors the nearest counts."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sure: float = 0.95) -> DataFrame:
    """For each query its k nearest rows of `vectors` by inner product: query_id, rank (from 1), vec_id, score.

    Both inputs hold vec_id and embedding; a row is no neighbour of the query with its own vec_id.  Nearest first, ties to
    the smaller vec_id; all candidates if there are fewer than k are found.  Vectors that are null, zero, hold null or non-finite
    components or have another length than that of the smallest vec_id take no part, nor do rows without a vec_id.  Of rows that share
    vec_id and vector one counts; a vec_id with several vectors counts once, with the nearest, and as a query with the
    smallest.  The tree's top is fitted on SAMPLE rows at most, every row is indexed, and `sure` is the least chance with
    which a neighbour nearer than the k-th is seen before a search stops.  Empty tables give an empty table.

    Vectors are shuffled once for each of the two rounds and queries once for each cell in their stopping radius: in
    proportion to the tables where the data have clusters.  Where they have none, as with independent Gaussian vectors of many
    dimensions, that radius holds most cells, and no index of this kind can do better.
    """
    spark = vectors.sparkSession
    lean_batches(spark)

    def valid(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
        finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return df.where(finite & F.exists("embedding", lambda v: v != 0))

    x, q = valid(vectors), valid(queries)
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    facts = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(squared)).alias("norm"), F.min_by(F.size("embedding"), "vec_id").alias("width")).first()
    width, norm, n = int(facts.width or 1), float(facts.norm or 0), facts.n
    x, q = x.where(F.size("embedding") == width), q.where(F.size("embedding") == width)
    # Of equal vectors only the k + 1 smallest ids can be anybody's neighbours.
    x = x.dropDuplicates(["vec_id", "embedding"])
    x = x.withColumn("nth", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    q = q.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # A bounded sample fits the boxes; ids are hashed, so it does not depend on partitions.
    share = min(1.0, SAMPLE / max(n, 1))
    sample = x.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE).select("embedding").toArrow()
    fitted = Cells(projected(_matrix(sample.column(0), sample.num_rows), norm) if sample.num_rows else np.zeros((0, DIRECTIONS)), int(min(CELLS, max(1, -(-n // CELL_ROWS)))))
    shared = spark.sparkContext.broadcast(fitted)  # two bounds for each cell and direction
    x, q = saved(_placed(x, shared, norm), "vectors"), saved(_placed(q, shared, None), "queries")
    first = saved(_searched(x, q.withColumn("kth", F.lit(None).cast("double")), norm, width, k, sure), "first")
    if len(fitted.low) == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", "score")
    kth = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    limit = chi_square_limit(sure)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each other cell in the stopping radius of a query."""
        cells = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                own = _matrix(part.column("embedding"), part.num_rows)
                known = part.column("kth").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                near = norm * norm + np.einsum("qd,qd->q", own, own) - 2 * np.where(np.isfinite(known), known, 0)
                radius = np.where(np.isfinite(known), np.maximum(near, 1e-300) * limit, np.inf)
                visit = box_distances(own @ projection(own.shape[1])[:-1], cells.low, cells.high) <= radius[:, None]
                visit[np.arange(part.num_rows), part.column("cell").to_numpy()] = False
                row, to = np.nonzero(visit)
                took = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([took.column("vec_id"), took.column("embedding"), took.column("kth"), pa.array(to.astype(np.int32))], names=["vec_id", "embedding", "kth", "cell"])

    again = q.join(kth, "vec_id", "left").select("vec_id", "embedding", "cell", "kth").mapInArrow(further, "vec_id long, embedding array<double>, kth double, cell int")
    found = first.unionByName(_searched(x, again, norm, width, k, sure))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0))
