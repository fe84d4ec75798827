"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Vectors are projected to DIMENSIONS normal (2-stable) directions; a projected squared distance over the
true one is chi-square with so many degrees of freedom. A kd-tree whose top is fitted on a bounded sample
deals all vectors to shards of about SHARD_ROWS; each shard grows the rest of its tree. A query first
searches its own shard, leaf by leaf in order of projected distance, and checks true distances on the
way. It stops once what is left is so far in projection that, by the chi-square test at CONFIDENCE, it
cannot hide a nearer vector. The other shards that this test does not rule out are searched the same way.
The sample bounds the number of shards; one that holds more than SHARD_ROWS is dealt to parts by hash, each
with a tree of its own, and its queries search all parts, so no task ever holds more at any size.

Of equal vectors with one id only k rows can be among a query's k nearest, and of what is left, with the
query's own id left out, only the 2 k smallest ids; so only these are indexed: exact, also with repeated
ids, and it keeps a vector that a third of all rows share out of any single task.

Defined results: vectors null, empty, zero or with null or non-finite components take no part, nor do
those whose length is not the most common (smallest of equals); a query id that occurs twice asks once,
with its smaller vector; candidates with the query's id are its own; other repeated ids are separate
candidates; null ids take no part; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import checkpointed

DIMENSIONS, CONFIDENCE, SEED = 8, 0.99, 7
SHARD_ROWS, LEAF_ROWS, SAMPLE_ROWS = 8192, 128, 16_384


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists(vector, lambda x: x != 0)


def chi_square(degrees: int, p: float) -> float:
    """Quantile by the cube-root normal approximation."""
    a = 2 / (9 * degrees)
    return degrees * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, DIMENSIONS))


class Tree:
    """A kd-tree over rows of points; leaves hold at most so many, with the boxes that splits leave them."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, cut, left, right; a leaf is ~number
        self.boxes: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        whole = np.array([[-np.inf, np.inf]] * points.shape[1])
        self.root = self._grow(points, np.arange(len(points)), whole, leaf_rows)

    def _grow(self, points, rows, box, leaf_rows) -> int:
        own = points[rows]
        spread = own.max(0) - own.min(0) if len(rows) else np.zeros(points.shape[1])
        axis = int(spread.argmax())
        cut = float(np.median(own[:, axis])) if len(rows) > leaf_rows else 0.0
        left = own[:, axis] < cut if len(rows) > leaf_rows else None
        if left is None or not spread[axis] or not left.any():
            self.boxes.append(box)
            self.rows.append(rows)
            return ~(len(self.rows) - 1)
        at = len(self.splits)
        self.splits.append((axis, cut, 0, 0))
        low, high = box.copy(), box.copy()
        low[axis, 1], high[axis, 0] = cut, cut
        self.splits[at] = (axis, cut, self._grow(points, rows[left], low, leaf_rows), self._grow(points, rows[~left], high, leaf_rows))
        return at

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int32), [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                axis, cut, a, b = self.splits[node]
                left = points[rows, axis] < cut
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of each leaf's box."""
        if not hasattr(self, "_box"):
            self._box = np.stack(self.boxes)
        out = np.maximum(np.maximum(self._box[:, :, 0] - point, point - self._box[:, :, 1]), 0)
        return (out * out).sum(1)


def search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, shadows: np.ndarray, own: int, query: np.ndarray, shadow: np.ndarray, k: int, factor: float, known: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest found: squared distances and rows. known: a squared distance within which k are known elsewhere."""
    best_d, best_r = np.zeros(0), np.zeros(0, np.int64)
    gaps = tree.gaps(shadow)
    for leaf in np.argsort(gaps, kind="stable"):
        reach = min(known, best_d[k - 1] if len(best_d) >= k else np.inf)
        if gaps[leaf] > reach * factor:
            break
        rows = tree.rows[leaf]
        near = ((shadows[rows] - shadow) ** 2).sum(1) <= reach * factor if np.isfinite(reach) else np.ones(len(rows), bool)
        rows = rows[near & (ids[rows] != own)]
        if not len(rows):
            continue
        d = ((vectors[rows] - query) ** 2).sum(1)
        best_d, best_r = np.append(best_d, d), np.append(best_r, rows)
        order = np.lexsort((ids[best_r], np.sqrt(best_d)))[:k]
        best_d, best_r = best_d[order], best_r[order]
    return best_d, best_r


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    return np.asarray(flat).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest found of each row where is_query holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding"), is_query.alias("asks")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return empty
    size, n = sizes[0], sizes[1]
    rows = rows.where(F.size("embedding") == size)
    project = directions(size)
    factor = chi_square(DIMENSIONS, confidence)
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding", "vec_id").orderBy("vec_id"))).where(F.col("n") <= k)
    indexed = few.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= 2 * k).select("vec_id", "embedding")
    sample = rows.select("embedding").orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE_ROWS).toArrow()
    shadows = _matrix(sample.column("embedding")) @ project
    shards = max(1, min(-(-n // SHARD_ROWS), SAMPLE_ROWS // 8))
    top = Tree(np.unique(shadows, axis=0), max(1, -(-len(shadows) // shards)))
    shared = spark.sparkContext.broadcast((top, project))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, matrix = shared.value
        for batch in batches:
            if batch.num_rows:
                shard = tree.leaf_of(_matrix(batch.column("embedding")) @ matrix)
                yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", *batch.schema.names])

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = checkpointed(indexed.mapInArrow(place, f"shard int, vec_id long, embedding {kind}"))
    parts = F.broadcast(checkpointed(placed.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts"))))  # a row for each shard
    placed = placed.join(parts, "shard").select("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts")).cast("int").alias("part"), "vec_id", "embedding")
    to_parts = lambda asked: asked.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "embedding", "known")
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = checkpointed(asked.mapInArrow(place, f"shard int, vec_id long, embedding {kind}")).withColumn("known", F.lit(float("inf")))

    def answer(key: tuple, data: pa.Table, asked: pa.Table) -> pa.Table:
        matrix = shared.value[1]
        out: list[tuple] = []
        ids = np.asarray(data.column("vec_id").combine_chunks()).astype(np.int64)
        if len(ids) and asked.num_rows:
            points = _matrix(data.column("embedding"))
            flat = points @ matrix
            tree = Tree(flat, LEAF_ROWS)
            asks = _matrix(asked.column("embedding"))
            for query, vector, shadow, known in zip(asked.column("vec_id").to_pylist(), asks, asks @ matrix, asked.column("known").to_pylist()):
                d, r = search(tree, ids, points, flat, query, vector, shadow, k, factor, known)
                out += [(query, int(ids[x]), float(y)) for x, y in zip(r, d)]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "square": pa.array([x[2] for x in out], pa.float64())})

    answers = "query_id long, vec_id long, square double"
    near = checkpointed(placed.groupBy("shard", "part").cogroup(to_parts(first).groupBy("shard", "part")).applyInArrow(answer, answers))
    # At most k answers of each part of one shard.
    found = near.groupBy("query_id").agg(F.count("*").alias("n"), F.get(F.sort_array(F.collect_list("square")), F.lit(k - 1)).alias("far"))
    second = first.drop("known").join(found.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("shard", "vec_id", "embedding", F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).alias("known"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each further shard that the stopping test leaves."""
        tree, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("embedding"))
            known = np.asarray(batch.column("known"))
            own = np.asarray(batch.column("shard"))
            row, shard = [], []
            for i, shadow in enumerate(vectors @ matrix):
                gaps = tree.gaps(shadow)
                hit = np.flatnonzero(gaps <= known[i] * factor) if np.isfinite(known[i]) else np.arange(len(gaps))
                hit = hit[hit != own[i]]
                row.append(np.full(len(hit), i))
                shard.append(hit)
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard).astype(np.int32)), *(batch.column(c).take(at) for c in ("vec_id", "embedding", "known"))], names=["shard", "vec_id", "embedding", "known"])

    further = second.mapInArrow(others, f"shard int, vec_id long, embedding {kind}, known double")
    far = placed.groupBy("shard", "part").cogroup(to_parts(further).groupBy("shard", "part")).applyInArrow(answer, answers)
    ranked = near.union(far).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.sqrt("square"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.sqrt("square").alias("score"))
