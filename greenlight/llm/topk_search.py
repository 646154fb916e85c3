"""Exact top-k inner products by the threshold algorithm, in blocks of queries and blocks of vectors.

Vectors are dealt into blocks of bounded size by a hash of id and components, and every block of queries meets every
block of vectors once. A meeting sorts the block by each dimension and walks the lists from the end that a
query's sign favours, a stretch at a time: vectors seen for the first time are scored in full, and the walk
ends when the bound on all unseen vectors, the inner product with the values at the present depth, is below
the k-th score so far. The best k of all blocks are then ranked per query.

Defined results
- Components become ``floor(scale * x)`` as long. Vectors that are null or hold null or non-finite
  components, and rows without an id, take no part.
- Rows that share an id are candidates each, and queries each; a query id's ranks are those of all its rows together.
  Rows that are equal in id and components are searched once and counted as often as they occur.
- A query never meets its own id; ties go to the smaller id. Vectors of another length than the query's have
  no score with it. Scores must fit a long; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
VECTOR_BLOCK = 8192
FIRST_STRETCH = 16
EXACT_DOUBLE = 1 << 53
EXACT_LONG = 1 << 63

SCORED = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("copies", pa.int32())])


def quantised(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and whole-number components of the vectors that take part, and how many rows hold both."""
    x = F.col(vector_column).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).where(finite)
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v)).alias("vec"))
    return rows.groupBy("vec_id", "vec").agg(F.count("*").alias("copies"))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if rows else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


class Lists:
    """The sorted lists of one block: for each dimension the rows by ascending value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=0)
        self.floats = values.astype(np.float64)
        self.largest = int(np.abs(self.floats).max()) if values.size else 0

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products, exact: in doubles, longs or Python's integers as the sizes ask for."""
        most = (self.largest + 1) * (int(np.abs(query.astype(np.float64)).max(initial=0)) + 1) * len(query)
        if most < EXACT_DOUBLE:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        if most < EXACT_LONG:
            return self.values[rows] @ query
        return np.array(self.values[rows].astype(object) @ query.astype(object), dtype=object)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows for one query, and of fewer if there are fewer."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        down = query[dims] > 0
        weights = query[dims].astype(object) if self.largest >= 1 << 26 else query[dims]
        seen = self.ids == query_id
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, stretch = 0, FIRST_STRETCH
        while depth < n:
            stop = min(n, depth + stretch)
            high, low = self.order[n - stop : n - depth, dims[down]], self.order[depth:stop, dims[~down]]
            fresh = np.zeros(n, bool)
            fresh[high.ravel()] = True
            fresh[low.ravel()] = True
            if not len(dims):
                fresh[:], stop = True, n
            rows = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            found = np.concatenate([found, rows])
            scores = np.concatenate([scores, self.scores(rows, query)])
            if len(found) > k:
                if len(found) > 8 * k and scores.dtype != object:
                    near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    found, scores = found[near], scores[near]
                best = np.lexsort((self.ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
            at = np.where(down, n - stop, stop - 1)
            bound = (self.sorted[at, dims] * weights).sum()
            if len(found) == k and bound < scores[-1] or seen.all():
                break
            depth, stretch = stop, stretch * 2
        return found, scores


def _meet(k: int):
    def meet(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_v, out_s, out_c = [], [], [], []
        if queries.num_rows and vectors.num_rows:
            block = Lists(vectors.column("vec_id").to_numpy(), _matrix(vectors.column("vec"), vectors.num_rows))
            copies = np.minimum(vectors.column("copies").to_numpy(), k)
            own = queries.column("vec_id").to_pylist(), queries.column("copies").to_pylist()
            for query_id, repeats, query in zip(*own, _matrix(queries.column("vec"), queries.num_rows)):
                rows, scores = block.search(query_id, query, k)
                out_q += [query_id] * len(rows)
                out_v += block.ids[rows].tolist()
                out_s += scores.tolist()
                out_c += np.minimum(copies[rows] * min(repeats, k), k).tolist()
        return pa.table([pa.array(x, kind) for x, kind in zip((out_q, out_v, out_s, out_c), SCORED.types)], schema=SCORED)

    return meet


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding",
          query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of each query. ``is_query`` is a condition on
    ``vec_id``. Sizes of blocks bound what a task holds; their numbers follow the row counts."""
    rows = quantised(vectors, scale, id_column, vector_column).withColumn("dims", F.size("vec"))
    ids = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"))
    counted = ids.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_blocks, q_blocks = -(-max(1, counted["n"]) // vector_block), -(-max(1, counted["q"]) // query_block)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(is_query).withColumn("qb", block(q_blocks)).withColumn("vb", every(n_blocks))
    lists = rows.withColumn("vb", block(n_blocks)).withColumn("qb", every(q_blocks))
    keys = ("qb", "vb", "dims")
    met = queries.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInArrow(_meet(k), "query_id long, vec_id long, score long, copies int")
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))  # at most k
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
