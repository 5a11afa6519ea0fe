"""Exact top-k by inner product: threshold algorithm over sorted per-dimension lists.

Components become floor(256 * x). Vectors and queries are dealt into blocks of bounded size; every
query block meets every vector block once. In a block each dimension's list is sorted once; for a
query the lists are read from the end its sign prefers, in steps that double the depth, every
vector met is scored whole by random access, and reading stops when the sum of what the lists hold
at the depth reached, the bound for all vectors not met, is below the k-th score. The blocks' best
are merged by a ranked window.

Vectors that are null or empty or hold null or non-finite components take no part, nor do rows with
a null id; vectors of another length than the query's are no candidates. Scores of 2^62 or more raise an error. Rows with the same id and
vector are one row. Ties go to the smaller id. Empty tables give an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import arrow_schema

SCALE = 256
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048
#: Below this bound no sum of products can pass 64 bits.
SAFE = 1 << 62
#: At least so many vector blocks, so that small tables spread too.
LEAST_BLOCKS = 24

SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): whole-number vectors of the rows that take part."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0").where(~odd)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("v")).dropDuplicates()


class Lists:
    """A block's vectors and its sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.most = int(np.abs(self.vectors).max(initial=0))
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.order, 0)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, the query's own row apart."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = (self.ids == query_id) & (self.vectors == q).all(1)
        at, scores = np.zeros(0, int), np.zeros(0, np.int64)
        begin, depth = 0, max(k, n // (4 * max(1, len(q))))
        if self.most * int(np.abs(q).max(initial=0)) * len(q) >= SAFE:
            # sums along the lists may pass 64 bits, so no bound is taken; a score that does so has no place in the result
            if np.abs(self.vectors.astype("float64") @ q.astype("float64")).max(initial=0) >= SAFE:
                raise OverflowError(f"scores of vector {query_id} pass 64 bits")
            depth = n
        while True:
            depth = min(n, depth)
            met = np.zeros(n, bool)
            met[self.order[n - depth : n - begin, up].ravel()] = True
            met[self.order[begin:depth, down].ravel()] = True
            if depth == n:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            at, scores = np.r_[at, new], np.r_[scores, self.vectors[new] @ q]
            if len(at) > k:
                # rows are in order of id, so the position breaks ties
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                best = np.flatnonzero(scores >= least)
                best = best[np.lexsort((at[best], -scores[best]))[:k]]
                at, scores = at[best], scores[best]
            if depth == n or seen.all():
                break
            bound = self.sorted[n - depth, up] @ q[up] + self.sorted[depth - 1, down] @ q[down]
            if len(at) == k and bound < scores.min():
                break
            begin, depth = depth, depth * 2
        return self.ids[at], scores


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["vec_id"].to_numpy()
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best rows of vectors, its own row apart."""
    v, q = valid_vectors(vectors), valid_vectors(queries)
    n_blocks = max(LEAST_BLOCKS, -(-v.count() // BLOCK_VECTORS))
    q_blocks = max(1, -(-q.count() // BLOCK_QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("dims", F.size("v")).withColumn("vb", block(n_blocks)).withColumn("qb", every(q_blocks))
    q = q.withColumn("dims", F.size("v")).withColumn("qb", block(q_blocks)).withColumn("vb", every(n_blocks))
    schema = arrow_schema(SCHEMA)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            lists = Lists(*matrix(left))
            for qid, x in zip(*matrix(right), strict=True):
                ids, scores = lists.top(qid, x, k)
                out.append((np.full(len(ids), qid), ids, scores))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    ship(vectors.sparkSession)
    keys = ("vb", "qb", "dims")
    found = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(search, SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
