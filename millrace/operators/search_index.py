"""Stored search structures and searches over them: BM25 postings, vectors, and both fused under one filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once, words_of
from ..session import ship, stash
from .retrieval import BROADCAST_TERMS, K1, B, Best, rrf_fuse, top

BUCKETS = 32
#: Texts are dealt to so many tasks at least, and to more where one would get more documents, about, than that. A task writes the postings
#: of its documents, one file for each bucket, so none writes all of a frequent term.
SPREAD, DOCS_A_TASK = 8, 8192
#: Documents, about, whose scores one task sums up.
DOCS_AT_ONCE = 8192
#: Queries that are multiplied at once, and the most numbers in a table of queries that all tasks get; more are taken in turn.
QUERY_BLOCK, QUERY_NUMBERS = 256, 1 << 21


def counted(words: Column) -> Column:
    """(term, tf) of each distinct word of an array, counted within the row: no task holds the words of many documents."""
    begins = lambda w: F.filter(F.transform(w, lambda x, i: F.when(~x.eqNullSafe(F.get(w, i - 1)), i)), lambda i: i.isNotNull())
    counts = lambda w, at: F.transform(at, lambda i, j: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(w)) - i).cast("long").alias("tf")))
    return once(F.sort_array(words), lambda w: once(begins(w), lambda at: counts(w, at)))


def postings_of(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, columns, len, term, tf) of docs (doc_id, text, columns). Only rows of an id that is there more than once are grouped, as
    they count as one document if their length and columns are equal."""
    words = lambda rows: rows.select("doc_id", *columns, words_of(F.col("text")).alias("w")).select("doc_id", *columns, F.size("w").alias("len"), F.inline(counted(F.col("w"))))
    again = stash(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    if again.isEmpty():
        return words(docs)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    merged = words(docs.join(again, same, "left_semi")).groupBy("doc_id", *columns, "len", "term").agg(F.sum("tf").alias("tf"))
    return words(docs.join(again, same, "left_anti")).unionByName(merged)


class TextIndex:
    """Postings (term, doc_id, tf, len, and the documents' columns to filter by), term frequencies, and one row of statistics,
    as Parquet in one folder. Postings and frequencies are partitioned by a bucket of the term and sorted by it, so a search reads
    only the buckets of its terms, and filters reach the scan."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def build(self, docs: DataFrame, *columns: str) -> TextIndex:
        """Indexes docs (doc_id, text, and columns to filter by) in one pass over the texts, which are shuffled instead of the far more
        numerous postings; the statistics come from the postings."""
        texts = docs.select("doc_id", "text", *columns).repartition(max(SPREAD, -(-docs.count() // DOCS_A_TASK)), "doc_id")
        placed = postings_of(texts, *columns).select("term", "doc_id", "len", *columns, "tf", self.bucket()).sortWithinPartitions("bucket", "term")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        df = self.table("postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
        df.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/frequencies")
        # a document's shares tf / len make one, so their sum is the number of documents with words
        n = F.round(F.sum(F.col("tf") / F.col("len"))).cast("long")
        stats = self.table("postings").agg(F.coalesce(n, F.lit(0)).alias("n"), F.sum("tf").alias("total"))
        stats = stats.select("n", (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("avg_len"))
        stats.write.mode("overwrite").parquet(f"{self.path}/statistics")
        return self

    def search(self, queries: DataFrame, k: int = 20, where: Column | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) for queries (query_id, text): the k best documents that meet the condition by BM25,
        whose statistics are those of all documents."""
        asked = stash(queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).select("*", self.bucket()))
        terms = asked.select("term", "bucket").distinct()
        # at most as many numbers as there are buckets
        touched = [r.bucket for r in asked.select("bucket").distinct().collect()]
        here = lambda name: self.table(name).where(F.col("bucket").isin(touched))
        postings = here("postings") if where is None else here("postings").where(where)
        few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        small = F.broadcast if few else (lambda x: x)
        known = stash(here("frequencies").join(small(terms), ["bucket", "term"]))
        weighed = known.crossJoin(F.broadcast(self.table("statistics")))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = weighed.select("bucket", "term", idf.alias("idf"), "avg_len")
        met = postings.select("bucket", "term", "doc_id", "tf", "len").join(small(weights), ["bucket", "term"])
        tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        met = met.select("term", "doc_id", (F.col("idf") * tf).alias("part"))
        if few:
            # postings are shuffled by document, before each of them is taken for every query that has its term, and not again
            n = (self.table("statistics").first() or [0])[0]
            met = met.repartition(max(self.spark.sparkContext.defaultParallelism, n // DOCS_AT_ONCE), "doc_id")
        hits = met.join(small(asked.select("query_id", "term")), "term")
        scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
        return top(scored, "query_id", k, F.desc("score"), "doc_id")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def dense_top(queries: DataFrame, vectors: DataFrame, k: int = 20, by: str | None = None, where: Column | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): of each query (query_id, q) the k vectors (vec_id, embedding) of the highest cosine, rounded to
    6 places, its own id apart; only those that meet the condition, and with `by` only those that have the query's value of
    that column. Vectors that are null or zero, or of another length, take no part.

    Queries pass through the driver in parts of bounded size; with each the vectors are read once, multiplied batch by batch, and a
    task returns only its k best of a query."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors if where is None else vectors.where(where)
    rows = rows.select(F.col("vec_id").cast("long"), "embedding", *([F.col(by).cast("string").alias("by")] if by else [])).where("vec_id is not null and size(embedding) > 0")
    asked = stash(queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>").alias("q"), *([F.col(by).cast("string").alias("by")] if by else [])).where("query_id is not null and size(q) > 0"))
    dims, out = asked.agg(F.max(F.size("q"))).first()[0], None
    n_parts = -(-asked.count() * (dims or 1) // QUERY_NUMBERS)
    for part in range(max(1, n_parts)):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, n_parts))) == part).toArrow().sort_by("query_id").combine_chunks()
        found = rows.mapInArrow(nearest(mine, k, by is not None), "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    return top(out, "query_id", k, F.desc("score"), "vec_id")


def nearest(queries: pa.Table, k: int, by: bool):
    """The function that gives the k best vectors of a task's batches for each query."""
    blocks: list[tuple] = []
    lengths = pc.list_value_length(queries["q"]).to_numpy() if len(queries) else np.zeros(0, int)
    for dims in np.unique(lengths):
        same = queries.filter(pa.array(lengths == dims))
        for at in range(0, len(same), QUERY_BLOCK):
            part = same.slice(at, QUERY_BLOCK).combine_chunks()
            q = matrix(part["q"].chunk(0))
            size = np.linalg.norm(q, axis=1)
            good = np.isfinite(size) & (size > 0)
            names = np.array(part["by"].to_pylist(), object)[good] if by else None
            blocks.append((int(dims), part["query_id"].to_numpy()[good], q[good] / size[good, None], names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(ids), k) for _, ids, _, _ in blocks]
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            for dims in np.unique(sizes):
                some = batch.filter(pa.array(sizes == dims))
                v = matrix(some.column(1))
                size = np.linalg.norm(v, axis=1)
                good = np.isfinite(size) & (size > 0)
                v, ids = v[good] / size[good, None], some.column(0).to_numpy()[good]
                names = np.array(some.column(2).to_pylist(), object)[good] if by else None
                for held, (length, asked, q, own) in zip(best, blocks, strict=True):
                    if length != dims:
                        continue
                    scores = np.floor(q @ v.T * 1e6 + 0.5) / 1e6
                    may = (scores >= held.bound[:, None]) & (asked[:, None] != ids[None, :])
                    if by:
                        may &= own[:, None] == names[None, :]
                    at, x = np.nonzero(may)
                    held.add(at, ids[x], scores[at, x])
        for held, (_, asked, _, _) in zip(best, blocks, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(asked[held.at]), pa.array(held.ids), pa.array(held.scores)], ["query_id", "vec_id", "score"])

    return run


def hybrid_search(queries: DataFrame, index: TextIndex, vectors: DataFrame, where: Column | None = None, k: int = 20, n: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the n best of queries (query_id, text, q) by reciprocal rank fusion of BM25 and cosine.
    The condition reaches both searches before they rank, as a filter of the scans of postings and vectors (doc_id, embedding, ..)."""
    dense = dense_top(queries.select("query_id", "q"), vectors.withColumnRenamed("doc_id", "vec_id"), k, where=where)
    return rrf_fuse([index.search(queries, k, where), dense.withColumnRenamed("vec_id", "doc_id")], n=n)
