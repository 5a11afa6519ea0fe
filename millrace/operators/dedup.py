"""Duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash, shingles
from ..session import cut, dealt, ship, stash

SLOTS, BANDS = 128, 32


def exact_dedup(chunks: DataFrame, dates: DataFrame) -> DataFrame:
    """(doc_id, idx, content_hash, active): of documents with equal chunks one keeps them. The first to
    arrive does if it has no date; else the latest date does, the earliest arrival among equals."""
    rows = chunks.select("doc_id", "idx", content_hash(F.col("content")).alias("content_hash")).join(dates.select("doc_id", "effective_date"), "doc_id", "left")
    by_doc = rows.groupBy("content_hash", "doc_id").agg(F.max("effective_date").alias("d"))
    # struct order: an undated first arrival wins, then the later date, then the smaller id
    best = by_doc.groupBy("content_hash").agg(F.min(F.struct("doc_id", "d")).alias("first"), F.max(F.when(F.col("d").isNotNull(), F.struct("d", (-F.col("doc_id")).alias("i")))).alias("last"))
    winner = best.select("content_hash", F.when(F.col("first.d").isNull(), F.col("first.doc_id")).otherwise(-F.col("last.i")).alias("winner"))
    return rows.join(winner, "content_hash").select("doc_id", "idx", "content_hash", (F.col("doc_id") == F.col("winner")).alias("active"))


#: Hashes whose minima are taken at once.
HASHES_AT_ONCE = 1 << 18


def slot_seeds() -> np.ndarray:
    """An odd number for each slot, by a rule."""
    return (np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(lists: pa.ListArray) -> pa.Array:
    """For each list of hashes its least seeded hash in every slot; no list is empty."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    out, seeds, at = np.empty((len(lists), SLOTS), np.int64), slot_seeds(), 0
    while at < len(lists):
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + HASHES_AT_ONCE, "right")))
        part, starts = flat[begin : ends[to - 1]], np.concatenate(([0], ends[at : to - 1] - begin)).astype(np.int64)
        for i, seed in enumerate(seeds):
            h = (part ^ seed) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= seed
            out[at:to, i] = np.minimum.reduceat(h, starts).view(np.int64)
        at = to
    return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), SLOTS).cast(pa.list_(pa.int64()))


def minhash(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes, signature): hashed shingles and 128 minima over seeded hashes of them; documents without shingles have none.
    Stored, since bands and sets are read from it. The minima are taken in NumPy, a batch of documents at a time: as a lambda
    within a lambda they took some forty times as long."""
    ship(docs.sparkSession)
    sets = docs.select("doc_id", hashed(F.col("text")).alias("hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
            yield pa.RecordBatch.from_arrays([*some.columns, signatures(some.column(1))], ["doc_id", "hashes", "signature"])

    kinds = {f.name: f.dataType for f in sets.schema.fields}
    schema = T.StructType([T.StructField("doc_id", kinds["doc_id"]), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("signature", T.ArrayType(T.LongType()))])
    return stash(sets.mapInArrow(run, schema))


def band_hashes(signature: Column) -> Column:
    rows = SLOTS // BANDS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice(signature, b * rows + 1, rows)))


def banded(signed: DataFrame) -> DataFrame:
    """(doc_id, band): the 32 bands of each stored signature."""
    return signed.select("doc_id", F.explode(band_hashes(F.col("signature"))).alias("band"))


def lsh_candidates(bands: DataFrame, older: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(a, b): documents (doc_id, band) that share a band, a before b; or, with bands of older documents, one of each. n: how many
    bands there are, about, if that is known; then tasks are made by it."""
    b = bands.select(F.col("doc_id").alias("b"), "band")
    if older is not None:
        return older.select(F.col("doc_id").alias("a"), "band").join(b, "band").select("a", "b").distinct()
    a = shared_bands(bands, n).withColumnRenamed("doc_id", "a")
    return a.join(a.withColumnRenamed("a", "b"), "band").where("a < b").select("a", "b").distinct()


def shared_bands(bands: DataFrame, n: int | None = None, own: str | None = None) -> DataFrame:
    """The bands (doc_id, band) that two documents or more have, stored; with `own`, a field of the id, two that differ in it. Most bands
    are nobody else's: they go before they meet anything, in the one shuffle that all bands take."""
    same = Window.partitionBy("band")
    held = F.count("*").over(same) > 1 if own is None else F.min(F.col("doc_id")[own]).over(same) < F.max(F.col("doc_id")[own]).over(same)
    bands = bands if n is None else dealt(bands, n, "band")
    return stash(bands.select("doc_id", "band", held.alias("held")).where("held").drop("held"))


def size_classes(most: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest size of each class of set sizes, up to `most`, and how many parts sets are cut into to meet a smaller one of
    that class: one more than there can be elements that only one of two similar sets has, so that some part is equal in both."""
    ends = [int(1 / threshold + 1e-9)]
    while ends[-1] < most:
        ends.append(int((ends[-1] + 1) / threshold + 1e-9))
    last = np.array(ends)
    apart = (1 - threshold) / (1 + threshold) * (last + np.floor(last / threshold + 1e-9))
    return last, np.floor(apart + 1e-9).astype(np.int64) + 1


def part_keys(lists: pa.ListArray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): keys of the parts of each set of hashes, cut for its own class of sizes and for the one below. Two sets at or above the
    threshold always share a key, since the larger is of the smaller one's class or of the next."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends, counts = size_classes(int(sizes.max(initial=1)), threshold)
    own, row = np.searchsorted(ends, sizes), np.repeat(np.arange(len(sizes)), sizes)
    place, value, half = spread_bits(flat) >> np.uint64(32), spread_bits(~flat), np.uint64(32)
    rows, keys = [], []
    for kind in (own, own - 1):
        n = np.where((kind >= 0) & (sizes > 0), counts[kind], 0)
        begins, some = np.cumsum(n) - n, n[row] > 0
        at = begins[row[some]] + ((place[some] * n[row[some]].astype(np.uint64)) >> half).astype(np.int64)
        sums = np.zeros(n.sum(), np.uint64)
        np.add.at(sums, at, value[some])
        of = np.repeat(np.arange(len(n)), n)
        part = (kind[of].astype(np.uint64) << half) | (np.arange(len(of)) - begins[of]).astype(np.uint64)
        rows.append(of)
        keys.append(spread_bits(sums ^ spread_bits(part)).view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def spread_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)


def hashed(text: Column) -> Column:
    return F.transform(shingles(text), lambda s: F.xxhash64(s))


def set_bands(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, band): the part_keys of the shingle sets of documents (doc_id, text); some 0.1 to 0.25 of a set's size, by threshold 0.9."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = part_keys(batch.column(1), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key)], ["doc_id", "band"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("band", T.LongType())])
    return docs.select("doc_id", hashed(F.col("text")).alias("hashes")).where(F.size("hashes") > 0).mapInArrow(run, schema)


#: Ids of up to so many rows (some 16 bytes each) are broadcast to pick rows; of more, one part after the other, up to so many parts.
BROADCAST_IDS, ID_PARTS = 300_000, 8


def rows_of(rows: DataFrame, ids: DataFrame, made: list[Column] | None = None) -> DataFrame:
    """The rows (doc_id, ..) of stored ids, or columns made of them, stored. What is not picked is read, but neither made nor shuffled,
    unless there are too many ids."""
    parts = max(1, -(-ids.count() // BROADCAST_IDS))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    some = [ids] if parts > ID_PARTS else [F.broadcast(ids if parts == 1 else ids.where(part == i)) for i in range(parts)]
    return reduce(DataFrame.unionByName, [stash(picked.select(*made) if made else picked) for picked in (rows.join(x, "doc_id", "left_semi") for x in some)])


def of_pairs(rows: DataFrame, pairs: DataFrame, *ends: str, made: list[Column] | None = None) -> DataFrame:
    """The rows (doc_id, ..) of what stands at the ends of pairs, as rows_of gives them: few of many."""
    return rows_of(rows, stash(pairs.select(F.explode(F.array(*ends)).alias("doc_id")).distinct()), made)


def similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of stored pairs whose shingle sets are at least so similar. The sets are made anew, from the texts (doc_id, text) of
    pairs only: all sets together take more room than the texts."""
    sets = of_pairs(texts.select("doc_id", "text"), pairs, "a", "b", made=[F.col("doc_id"), hashed(F.col("text")).alias("hashes")])
    side = lambda key, name: sets.select(F.col("doc_id").alias(key), F.col("hashes").alias(name))
    rows = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    rows = rows.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
    return rows.where(F.col("similarity") >= threshold)


def near_dup_pairs(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(a, b, similarity): pairs between representatives of different shingle sets at or above the threshold, every one.
    Documents with equal sets are collapsed first; near_dup_members says whom each representative stands for."""
    members = near_dup_members(docs)
    chosen = cut(members.select(F.col("representative").alias("doc_id")).distinct())
    pairs = cut(lsh_candidates(set_bands(docs, threshold).join(chosen, "doc_id", "left_semi")))
    return similar(pairs, docs, threshold).select("a", "b", F.round("similarity", 6).alias("similarity"))


def near_dup_members(docs: DataFrame) -> DataFrame:
    """(doc_id, representative): the smallest document with an equal shingle set, itself included."""
    keyed = docs.select("doc_id", F.array_sort(shingles(F.col("text"))).alias("s")).where(F.size("s") > 0)
    keyed = keyed.select("doc_id", F.sha2(F.array_join("s", " "), 256).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("representative")), "key").select("doc_id", "representative")


def all_near_dup_pairs(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(a, b, similarity) with a < b: all pairs of documents at or above the threshold, those with equal sets included."""
    members = cut(near_dup_members(docs))
    x, y = (members.select(F.col("representative").alias(r), F.col("doc_id").alias(d)) for r, d in (("a", "x"), ("b", "y")))
    across = near_dup_pairs(docs, threshold).join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    within = x.join(y.withColumnRenamed("b", "a"), "a").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def event_counts(events: DataFrame, kinds: list[str], column: str = "event_type") -> DataFrame:
    """Counts of a closed list of kinds, zeros included."""
    known = events.sparkSession.createDataFrame([(k,) for k in kinds], f"{column} string")
    return known.join(events.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def latest_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def placed_by(df: DataFrame, keys: list[str], *order, most: int | None = None) -> DataFrame:
    """All rows with their place among those of equal keys, from 1; only the first `most` if given."""
    rows = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows if most is None else rows.where(F.col("place") <= most)
