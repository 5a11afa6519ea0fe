"""Near duplicates by arrival (D7, D8): new documents meet the bands of those that stayed, and a stored index of them.

A newcomer that surely loses to a document that stayed meets no other newcomer: what comes after it is void. So a
group of copies is met by its first members, and later ones by those that stayed of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stash
from .dedup import BROADCAST_IDS, lsh_candidates, rows_of, set_bands, shared_bands, similar
from .governance import judged_pairs, settled

THRESHOLD = 0.9
#: Arrivals are taken in stretches, each so many times as long as all before it; the first has about so many documents.
FIRST, GROWTH = 1024, 8
BUCKETS = 64
#: Bands of a document, about; by them its bands are dealt to tasks.
BANDS_EACH = 64


def meet(bands: DataFrame, old_bands: DataFrame | None, texts: DataFrame, dates: DataFrame, own: str | None, threshold: float) -> DataFrame:
    """(a, b, outcome, loser) of new documents among themselves and against old ones, all there before them, by their bands (doc_id,
    band; none without old ones), with the texts (doc_id, text) and dates of both; `own`: a field of the id that two documents of a pair may not share."""
    apart = (lambda df: df.where(F.col("a")[own] != F.col("b")[own])) if own else (lambda df: df)
    if old_bands is None:
        # nothing is there before them
        return settled(judged_pairs(similar(stash(apart(lsh_candidates(bands, n=bands.count()))), texts, threshold), texts, dates))
    first = similar(stash(apart(lsh_candidates(bands, old_bands))), texts, threshold)
    met = judged_pairs(first, texts, dates)
    threatened = met.where("loser = a").select("a").distinct()
    gone = met.where("loser = b").join(threatened, "a", "left_anti").select(F.col("b").alias("doc_id")).distinct()
    second = similar(stash(apart(lsh_candidates(bands.join(gone, "doc_id", "left_anti")))), texts, threshold)
    return settled(met.unionByName(judged_pairs(second, texts, dates)))


def bands_of(texts: DataFrame, threshold: float, only: DataFrame | None) -> DataFrame:
    """The bands of texts, or of those among `only`. Most are, so the others are told, if there are not too many of them, and no band is shuffled for it."""
    if only is None:
        return set_bands(texts, threshold)
    others = stash(texts.select("doc_id").join(only, "doc_id", "left_anti"))
    if others.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return set_bands(texts, threshold).join(only, "doc_id", "left_semi")
    return set_bands(texts.where("doc_id is not null").join(F.broadcast(others), "doc_id", "left_anti"), threshold)


def arrival_key(ids: DataFrame, own: str | None) -> tuple[Column, T.DataType | None]:
    """What stretches are told by, and its type: the id, or the field `own` of it, if that comes first in the order of ids."""
    kind = ids.schema["doc_id"].dataType
    if not isinstance(kind, T.StructType):
        return F.col("doc_id"), kind
    first = kind.fields[0]
    return F.col("doc_id")[first.name], first.dataType if first.name == own else None


def arrivals(texts: DataFrame, dates: DataFrame, own: str | None = None, threshold: float = THRESHOLD, only: DataFrame | None = None) -> DataFrame:
    """(a, b, outcome, loser) of documents (doc_id, text), or only of those among `only` (doc_id), in the order of their ids, as
    resolve_near_dups gives for all pairs, in stretches of growing length: those that stay of a stretch are the old documents of the next.
    Texts are read twice, for their bands and for those few that share a band with another, which are stored; they are never shuffled but
    for pairs. Of all bands, only those that are shared are stored."""
    ids = texts.select("doc_id") if only is None else only
    n = ids.count()
    bands = shared_bands(bands_of(texts, threshold, only), n * BANDS_EACH, own)
    met = stash(bands.select("doc_id").distinct())
    texts, dates = rows_of(texts.select("doc_id", "text"), met), rows_of(dates.select("doc_id", "effective_date"), met)
    share = [1.0]
    while share[-1] * n > FIRST:
        share.append(share[-1] / GROWTH)
    at_key, kind = arrival_key(ids, own)
    ends = [r[0] for r in ids.select(F.explode(F.percentile_approx(at_key, sorted(share[1:]), 10000))).collect()] if len(share) > 1 and isinstance(kind, T.NumericType) else []
    parts, old_bands, at = [], None, F.lit(True)
    for end in [*ends, None]:
        mine = at & (at_key <= end) if end is not None else at
        parts.append(stash(meet(bands.where(mine), old_bands, texts, dates, own, threshold)))
        if end is not None:
            at = at_key > end
            lost = stash(reduce(DataFrame.unionByName, parts).where("loser is not null").select(F.col("loser").alias("doc_id")).distinct())
            old_bands = bands.where(at_key <= end).join(lost, "doc_id", "left_anti")
    return reduce(DataFrame.unionByName, parts)


class NearIndex:
    """Documents, the bands in buckets of those that stayed of a batch, and those that went, as Parquet in one folder, by batch.

    A batch reads only the buckets its own bands fall into. It writes under its own number and reads only what earlier
    batches wrote, so a batch that runs again, after it was lost half way or finished, leaves the same files."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, own: str | None = None) -> None:
        self.spark, self.path, self.buckets, self.own = spark, path.rstrip("/"), buckets, own

    def part(self, kind: str, batch: int, like: DataFrame) -> DataFrame:
        """What batches before this one wrote of a kind."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return like.where("false")
        schema = T.StructType([*like.schema.fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}").where(F.col("batch") < batch).select(*like.columns)

    def write(self, kind: str, batch: int, df: DataFrame) -> None:
        out = df.repartition("bucket").write.partitionBy("bucket") if "bucket" in df.columns else df.write
        out.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def add(self, batch: int, texts: DataFrame, dates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """(a, b, outcome, loser) of a batch of documents (doc_id, text) whose ids come after all stored ones. The batch is stored and
        read back, so that its texts are worked out once; those that lose, of it or of earlier ones, are noted."""
        told = texts.select("doc_id", "text").join(dates.select("doc_id", "effective_date"), "doc_id", "left")
        self.write("documents", batch, told)
        new = self.spark.read.schema(told.schema).parquet(f"{self.path}/documents/batch={batch}")
        bands = stash(set_bands(new, threshold).withColumn("bucket", F.pmod("band", F.lit(self.buckets)).cast("int")))
        went = self.part("lost", batch, new.select("doc_id"))
        # at most as many numbers as there are buckets
        touched = [r.bucket for r in bands.select("bucket").distinct().collect()]
        near = self.part("bands", batch, bands).where(F.col("bucket").isin(touched)).join(bands.select("band").distinct(), "band", "left_semi")
        near = stash(near.join(went, "doc_id", "left_anti"))
        old_bands = near.drop("bucket") if near.limit(1).count() else None
        both = self.part("documents", batch, new).unionByName(new)
        rows = stash(meet(bands.drop("bucket"), old_bands, both.select("doc_id", "text"), both.select("doc_id", "effective_date"), self.own, threshold))
        lost = rows.where("loser is not null").select(F.col("loser").alias("doc_id")).distinct()
        self.write("bands", batch, bands.join(lost, "doc_id", "left_anti"))
        self.write("lost", batch, lost)
        return rows
