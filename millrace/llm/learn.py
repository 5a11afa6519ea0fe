"""Bounded samples of labelled rows for the models trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Resolution of the hash that draws a sample.
GRAIN = 1_000_000


def in_sample(doc_id: Column, rows: int, total: int, salt: int) -> Column:
    """Draws about `rows` of `total` ids, the same ones each time."""
    part = min(GRAIN, -(-rows * GRAIN // max(total, 1)))
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(GRAIN)) < part


def is_held_out(doc_id: Column) -> Column:
    """The fifth of the ids whose labels no model may see."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """Labels without nulls, one for each id: the largest where an id has several."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias(name)).dropna().groupBy("doc_id").agg(F.max(name).alias(name))
