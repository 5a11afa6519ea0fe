"""Ingest of a stream of documents into a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks as C
from ..operators.near_index import NearIndex
from ..session import stash


class Library:
    """Chunks, outcomes and seen texts of documents in one folder, each batch under its own number.

    A batch reads only what batches before it wrote and overwrites what it wrote itself before, so one that was lost half way,
    or runs again, leaves the same tables; a document that an earlier batch took in is skipped."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        """The rows of a table (chunks, outcomes, seen or gone), of batches before one, if given; None if it is not there yet."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def write(self, name: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def chunks(self) -> DataFrame | None:
        """The chunks that are active now."""
        made, gone = self.read("chunks"), self.read("gone")
        return made if made is None else made.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")

    def add(self, docs: DataFrame, batch: int) -> None:
        """Takes in documents (doc_id, version, text, and effective_date if there are dates), as chunks.ingest does all at once.
        Of one document the highest version of the batch counts."""
        held = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("*"), "version").alias("d")).select("d.*")
        held = stash(held)
        past = self.read("outcomes", batch)
        active = held.select("doc_id").where("false") if past is None else past.where("outcome in ('INGESTED', 'MERGED')").select("doc_id")
        chunks, state = C.new_chunks(held, active, held if "effective_date" in held.columns else None)
        seen = self.read("seen", batch)
        winners = stash(C.first_copies(chunks, None if seen is None else seen.drop("batch")))
        kept = stash(chunks.join(winners.select("place"), "place", "left_semi"))
        self.write("seen", batch, kept.select("content_hash", "place", "effective_date"))
        # a stored copy that a later date beats
        beaten = None if seen is None else seen.join(winners.withColumnRenamed("place", "winner"), "content_hash").where("place != winner").select("place")
        rows = NearIndex(self.spark, f"{self.path}/near", own="doc_id").add(batch, *C.as_texts(kept))
        lost = C.near_losers(rows)
        kept = stash(kept.join(lost, "place", "left_anti"))
        self.write("chunks", batch, kept.drop("place"))
        gone = lost if beaten is None else lost.unionByName(beaten).distinct()
        self.write("gone", batch, gone.select(C.chunk_id(*(F.col(f"place.{c}") for c in C.PLACE)).alias("chunk_id")))
        # what says that the batch is done comes last
        self.write("outcomes", batch, C.outcomes(state, kept))


def stream_ingest(docs: DataFrame, library: Library, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts taking a stream of documents (doc_id, version, text) into the library, batch by batch."""
    writer = docs.writeStream.foreachBatch(library.add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def text_stream(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """New JSON files of documents in a folder as a stream, so many files a batch."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("version", T.LongType()), T.StructField("text", T.StringType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)
