"""Table scans, JSON lines and the upsert sink (A1-A3, A8), and the engine tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, base: str, name: str, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet scan; the predicate and the columns reach the files."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines without blank lines and rows that carry _comment; a missing path is an empty table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.get_json_object("value", "$._comment").isNull()).select(F.from_json("value", schema).alias("r")).select("r.*")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def merge_latest(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """target with updates inserted or put over rows of equal keys; of several updates the last in order counts."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(F.desc(c) for c in order))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def engine_documents(docs: DataFrame) -> DataFrame:
    """documents with an effective date: none for every fifth, else one of 90 days."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int"))
    return docs.withColumn("effective_date", F.when(F.col("doc_id") % 5 != 0, day))


def engine_chunks(docs: DataFrame) -> DataFrame:
    """The lines of documents as chunks, in order."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "content")).where("content != ''")


def engine_events(events: DataFrame) -> DataFrame:
    """events as usage events of chunks."""
    kind = F.create_map(*(F.lit(x) for p in (("view", "RETRIEVED"), ("click", "CITED"), ("purchase", "FEEDBACK_USEFUL"), ("error", "FEEDBACK_USELESS")) for x in p))
    return events.select("event_id", F.col("user_id").alias("chunk_id"), F.coalesce(kind[F.col("event_type")], F.lit("OTHER")).alias("event_type"), F.col("ts").alias("created_at"))


def engine_calls(lineitem: DataFrame) -> DataFrame:
    """lineitem as a log of model calls."""
    return lineitem.select(
        F.when(F.col("l_linestatus") == "O", "CHAT").otherwise("RERANK").alias("purpose"),
        F.when(F.col("l_returnflag") == "A", "FAILED").otherwise("OK").alias("status"),
        F.concat(F.lit("model-"), F.col("l_linenumber").cast("string")).alias("model"),
        (F.col("l_quantity") * 10).cast("long").alias("tokens_in"),
        F.col("l_quantity").cast("long").alias("tokens_out"),
        F.col("l_extendedprice").alias("latency_ms"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("created_at"),
    )
