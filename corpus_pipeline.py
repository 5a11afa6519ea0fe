"""A corpus pipeline of five training-data operators, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from millrace.session import stash

#: Chunks that a worker remembers while it encodes; the workers also hold what the other stages left in them.
TOKEN_CHUNKS = 60_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rest = [c for c in COLUMNS if c != "text"]
    graded = toxicity.with_severity(docs, model, rest, carry_text=True)
    return graded.where(~F.col("toxic")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier place has; n_chars follows the text."""
    found = line_dedup.delete_repeats(docs)
    return found.withColumn("n_chars", F.when(F.col("_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five words, similarity of 0.8 or more."""
    groups = ngram_join.ngram_components(docs, width=5, percent=80)
    later = groups.where("n_shingles > 0 and doc_id != component_id").select("doc_id").distinct()
    return docs.join(later.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens, and digests of the ids and of the text decoded from them."""
    return bpe.encode_digests(docs, kept=TOKEN_CHUNKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]

#: A trained model and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
