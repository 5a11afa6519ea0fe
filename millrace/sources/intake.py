"""Files as tables: intake, text documents, evaluation reports and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_jsonl

#: Kinds of files by extension.
KINDS = {
    "TEXT": ("txt", "md", "markdown"),
    "PDF": ("pdf",),
    "OFFICE_OOXML": ("docx", "xlsx"),
    "OFFICE_LEGACY": ("doc", "xls"),
    "IMAGE": ("png", "jpg", "jpeg", "tif", "tiff", "bmp"),
    "AUDIO": ("mp3", "wav", "m4a", "aac", "flac", "ogg"),
}
#: The scores a report holds for each sample and for the whole run.
SCORES = ("faithfulness", "answer_relevancy", "context_precision_without_reference", "context_recall", "factual_correctness", "semantic_similarity")


class IntakeError(ValueError):
    """A corpus that cannot be used."""


def scan_files(spark: SparkSession, path: str, kinds: dict[str, tuple[str, ...]] | None = None, max_mb: int = 200) -> DataFrame:
    """(path, extension, kind, size, sha256, reason) of the files under a folder. Files of unknown extension and too large
    ones keep a row with the reason and are not read. Spark's file source lists no empty files, so these have no row."""
    kinds = KINDS if kinds is None else kinds
    by_ext = F.create_map(*(F.lit(x) for k, exts in kinds.items() for e in exts for x in (e, k)))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    found = found.withColumn("extension", ext).withColumn("kind", by_ext[F.col("extension")])
    limit = max(1, max_mb) * 1024 * 1024
    reason = F.when(F.col("kind").isNull(), "unsupported").when(F.col("size") > limit, "too large")
    # bodies are read only of files that may be taken, whatever lies beside them
    bodies = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= limit)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin([e for exts in kinds.values() for e in exts])
    digests = bodies.where(wanted).select("path", F.sha2("content", 256).alias("sha256"))
    return found.withColumn("reason", reason).join(digests, "path", "left").select("path", "extension", "kind", "size", "sha256", "reason")


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each text file under a folder as one document; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*KINDS["TEXT"]))
    return named.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, domain, content) of JSON lines; an error where a field is missing, a domain has one chunk only, or there is none."""
    rows = read_jsonl(spark, path, "id string, domain string, content string")
    blank = F.coalesce(F.least(*(F.length(F.coalesce(c, F.lit(""))) for c in ("id", "domain", "content"))), F.lit(0)) == 0
    domains = rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(blank).alias("blank"))
    state = domains.agg(F.count("*").alias("domains"), F.sum("blank").alias("blank"), F.count_if(F.col("n") < 2).alias("thin")).first()
    if not state["domains"]:
        raise IntakeError("the corpus is empty")
    if state["blank"]:
        raise IntakeError(f"{state['blank']} rows lack id, domain or content")
    if state["thin"]:
        raise IntakeError(f"{state['thin']} domains have fewer than two chunks")
    return rows


def _text(name: str, default: str | None = None) -> Column:
    return F.coalesce(name, F.lit(default)) if default is not None else F.col(name)


def load_eval_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One row for each run and rows of its samples from reports, one JSON document a file; absent fields take their defaults,
    tags are joined by commas and cut at 512 characters."""
    score = ", ".join(f"{n}: double" for n in SCORES)
    value = ", ".join(f"{n}: struct<value: double>" for n in SCORES)
    sample = (
        "id: string, domain: string, source: string, difficulty: string, reviewStatus: string, answerOrigin: string, tags: array<string>, "
        f"question: string, contexts: array<string>, answer: string, reference: string, scores: struct<{score}>, errors: map<string,string>"
    )
    tool = "judgeModel: string, embeddingModel: string, endpoint: string"
    schema = f"runId string, status string, reason string, sampleCount int, durationSec double, tool struct<{tool}>, metrics struct<{value}>, samples array<struct<{sample}>>"
    reports = spark.read.schema(schema).json(path, multiLine=True)
    numbers = lambda at, of="": [F.col(f"{at}.{n}{of}").alias(n) for n in SCORES]
    runs = reports.select(
        "runId", _text("status", "ERROR").alias("status"), _text("reason").alias("reason"), F.coalesce("sampleCount", F.lit(0)).alias("sampleCount"),
        "durationSec", _text("tool.judgeModel").alias("judgeModel"), _text("tool.embeddingModel").alias("embeddingModel"), _text("tool.endpoint").alias("endpoint"), *numbers("metrics", ".value"),
    )
    rows = reports.select("runId", F.explode("samples").alias("s")).select("runId", "s.*")
    defaults = {"source": "seed-manual", "difficulty": "simple", "reviewStatus": "approved", "answerOrigin": "manual", "question": "", "answer": "", "reference": ""}
    tags = F.when(F.size("tags") > 0, F.left(F.array_join("tags", ","), F.lit(512)))
    errors = F.when(F.size("errors") > 0, F.to_json("errors"))
    named = [_text(c, d).alias(c) for c, d in defaults.items()]
    return runs, rows.select("runId", _text("id", "unknown").alias("id"), _text("domain").alias("domain"), *named, tags.alias("tags"), F.to_json("contexts").alias("contexts"), errors.alias("errors"), *numbers("scores"))
