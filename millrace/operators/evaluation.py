"""Golden sets, curation of samples, and rates over judged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import question_key

#: The metrics that a sample without a reference, or without contexts, cannot have.
NEED_REFERENCE = ("context_recall", "factual_correctness", "semantic_similarity")
NEED_CONTEXTS = ("faithfulness", "context_precision_without_reference", "context_recall")


def share(hit: Column, of: Column | None = None) -> Column:
    """Aggregate: the share of rows in `of` that hit; null where none is in it."""
    return F.round(F.avg(F.when(F.lit(True) if of is None else of, hit.cast("double"))), 6)


def answer_summary(samples: DataFrame) -> DataFrame:
    """One row: samples by status, and the rates of faithful, relevant and both, each over the judged rows that have it."""
    f, r, judged = F.col("faithful"), F.col("relevant"), F.col("status") == "JUDGED"
    count = lambda s: F.count_if(F.col("status") == s)
    return samples.agg(
        count("JUDGED").alias("judged"),
        count("PENDING").alias("pending"),
        count("FAILED").alias("failed"),
        share(f == 1, judged & f.isNotNull()).alias("faithful_rate"),
        share(r == 1, judged & r.isNotNull()).alias("relevant_rate"),
        share((f == 1) & (r == 1), judged & f.isNotNull() & r.isNotNull()).alias("both_rate"),
    )


def judge_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations (cite_id, doc_id, version, page, snippet) with resolvable and consistent: an active chunk of the document
    has the version, and one of its page (any, where the citation names none) contains the snippet."""
    on = chunks.where("active").select(F.col("doc_id"), F.col("version").alias("v"), F.col("page").alias("p"), "content")
    same = F.col("v") == F.col("version")
    holds = same & (F.col("page").isNull() | (F.col("p") == F.col("page"))) & F.contains("content", "snippet")
    seen = citations.join(on, "doc_id", "left").groupBy("cite_id")
    return seen.agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("resolvable"), F.coalesce(F.bool_or(holds), F.lit(False)).alias("consistent"))


def judge_error_rates(verdicts: DataFrame) -> DataFrame:
    """Long form (kind, rate, n): shares of verdicts with an error of fact and of structure."""
    long = verdicts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("hit")) for k, c in (("fact", "fact_error"), ("structure", "structure_error"))))).alias("r"))
    return long.groupBy("r.kind").agg(share(F.col("r.hit")).alias("rate"), F.count("*").alias("n"))


def human_edit_rate(reviews: DataFrame) -> DataFrame:
    """One row (rate, n): edited among the reviews that are disposed of."""
    return reviews.where(F.col("status").isin("APPROVED", "REJECTED", "EDITED")).agg(share(F.col("status") == "EDITED").alias("rate"), F.count("*").alias("n"))


def retrieval_golden(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """golden (query_id, doc_id, expected) against hits (query_id, doc_id): per query the expected documents found over
    expected, missing and forbidden ones, and whether it passed. A query that expects nothing scores 1."""
    found = golden.join(hits.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    want, hit = F.col("expected"), F.col("hit")
    rows = found.groupBy("query_id").agg(F.count_if(want).alias("expected"), F.count_if(want & hit).alias("found"), F.count_if(~want & hit).alias("forbidden"))
    score = F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(F.round(F.col("found") / F.col("expected"), 6))
    return rows.select("*", score.alias("score"), ((F.col("found") == F.col("expected")) & (F.col("forbidden") == 0)).alias("passed"))


def metric_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One long table (metric, sub_key, value, n) of one-row or long results; a column `kind`, if any, is the sub key."""
    out: DataFrame | None = None
    for name, df in parts.items():
        sub = F.col("kind") if "kind" in df.columns else F.lit("")
        value = F.col("rate") if "rate" in df.columns else F.col(df.columns[0])
        n = F.col("n") if "n" in df.columns else F.lit(None).cast("long")
        row = df.select(F.lit(name).alias("metric"), sub.alias("sub_key"), value.cast("double").alias("value"), n.cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def skipped_metrics(samples: DataFrame, key: str, has_reference: Column, has_contexts: Column) -> DataFrame:
    """(key, metric, reason): metrics that a sample cannot have; a missing reference is named first."""
    reasons = [F.when(~has_reference, F.struct(F.lit(m).alias("metric"), F.lit("reference").alias("reason"))) for m in NEED_REFERENCE]
    for m in NEED_CONTEXTS:
        free = has_reference if m in NEED_REFERENCE else F.lit(True)
        reasons.append(F.when(~has_contexts & free, F.struct(F.lit(m).alias("metric"), F.lit("contexts").alias("reason"))))
    return samples.select(key, F.explode(F.array_compact(F.array(*reasons))).alias("s")).select(key, "s.*")


def provenance_stats(samples: DataFrame, *keys: str) -> DataFrame:
    """(key, value, n): samples by each of the keys, counted in one pass."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))
    return samples.select(F.explode(pairs).alias("p")).groupBy("p.key", "p.value").agg(F.count("*").alias("n"))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two vectors; null where one of them has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def merge_candidates(existing: DataFrame, incoming: DataFrame, key: str = "id", status: str = "status", force: bool = False) -> DataFrame:
    """existing with new ids added, and outcome: kept, added, or replaced, which only force does and only to pending rows.
    Ids are unique on each side."""
    old = existing.select(F.struct(*existing.columns).alias("o"), F.col(key).alias("k"))
    new = incoming.select(F.struct(*existing.columns).alias("n"), F.col(key).alias("k"))
    over = F.lit(force) & (F.col(f"o.{status}") == "pending") & F.col("n").isNotNull()
    outcome = F.when(F.col("o").isNull(), "added").when(F.coalesce(over, F.lit(False)), "replaced").otherwise("kept")
    both = old.join(new, "k", "full").withColumn("outcome", outcome)
    return both.select(F.when(F.col("outcome") == "kept", F.col("o")).otherwise(F.col("n")).alias("r"), "outcome").select("r.*", "outcome")


def flagged_candidates(judged: DataFrame, chats: DataFrame, useless: DataFrame | None = None) -> DataFrame:
    """All rows that may become candidates, with what becomes of each in fate: kept, duplicate or no-answer."""
    has = lambda c, other: F.col(c) if c in judged.columns else other
    blank = F.lit(None).cast("string")
    hard = [F.when(F.col("faithful") == 0, "hard-negative:faithfulness"), F.when(F.col("relevant") == 0, "hard-negative:relevance")]
    a = judged.withColumns({"_channel": F.trim(has("channel", blank)), "_bad": F.lit(False)})
    if useless is not None:
        # documents with useless feedback meet the sources of answers by a join, once for each answer
        sources = judged.select("id", F.explode("doc_ids").alias("doc_id")).join(useless.select("doc_id").distinct(), "doc_id", "left_semi")
        a = a.drop("_bad").join(sources.select("id", F.lit(True).alias("_bad")).distinct(), "id", "left")
    failed = (F.col("faithful") == 0) | (F.col("relevant") == 0)
    tags = F.array_compact(F.array(*hard, F.when(F.col("_bad"), "hard-negative:useless-feedback"), F.when(F.col("_channel") != "", F.concat(F.lit("channel:"), "_channel"))))
    first = F.when(F.coalesce(failed, F.lit(False)), 0).otherwise(1)
    a = a.select(F.lit(0).alias("kind"), "id", "question", "answer", F.array_join(tags, ",").alias("tags"), first.alias("o1"), (-F.col("id")).alias("o2"), F.coalesce("_bad", F.lit(False)).alias("bad"))
    b = chats.select(F.lit(1).alias("kind"), "id", "question", "answer", F.lit("channel:chat-history").alias("tags"), F.lit(0).alias("o1"), F.col("id").alias("o2"), F.lit(False).alias("bad"))
    rows = a.unionByName(b).withColumn("key", question_key(F.coalesce("question", F.lit(""))))
    rows = rows.withColumn("_none", (F.length("key") < 2) | (F.trim(F.coalesce("answer", F.lit(""))) == ""))
    # rows without an answer are no rivals of those that have one
    w = Window.partitionBy("key", "_none").orderBy("kind", "o1", "o2")
    fate = F.when(F.col("_none"), "no-answer").when(F.row_number().over(w) == 1, "kept").otherwise("duplicate")
    return rows.withColumn("fate", fate).drop("_none")


def select_candidates(judged: DataFrame, chats: DataFrame, limit: int | None = None, useless: DataFrame | None = None) -> DataFrame:
    """Candidates for review (kind, id, question, answer, tags), one for each normalised question: judged answers first,
    failed ones ahead and later ones first, then pairs of questions and answers from conversations, in order of id.

    judged: id, question, answer, faithful, relevant, and if there channel and doc_ids, the sources of the answer; chats: id,
    question, answer; useless: the documents (doc_id) whose feedback was useless, which tag answers from them. Questions of fewer than
    two characters and blank answers are left out. limit keeps the first rows of the whole order."""
    first = flagged_candidates(judged, chats, useless).where("fate = 'kept'")
    if limit is not None:
        first = first.orderBy("kind", "o1", "o2").limit(limit)
    return first.select("kind", "id", F.trim("question").alias("question"), F.trim("answer").alias("answer"), "tags")


def candidate_counters(judged: DataFrame, chats: DataFrame, useless: DataFrame | None = None) -> DataFrame:
    """One row: judged answers and chats considered, those left out as duplicates or without an answer, and answers tagged for
    useless feedback; over all rows, whatever limit a selection has."""
    fate = lambda x: F.count_if(F.col("fate") == x)
    return flagged_candidates(judged, chats, useless).agg(
        F.count_if(F.col("kind") == 0).alias("judged"), F.count_if(F.col("kind") == 1).alias("chats"), fate("duplicate").alias("duplicates"), fate("no-answer").alias("unanswered"), F.count_if(F.col("bad") & (F.col("fate") == "kept")).alias("useless")
    )


def sample_answers(log: DataFrame, session: str, answer: str, percent: int) -> DataFrame:
    """Non-blank answers, one for each session and text, of which about percent are drawn by a digest, the same ones each time."""
    digest = F.sha2(F.trim(answer), 256)
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(session).cast("string"), F.col("answer_hash")), 256), 1, 6), 16, 10).cast("long") % 100 < percent
    return log.where(F.trim(answer) != "").select(session, digest.alias("answer_hash")).distinct().where(drawn)


def sample_id(domain: Column, question: Column) -> Column:
    return F.concat(F.lit("synth-"), domain, F.lit("-"), F.substring(F.sha1(question), 1, 10))
