"""Usage metrics, evaluation and model-call metrics (K, L, M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash

DAY = 86400.0


def knowledge_snapshot(events: DataFrame, asof: str, days: int = 30) -> DataFrame:
    """One row: events of the last days by kind."""
    recent = events.where((F.col("created_at") >= F.expr(f"timestamp_ntz'{asof}' - interval {days} days")) & (F.col("created_at") <= F.expr(f"timestamp_ntz'{asof}'")))
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    return recent.agg(count("RETRIEVED").alias("retrieved"), count("CITED").alias("cited"), count("FEEDBACK_USEFUL").alias("useful"), count("FEEDBACK_USELESS").alias("useless"), F.countDistinct("chunk_id").alias("chunks"))


def staleness(meta: DataFrame, events: DataFrame, asof: str, half: float = 180.0, limit: float = 0.3) -> DataFrame:
    """(chunk_id, recent, score, stale): half by age, half by recent retrievals; no date counts as infinitely old."""
    recent = events.where((F.col("event_type") == "RETRIEVED") & (F.col("created_at") >= F.expr(f"timestamp_ntz'{asof}' - interval 30 days"))).groupBy("chunk_id").agg(F.count("*").alias("recent"))
    age = F.datediff(F.lit(asof).cast("date"), F.col("created_at").cast("date"))
    fresh = F.coalesce(F.exp(-age / half), F.lit(0.0))
    rows = meta.join(recent, "chunk_id", "left").select("chunk_id", F.coalesce("recent", F.lit(0)).alias("recent"), fresh.alias("fresh"))
    score = F.floor((0.5 * F.col("fresh") + 0.5 * F.least(F.lit(1.0), F.col("recent") / 5)) * 1000 + 0.5) / 1000
    return rows.select("chunk_id", "recent", score.alias("score"), (score < limit).alias("stale"))


def suspect_useless(events: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Chunks once retrieved most of whose feedback is useless."""
    kind = F.col("event_type")
    rows = events.groupBy("chunk_id").agg(F.count_if(kind == "RETRIEVED").alias("retrieved"), F.count_if(kind == "FEEDBACK_USEFUL").alias("useful"), F.count_if(kind == "FEEDBACK_USELESS").alias("useless"))
    share = F.col("useless") / (F.col("useful") + F.col("useless"))
    return rows.where("retrieved > 0 and useful + useless > 0").withColumn("ratio", F.round(share, 6)).where(share > ratio)


def labelled_precision(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    useful, useless = F.count_if(kind == "FEEDBACK_USEFUL"), F.count_if(kind == "FEEDBACK_USELESS")
    return events.agg(F.round(F.try_divide(useful, useful + useless), 6).alias("precision"), (useful + useless).alias("n"))


def chunk_metrics(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.groupBy("chunk_id").agg(F.count_if(kind == "RETRIEVED").alias("retrieved"), F.count_if(kind == "CITED").alias("cited"), F.count_if(kind == "FEEDBACK_USEFUL").alias("useful"), F.count_if(kind == "FEEDBACK_USELESS").alias("useless"), F.max("created_at").alias("last_use"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def rate(df: DataFrame, hit, eligible=None) -> DataFrame:
    """One row (rate, n): share of eligible rows that hit; null where none is eligible."""
    df = df.where(eligible) if eligible is not None else df
    return df.agg(F.round(F.avg(hit.cast("double")), 6).alias("rate"), F.count("*").alias("n"))


def retrieval_hit_rate(events: DataFrame) -> DataFrame:
    """Useful among the retrievals of chunks that have feedback; useful wins where both were given."""
    kind = F.col("event_type")
    label = events.where(kind.isin("FEEDBACK_USEFUL", "FEEDBACK_USELESS")).groupBy("chunk_id").agg(F.max((kind == "FEEDBACK_USEFUL").cast("int")).alias("useful"))
    return rate(events.where(kind == "RETRIEVED").join(label, "chunk_id"), F.col("useful") == 1)


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: list[float], buckets: int = 256) -> DataFrame:
    """(key, share, value, n): nearest-rank percentiles of a value for each key; nulls are left out, and a key without values.

    Values are counted first, then dealt to buckets between estimated quantiles; sums of buckets say in which one a rank falls,
    and only that one is put in order. So no task holds all values of a key, and the estimates only shape the buckets."""
    # a struct around the key joins null keys too
    counts = stash(rows.where(F.col(value).isNotNull()).groupBy(F.struct(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("c")))
    cuts = counts.groupBy("k").agg(F.array_distinct(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 10 * buckets)).alias("cuts"))
    place = F.size(F.filter("cuts", lambda x: x < F.col("v")))
    dealt = stash(counts.join(cuts, "k").select("k", "v", "c", place.alias("bucket")))
    # a key has at most as many rows here as there are buckets
    sums = dealt.groupBy("k", "bucket").agg(F.sum("c").alias("s"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0))).withColumn("n", F.sum("s").over(Window.partitionBy("k")))
    asked = sums.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n"))))
    asked = asked.where("offset < rank and rank <= offset + s").select("k", "bucket", "share", "rank", "offset", "n")
    held = dealt.join(asked, ["k", "bucket"])
    upto = F.sum("c").over(Window.partitionBy("k", "bucket", "share").orderBy("v")) + F.col("offset")
    reached = held.withColumn("upto", upto).where("upto >= rank")
    return reached.groupBy("k", "share").agg(F.min("v").alias("value"), F.first("n").alias("n")).select(f"k.{key}", "share", "value", "n")


def response_times(calls: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of the latencies of calls that went well."""
    found = exact_percentiles(calls.where("status = 'OK'"), "purpose", "latency_ms", [0.5, 0.95])
    at = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
    return found.groupBy("purpose").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("n").alias("n"))


def estimate_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with their cost; null for a model without a price or unknown tokens. prices is a small table; Spark sizes the join."""
    cost = F.col("tokens_in") / 1000 * F.col("price_in") + F.col("tokens_out") / 1000 * F.col("price_out")
    return calls.join(prices, "model", "left").withColumn("cost", cost).drop("price_in", "price_out")


def cost_per_turn(costed: DataFrame) -> DataFrame:
    """Cost of all calls over the number of CHAT calls; null without one."""
    return costed.agg(F.round(F.try_divide(F.coalesce(F.sum("cost"), F.lit(0.0)), F.count_if(F.col("purpose") == "CHAT")), 6).alias("cost_per_turn"))


def call_counters(costed: DataFrame) -> DataFrame:
    return costed.groupBy("purpose", "model", "status").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 4).alias("cost"))


def aggregate_scores(scores: DataFrame, metric: str = "metric", source: str = "source", value: str = "value") -> DataFrame:
    """Means of present scores, for all sources and by source in one pass; missing ones counted apart."""
    sets = scores.groupingSets([[metric], [metric, source]], metric, source)
    return sets.agg(F.round(F.avg(value), 4).alias("mean"), F.count(value).alias("scored"), F.count_if(F.col(value).isNull()).alias("missing"), F.grouping(source).cast("int").alias("all_sources"))
