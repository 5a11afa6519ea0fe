"""Registered queries of the screening chain, reviews, candidates, rules, dashboards, tags and graph lists, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, evaluation, knowledge, metrics, records, review, screening
from ..sources import tables as S
from ..streaming import state, streams
from .base import EVENTS, WORDS, events, simple

ASOF = "2024-01-31 00:00:00"

# screening
REDACTED = "text"
for _p in X.OUTPUT_PII:
    REDACTED = f"regexp_replace({REDACTED}, '{_p}', '[REDACTED]', 'g')"


def first_pattern(text: str, patterns: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN 'pattern {i}'" for i, p in enumerate(patterns, 1)) + " END"


def screened_sql(source: str, keys: str) -> str:
    """A table of texts after the output chain: what redaction leaves, and the reasons of the two screens."""
    return f"""r AS (SELECT {keys}, text, {REDACTED} AS t FROM {source} WHERE trim(coalesce(text, '')) <> ''),
s AS (SELECT *, {first_pattern("t", X.LEAK)} AS leak, {first_pattern("t", X.PROTECTED)} AS own FROM r)"""


def screened_documents(t) -> DataFrame:
    return screening.screen_texts(t("documents").select("doc_id", "text"), "text", screening.output_chain())


DOCS = screened_sql("documents", "doc_id")
simple("n4_output_chain", lambda t: screened_documents(t).select("doc_id", "blocked", "content", F.size("audits").alias("audits")), f"""
WITH {DOCS} SELECT d.doc_id, coalesce(leak, own) IS NOT NULL AS blocked, CASE WHEN s.doc_id IS NULL THEN d.text WHEN leak IS NULL AND own IS NULL THEN t END AS content,
  CASE WHEN s.doc_id IS NULL THEN 0 WHEN leak IS NOT NULL THEN 2 ELSE 3 END AS audits FROM documents d LEFT JOIN s USING (doc_id)""")
simple("n4_audit_rows", lambda t: screening.audit_rows(screened_documents(t), "doc_id"), f"""
WITH {DOCS}, a AS (
  SELECT doc_id, 1 AS place, 'pii_redact' AS detector, CASE WHEN t <> text THEN 'SANITIZE' ELSE 'PASS' END AS result, CASE WHEN t <> text THEN 0.5 ELSE 0 END AS risk, text AS content FROM s
  UNION ALL SELECT doc_id, 2, 'system_prompt_leak', CASE WHEN leak IS NOT NULL THEN 'BLOCK' ELSE 'PASS' END, CASE WHEN leak IS NOT NULL THEN 0.85 ELSE 0 END, t FROM s
  UNION ALL SELECT doc_id, 3, 'protected_material', CASE WHEN own IS NOT NULL THEN 'BLOCK' ELSE 'PASS' END, CASE WHEN own IS NOT NULL THEN 0.7 ELSE 0 END, t FROM s WHERE leak IS NULL
) SELECT doc_id, place, detector, result, CAST(risk AS DOUBLE) AS risk, left(content, 4000) AS content FROM a""")
simple("n4_violation_rows", lambda t: screening.violation_rows(screened_documents(t), "doc_id"), f"""
WITH {DOCS} SELECT doc_id, CASE WHEN leak IS NOT NULL THEN 'SYSTEM_PROMPT_LEAK' ELSE 'PROTECTED_MATERIAL' END AS violation, coalesce(leak, own) AS reason, left(text, 4000) AS content, 'HIGH' AS severity
FROM s WHERE coalesce(leak, own) IS NOT NULL""")
simple("n5_violation_report", lambda t: screening.report(screened_documents(t)), f"""
WITH {DOCS}, a AS (
  SELECT 'pii_redact' AS name, CASE WHEN t <> text THEN 'SANITIZE' ELSE 'PASS' END AS value FROM s
  UNION ALL SELECT 'system_prompt_leak', CASE WHEN leak IS NOT NULL THEN 'BLOCK' ELSE 'PASS' END FROM s
  UNION ALL SELECT 'protected_material', CASE WHEN own IS NOT NULL THEN 'BLOCK' ELSE 'PASS' END FROM s WHERE leak IS NULL
) SELECT 'audit' AS kind, name, value, count(*) AS n FROM a GROUP BY ALL
UNION ALL SELECT 'violation', CASE WHEN leak IS NOT NULL THEN 'SYSTEM_PROMPT_LEAK' ELSE 'PROTECTED_MATERIAL' END, 'HIGH', count(*) FROM s WHERE coalesce(leak, own) IS NOT NULL GROUP BY ALL""")
# masks look behind, which the twin's expressions cannot: tests hold this one against its parts
simple("n4_input_chain", lambda t: screening.screen_texts(t("conversations").where("role = 'user'").select("conv_id", "turn", "text"), "text", screening.input_chain()).select("conv_id", "turn", "content", "blocked"))


def answers(t) -> DataFrame:
    deltas = t("conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("text").alias("delta"), (F.col("role") == "assistant").alias("done"))
    return screening.screen_answers(state.answers_of(deltas)).select("session", "content", "blocked", "violation", "reason")


simple("p5_screened_answers", answers, f"""
WITH e AS (SELECT conv_id, min(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1),
w AS (SELECT conv_id AS session, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations JOIN e USING (conv_id) WHERE turn <= last GROUP BY 1),
{screened_sql("w", "session")}
SELECT w.session, CASE WHEN s.session IS NULL THEN w.text WHEN leak IS NULL AND own IS NULL THEN t END AS content, coalesce(leak, own) IS NOT NULL AS blocked,
  CASE WHEN leak IS NOT NULL THEN 'SYSTEM_PROMPT_LEAK' WHEN own IS NOT NULL THEN 'PROTECTED_MATERIAL' END AS violation, coalesce(leak, own) AS reason FROM w LEFT JOIN s USING (session)""")


# reviews and candidates
def review_tables(t) -> tuple[DataFrame, DataFrame]:
    """Orders as samples, their lines as actions on them in order of their numbers, and on orders that are no samples."""
    o = t("orders").select(F.col("o_orderkey").alias("id"), "*")
    samples = o.where("o_orderstatus != 'P'").select(
        "id", F.when(F.col("o_orderstatus") == "O", "golden").otherwise("pending").alias("place"), F.col("o_orderpriority").alias("question"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderstatus")).alias("answer"),
        F.when(F.col("o_custkey") % 2 == 0, "synthetic").otherwise("production").alias("source"), F.lit("reference-proxy").alias("answerOrigin"), F.lit("pending").alias("reviewStatus"),
        F.when(F.col("o_custkey") % 3 != 0, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>")).alias("contexts"), F.array().cast("array<string>").alias("tags"),
    )
    line = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_partkey").alias("part"))
    kind = F.when(F.col("flag") == "A", "edit").when(F.col("flag") == "R", F.when(F.col("part") % 2 == 0, "reject").otherwise("add")).otherwise("approve")
    actions = line.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"), kind.alias("action"), F.when(kind == "add", "new").alias("question"), F.when(kind.isin("add", "edit") & (F.col("status") == "O"), F.concat(F.lit("a"), "part")).alias("answer"),
        F.when(kind.isin("add", "edit"), F.array(F.concat(F.lit(" c"), F.col("part") % 3), F.lit(" "))).alias("contexts"), F.lit("r").alias("reviewedBy"), (F.col("part") % 7 == 0).alias("clear"), (F.col("part") % 3 == 0).alias("keep_proxy"),
    )
    return samples, actions


def reviewed(t) -> DataFrame:
    lists = [F.array_join(c, "|").alias(c) for c in review.LISTS]
    return review.review_eval_set(*review_tables(t)).select("kind", "id", "question", "answer", "answerOrigin", "reviewStatus", *lists, "seq", "action", "outcome")


simple("l23_review_eval_set", reviewed)


def judged(t) -> DataFrame:
    o = t("orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat_ws("  ", "o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("question"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderstatus")).alias("answer"),
        F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1).alias("faithful"), F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(1).alias("relevant"), F.lower("o_orderstatus").alias("channel"), F.array(F.col("o_custkey") % 100, F.col("o_custkey") % 7).alias("doc_ids"),
    )


def useless(t) -> DataFrame:
    return t("labels").where("quality = 0").select("doc_id")


def chats(t) -> DataFrame:
    return records.pair_answers(t("conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question", "answer")


CANDIDATES = r"""j AS (
  SELECT 0 AS kind, o_orderkey AS id, o_orderpriority || '  ' || (o_custkey % 50) AS question, CASE WHEN o_custkey % 11 <> 0 THEN o_orderstatus END AS answer,
    coalesce(o_custkey % 100 IN (SELECT doc_id FROM labels WHERE quality = 0) OR o_custkey % 7 IN (SELECT doc_id FROM labels WHERE quality = 0), false) AS bad,
    o_orderkey % 3 = 0 AS f, o_orderkey % 5 = 0 AS r, lower(o_orderstatus) AS channel FROM orders
), c AS (
  SELECT q.conv_id * 1000 + q.turn AS id, q.text AS question,
    (SELECT arg_min(a.text, a.turn) FROM conversations a WHERE a.conv_id = q.conv_id AND a.turn > q.turn AND a.role = 'assistant' AND trim(a.text) <> '') AS answer FROM conversations q WHERE role = 'user'
), u AS (
  SELECT kind, id, question, answer, bad, CASE WHEN f OR r THEN 0 ELSE 1 END AS o1, -id AS o2, concat_ws(',', CASE WHEN f THEN 'hard-negative:faithfulness' END, CASE WHEN r THEN 'hard-negative:relevance' END,
    CASE WHEN bad THEN 'hard-negative:useless-feedback' END, 'channel:' || channel) AS tags FROM j
  UNION ALL SELECT 1, id, question, answer, false, 0, id, 'channel:chat-history' FROM c
), k AS (SELECT *, lower(trim(regexp_replace(coalesce(question, ''), '\s+', ' ', 'g'), ' ')) AS key FROM u),
g AS (SELECT *, length(key) < 2 OR trim(coalesce(answer, '')) = '' AS none FROM k),
h AS (SELECT *, CASE WHEN none THEN 'no-answer' WHEN row_number() OVER (PARTITION BY key, none ORDER BY kind, o1, o2) = 1 THEN 'kept' ELSE 'duplicate' END AS fate FROM g)"""
simple("l19_candidates_with_feedback", lambda t: evaluation.select_candidates(judged(t), chats(t), useless=useless(t)), f"WITH {CANDIDATES} SELECT kind, id, trim(question) AS question, trim(answer) AS answer, tags FROM h WHERE fate = 'kept'")
simple("l19_candidate_counters", lambda t: evaluation.candidate_counters(judged(t), chats(t), useless(t)), f"""
WITH {CANDIDATES} SELECT count(*) FILTER (kind = 0) AS judged, count(*) FILTER (kind = 1) AS chats, count(*) FILTER (fate = 'duplicate') AS duplicates, count(*) FILTER (fate = 'no-answer') AS unanswered,
  count(*) FILTER (bad AND fate = 'kept') AS useless FROM h""")

# rules
DIFFS = {
    "steps": [
        {"op": "const", "params": {"value": "v2"}, "to": "version"},
        {"op": "map", "params": {"field": "before"}, "to": "base"},
        {"op": "materialDiff", "params": {"left": "base", "right": "after"}, "to": "diff"},
        {"op": "map", "params": {"field": "diff"}, "to": "rows"},
    ],
    "outputs": ["version", "rows"],
}


def diffs(t) -> DataFrame:
    part = t("part").select(
        "p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("before"),
        F.create_map(F.lit("size"), (F.col("p_size") - F.col("p_partkey") % 2).cast("string"), F.lit("type"), F.col("p_type")).alias("after"),
    )
    return records.run_rules(part, DIFFS).select("p_partkey", "version", F.inline("rows"))


simple("i1_material_diff_step", diffs, """
SELECT p_partkey, 'v2' AS version, 'brand' AS key, p_brand AS value_a, NULL AS value_b, false AS match FROM part
UNION ALL SELECT p_partkey, 'v2', 'size', CAST(p_size AS VARCHAR), CAST(p_size - p_partkey % 2 AS VARCHAR), p_partkey % 2 = 0 FROM part
UNION ALL SELECT p_partkey, 'v2', 'type', NULL, p_type, false FROM part""")
COPIES = {"steps": [{"op": "map", "params": {"field": "o_totalprice"}, "to": "total"}, {"op": "const", "params": {"value": 7}, "to": "seven"}, {"op": "compare", "params": {"field": "o_orderstatus", "cmp": "!=", "right": "F"}, "to": "open"},
                    {"op": "compare", "params": {"field": "total", "cmp": "<=", "right": "$o_custkey"}, "to": "low"}, {"op": "compare", "params": {"field": "seven", "cmp": "==", "right": "7"}, "to": "same"}]}
simple("i2_map_const", lambda t: records.run_rules(t("orders"), COPIES).select("o_orderkey", "total", "seven", "open", "low", "same"), """
SELECT o_orderkey, o_totalprice AS total, 7 AS seven, o_orderstatus <> 'F' AS open, o_totalprice <= o_custkey AS low, true AS same FROM orders""")


# dashboards and feedback
def week(t) -> DataFrame:
    e = t("events")
    chunks = e.select(F.expr("ts - interval 170 days").alias("created_at"))
    conflicts = t("orders").select(F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("RESOLVED").alias("status"))
    audits = e.select(F.when(F.col("event_type") == "error", "BLOCK").otherwise("PASS").alias("result"), F.col("ts").alias("created_at"))
    violations = e.where("value > 20").select(F.upper("event_type").alias("violation"), F.col("ts").alias("created_at"))
    return knowledge.dashboard_week(events(t), chunks, conflicts, audits, violations, ASOF)


RECENT = f"ts <= TIMESTAMP '{ASOF}' AND ts > TIMESTAMP '{ASOF}' - INTERVAL 7 DAY"
simple("k7_dashboard_week", week, f"""
WITH d AS (SELECT * FROM {EVENTS} WHERE created_at <= TIMESTAMP '{ASOF}' AND created_at > TIMESTAMP '{ASOF}' - INTERVAL 7 DAY)
SELECT (SELECT count(*) FROM d WHERE event_type = 'RETRIEVED') AS retrieved, (SELECT count(*) FROM d WHERE event_type = 'CITED') AS cited, (SELECT count(*) FROM d WHERE event_type = 'FEEDBACK_USEFUL') AS useful,
  (SELECT count(*) FROM d WHERE event_type = 'FEEDBACK_USELESS') AS useless, (SELECT count(DISTINCT chunk_id) FROM d) AS chunks,
  (SELECT count(*) FROM events WHERE ts - INTERVAL 170 DAY < TIMESTAMP '{ASOF}' - INTERVAL 180 DAY) AS old_chunks, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_conflicts,
  (SELECT count(*) FROM events WHERE event_type = 'error' AND {RECENT}) AS blocks, (SELECT count(*) FROM events WHERE value > 20 AND {RECENT}) AS violations,
  (SELECT coalesce(string_agg(DISTINCT upper(event_type), ',' ORDER BY upper(event_type)), '') FROM events WHERE value > 20 AND {RECENT}) AS kinds""")
simple("k9_feedback_to_events", lambda t: knowledge.feedback_to_events(t("labels").select(F.col("doc_id").alias("feedback_id"), F.when(F.col("toxic") == 0, F.col("doc_id")).alias("chunk_id"), (F.col("quality") == 1).alias("useful"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))), """
SELECT 'f' || doc_id AS event_id, doc_id AS chunk_id, CASE WHEN quality = 1 THEN 'FEEDBACK_USEFUL' ELSE 'FEEDBACK_USELESS' END AS event_type, TIMESTAMP '2024-01-01' AS created_at FROM labels WHERE toxic = 0 AND quality IS NOT NULL""")
LATENCY = "CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END"
simple("l8_percentiles_by_mode", lambda t: metrics.exact_percentiles(t("lineitem").select("l_linenumber", F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice")).alias("x")), "l_linenumber", "x", [0.0, 0.1, 0.5, 0.99, 1.0], 16), f"""
SELECT l_linenumber, share, CASE share WHEN 0 THEN quantile_disc(x, 0.0) WHEN 0.1 THEN quantile_disc(x, 0.1) WHEN 0.5 THEN quantile_disc(x, 0.5) WHEN 0.99 THEN quantile_disc(x, 0.99) ELSE quantile_disc(x, 1.0) END AS value, count(*) AS n
FROM (SELECT l_linenumber, {LATENCY} AS x FROM lineitem) l, (VALUES (CAST(0 AS DOUBLE)), (0.1), (0.5), (0.99), (1)) s(share) WHERE x IS NOT NULL GROUP BY l_linenumber, share""")


# tags and graph
def tags(t) -> DataFrame:
    chunks = S.engine_chunks(t("documents")).select(
        "doc_id", F.concat_ws("-", "doc_id", "idx").alias("chunk_id"), "content", F.lit(1).alias("version"), (F.col("idx") + 1).alias("page_no"), (F.col("idx") % 2 == 0).alias("active"))
    tagged = t("labels").where("toxic = 1").select(F.concat_ws("-", "doc_id", F.lit(0)).alias("chunk_id"))
    domains = t("labels").groupBy("doc_id").agg(F.when(F.max("quality") == 1, "good").otherwise("poor").alias("domain"))
    kinds = F.array(F.struct(F.lit("CLEANED").alias("type"), F.lit(0).alias("page_no")), F.struct(F.lit("PAGE_OCR").alias("type"), F.lit(2).alias("page_no")))
    made = t("labels").select("doc_id", F.lit(1).alias("version"), F.inline(kinds)).withColumn("artifact_id", F.concat_ws("/", "doc_id", "type"))
    return knowledge.tag_versions(chunks, tagged, domains, made)


simple("h2_tag_versions", tags, """
WITH c AS (SELECT doc_id, i - 1 AS idx, s[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) d, generate_series(1, len(s)) g(i) WHERE s[i] <> ''),
l AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'good' ELSE 'poor' END AS domain FROM labels GROUP BY 1)
SELECT c.doc_id, c.doc_id || '-' || idx AS chunk_id, coalesce(domain, 'general') AS domain, left(content, 200) AS snippet, 1 AS version, CAST(idx + 1 AS INT) AS page_no, idx % 2 = 0 AS active,
  CASE WHEN l.doc_id IS NOT NULL THEN c.doc_id || CASE WHEN idx = 1 THEN '/PAGE_OCR' ELSE '/CLEANED' END END AS artifact_id
FROM c LEFT JOIN l ON l.doc_id = c.doc_id WHERE NOT (idx = 0 AND c.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""")


def sightings(t) -> DataFrame:
    return t("part").select(F.col("p_type").alias("source"), F.col("p_brand").alias("target"), F.lit("OF").alias("type"), F.concat(F.lit("("), F.split("p_name", " ")[0], F.lit(")")).alias("description"), F.col("p_partkey").alias("order"))


# at most 8 different words, none of which holds another, so the order of their first sightings is the description
simple("g3_relation_descriptions", lambda t: records.upsert_relations(sightings(t)), """
WITH p AS (SELECT p_type AS source, p_brand AS target, '(' || split_part(p_name, ' ', 1) || ')' AS d, p_partkey FROM part), f AS (SELECT source, target, d, min(p_partkey) AS k FROM p GROUP BY ALL)
SELECT source, target, 'OF' AS type, (SELECT CAST(count(*) AS DOUBLE) FROM p WHERE p.source = f.source AND p.target = f.target) AS weight, string_agg(d, '；' ORDER BY k) AS description FROM f GROUP BY source, target""")
EDGE = "(SELECT DISTINCT c_mktsegment AS source, 'N' || c_nationkey AS target FROM customer UNION SELECT DISTINCT 'N' || s_nationkey, s_name FROM supplier)"


def segments(t) -> tuple[DataFrame, DataFrame]:
    a = t("customer").select(F.col("c_mktsegment").alias("source"), F.concat(F.lit("N"), "c_nationkey").alias("target"))
    edges = a.unionByName(t("supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("source"), F.col("s_name").alias("target"))).distinct()
    return edges, t("supplier").where("s_acctbal > 5000").select(F.concat(F.lit("N"), "s_nationkey").alias("entity")).distinct()


MATCHED = "(SELECT 'N' || s_nationkey FROM supplier WHERE s_acctbal > 5000)"
simple("g5_neighbours_of_nations", lambda t: records.neighbours(*segments(t)), f"""
WITH e AS {EDGE}, b AS (SELECT source AS entity, target AS neighbour FROM e UNION SELECT target, source FROM e)
SELECT entity, neighbour FROM b WHERE entity IN {MATCHED} AND neighbour NOT IN {MATCHED} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY neighbour) <= 10""")
simple("g5_neighbour_edges", lambda t: records.neighbour_edges(*segments(t)), f"SELECT source, target FROM {EDGE} WHERE source IN {MATCHED} OR target IN {MATCHED}")


def entities(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), (F.col("p_size") > 5).alias("active"), F.col("p_retailprice").alias("created_at"))


simple("g7_list_entities", lambda t: knowledge.list_entities(entities(t), 2, 25, "ECONOMY").select("id", "total"), """
SELECT p_partkey AS id, (SELECT count(*) FROM part WHERE p_size > 5 AND p_type = 'ECONOMY') AS total FROM part WHERE p_size > 5 AND p_type = 'ECONOMY' ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 25 OFFSET 50""")


# near duplicates by steps, and sessions
def signature_agreement(t) -> DataFrame:
    """Documents whose signatures agree with that of the first document with the same words in all slots: all of them do."""
    signed = dedup.minhash(t("documents"))
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    # digests stand for sets and signatures, which are some thousands of bytes each
    told = signed.select("doc_id", digest("signature").alias("s"), F.size("signature").alias("slots"), F.sort_array("hashes").alias("hashes"))
    told = told.select("doc_id", "s", "slots", digest("hashes").alias("h"))
    first = told.groupBy("h").agg(F.min_by("s", "doc_id").alias("f"))
    return told.join(first, "h").select("doc_id", "slots", (F.col("s") == F.col("f")).alias("agrees"))


SETS = f"(SELECT doc_id, list_sort(list_distinct({WORDS})) AS s FROM documents)"
simple("d3_minhash", signature_agreement, f"SELECT doc_id, 128 AS slots, true AS agrees FROM {SETS} WHERE len(s) > 0")


def certain_candidates(t) -> DataFrame:
    """The candidates that have equal sets of words, which share all bands."""
    signed = dedup.minhash(t("documents"))
    h = F.xxhash64(F.sort_array("hashes"))
    sets = signed.select("doc_id", h.alias("h"))
    # bands of different sets never meet, whatever else they share
    bands = signed.select("doc_id", h.alias("h"), F.explode(dedup.band_hashes(F.col("signature"))).alias("band"))
    n = dedup.BANDS * signed.count()
    pairs = dedup.lsh_candidates(bands.select("doc_id", F.xxhash64("band", "h").alias("band")), n=n)
    a, b = (sets.select(F.col("doc_id").alias(n), F.col("h").alias(f"{n}h")) for n in "ab")
    return pairs.join(a, "a").join(b, "b").where("ah = bh").select("a", "b")


simple("d4_candidates_of_equal_sets", certain_candidates, f"SELECT x.doc_id AS a, y.doc_id AS b FROM {SETS} x JOIN {SETS} y ON x.s = y.s AND x.doc_id < y.doc_id WHERE len(x.s) > 0")
simple("p7_sessions", lambda t: streams.sessions(events(t).withColumn("created_at", F.col("created_at").cast("timestamp"))).select("chunk_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n"), f"""
WITH e AS (SELECT chunk_id, created_at, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS first FROM {EVENTS} WINDOW w AS (PARTITION BY chunk_id ORDER BY created_at)),
s AS (SELECT *, sum(first) OVER (PARTITION BY chunk_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT chunk_id, min(created_at) AS start, max(created_at) + INTERVAL 24 HOUR AS end, count(*) AS n FROM s GROUP BY chunk_id, session""")
