"""Registered queries for evaluation sets, conflicts, tasks, reviews and lineage, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, evaluation as E, governance as G, metrics, records
from ..sources import tables as S
from .base import COSTED, EVENTS, costed, events, simple

# samples and rates
SAMPLES = "(SELECT doc_id, quality AS faithful, CASE WHEN doc_id % 3 <> 0 THEN toxic END AS relevant, CASE doc_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'FAILED' ELSE 'JUDGED' END AS status FROM labels)"


def samples(t):
    status = F.when(F.col("doc_id") % 4 == 0, "PENDING").when(F.col("doc_id") % 4 == 1, "FAILED").otherwise("JUDGED")
    return t("labels").select("doc_id", F.col("quality").alias("faithful"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic")).alias("relevant"), status.alias("status"))


def rate_sql(hit: str, of: str) -> str:
    return f"round(avg(CASE WHEN status = 'JUDGED' AND {of} THEN CAST({hit} AS INT) END), 6)"


simple("k5_answer_summary", lambda t: E.answer_summary(samples(t)), f"SELECT count(*) FILTER (status = 'JUDGED') AS judged, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'FAILED') AS failed, {rate_sql('faithful = 1', 'faithful IS NOT NULL')} AS faithful_rate, {rate_sql('relevant = 1', 'relevant IS NOT NULL')} AS relevant_rate, {rate_sql('faithful = 1 AND relevant = 1', 'faithful IS NOT NULL AND relevant IS NOT NULL')} AS both_rate FROM {SAMPLES}")


def citations(t):
    page = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber"))
    cites = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cite_id"), F.col("l_partkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("version"), page.alias("page"), F.lower("l_returnflag").alias("snippet"))
    chunks = t("part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 3).alias("version"), (F.col("p_size") % 7).alias("page"), F.col("p_name").alias("content"), (F.col("p_size") % 5 != 0).alias("active"))
    return E.judge_citations(cites, chunks)


CITED = """(SELECT cite_id, coalesce(bool_or(v = version), false) AS resolvable, coalesce(bool_or(v = version AND (page IS NULL OR p = page) AND contains(content, snippet)), false) AS consistent
FROM (SELECT l_orderkey * 10 + l_linenumber AS cite_id, l_partkey AS doc_id, l_linenumber % 3 AS version, CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber END AS page, lower(l_returnflag) AS snippet FROM lineitem)
LEFT JOIN (SELECT p_partkey AS doc_id, p_size % 3 AS v, p_size % 7 AS p, p_name AS content FROM part WHERE p_size % 5 <> 0) USING (doc_id) GROUP BY 1)"""
simple("l5_judge_citations", citations, f"SELECT * FROM {CITED}")
simple("l4_citation_rate", lambda t: metrics.rate(citations(t), F.col("resolvable") & F.col("consistent")), f"SELECT round(avg(CAST(resolvable AND consistent AS INT)), 6) AS rate, count(*) AS n FROM {CITED}")
ERRORS = "(SELECT 'fact' AS kind, round(avg(CAST(quality = 0 AS INT)), 6) AS rate, count(*) AS n FROM labels UNION ALL SELECT 'structure', round(avg(CAST(toxic = 1 AS INT)), 6), count(*) FROM labels)"
EDITS = "(SELECT round(avg(CAST(o_orderstatus = 'O' AS INT)), 6) AS rate, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O'))"


def judge_errors(t):
    return E.judge_error_rates(t("labels").select((F.col("quality") == 0).alias("fact_error"), (F.col("toxic") == 1).alias("structure_error")))


def edits(t):
    return E.human_edit_rate(t("orders").select(F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "EDITED").otherwise("OPEN").alias("status")))


simple("l6_judge_error_rates", judge_errors, f"SELECT * FROM {ERRORS}")
simple("l7_human_edit_rate", edits, f"SELECT * FROM {EDITS}")
simple(
    "l10_retrieval_golden",
    lambda t: E.retrieval_golden(t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") != "F").alias("expected")), t("orders").where("o_orderpriority != '5-LOW'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))),
    "SELECT query_id, expected, found, forbidden, CASE WHEN expected = 0 THEN 1.0 ELSE round(found / expected, 6) END AS score, found = expected AND forbidden = 0 AS passed FROM (SELECT o_custkey AS query_id, count(*) FILTER (o_orderstatus <> 'F') AS expected, count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW') AS found, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') AS forbidden FROM orders GROUP BY 1)",
)


def report(t, **more):
    times = metrics.response_times(S.engine_calls(t("lineitem"))).selectExpr("stack(2, concat(purpose, '.p50'), p50, concat(purpose, '.p95'), p95) as (kind, rate)", "n")
    return E.metric_report({"field_accuracy": metrics.rate(t("labels"), F.col("quality") == 1), "judge_errors": judge_errors(t), "human_edits": edits(t), "cost_per_turn": metrics.cost_per_turn(costed(t)), "response_time": times} | more)


simple("l13_metric_report", report, f"""
SELECT 'field_accuracy' AS metric, '' AS sub_key, round(avg(CAST(quality = 1 AS INT)), 6) AS value, count(*) AS n FROM labels UNION ALL SELECT 'judge_errors', kind, rate, n FROM {ERRORS} UNION ALL SELECT 'human_edits', '', rate, n FROM {EDITS}
UNION ALL SELECT 'cost_per_turn', '', round(coalesce(sum(cost), 0) / nullif(count(*) FILTER (purpose = 'CHAT'), 0), 6), NULL FROM {COSTED}
UNION ALL SELECT 'response_time', purpose || '.p50', quantile_disc(latency_ms, 0.5), count(*) FROM {COSTED} WHERE status = 'OK' GROUP BY purpose UNION ALL SELECT 'response_time', purpose || '.p95', quantile_disc(latency_ms, 0.95), count(*) FROM {COSTED} WHERE status = 'OK' GROUP BY purpose""")
simple("l14_skipped_metrics", lambda t: E.skipped_metrics(t("labels"), "doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 0, F.lit(False))), """
SELECT doc_id, m AS metric, CASE WHEN r AND NOT ref THEN 'reference' ELSE 'contexts' END AS reason FROM (SELECT doc_id, coalesce(quality = 1, false) AS ref, coalesce(toxic = 0, false) AS ctx FROM labels),
(VALUES ('faithfulness', false, true), ('context_precision_without_reference', false, true), ('context_recall', true, true), ('factual_correctness', true, false), ('semantic_similarity', true, false)) v(m, r, c) WHERE (r AND NOT ref) OR (c AND NOT ctx)""")
simple("l16_provenance", lambda t: E.provenance_stats(t("orders"), "o_orderstatus", "o_orderpriority"), "SELECT 'o_orderstatus' AS key, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
simple("l17_similarity", lambda t: t("embeddings").select("vec_id", "embedding").join(t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id").select("vec_id", F.round(E.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity")), "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.e, b.e) / nullif(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 0), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")


def merged(t):
    status = F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved")
    rows = lambda df: df.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_totalprice").alias("value"))
    new = rows(t("orders").where("o_orderstatus != 'F'")).select("id", F.lit("pending").alias("status"), (-F.col("value")).alias("value"))
    return E.merge_candidates(rows(t("orders").where("o_orderpriority != '5-LOW'")), new, force=True)


simple("l18_merge_candidates", merged, """
WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'approved' END AS status, o_totalprice AS value, o_orderpriority <> '5-LOW' AS old, o_orderstatus <> 'F' AS new FROM orders),
x AS (SELECT *, CASE WHEN NOT old THEN 'added' WHEN new AND status = 'pending' THEN 'replaced' ELSE 'kept' END AS outcome FROM o WHERE old OR new)
SELECT id, CASE WHEN outcome = 'kept' THEN status ELSE 'pending' END AS status, CASE WHEN outcome = 'kept' THEN value ELSE -value END AS value, outcome FROM x""")


def candidates(t):
    judged = t("orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("  ", F.col("o_orderpriority"), (F.col("o_custkey") % 50).cast("string")).alias("question"), F.col("o_orderstatus").alias("answer"), (F.col("o_orderkey") % 3).alias("faithful"), (F.col("o_orderkey") % 5).alias("relevant"))
    chats = records.pair_answers(t("conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question", "answer")
    return E.select_candidates(judged, chats)


simple("l19_select_candidates", candidates, r"""
WITH j AS (SELECT 0 AS kind, o_orderkey AS id, o_orderpriority || '  ' || (o_custkey % 50) AS question, o_orderstatus AS answer, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'hard-negative:faithfulness' END, CASE WHEN o_orderkey % 5 = 0 THEN 'hard-negative:relevance' END) AS tags FROM orders),
c AS (SELECT 1 AS kind, q.conv_id * 1000 + q.turn AS id, q.text AS question, (SELECT arg_min(a.text, a.turn) FROM conversations a WHERE a.conv_id = q.conv_id AND a.turn > q.turn AND a.role = 'assistant' AND trim(a.text) <> '') AS answer, 'channel:chat-history' AS tags FROM conversations q WHERE role = 'user'),
u AS (SELECT *, CASE WHEN kind = 0 AND tags = '' THEN 1 ELSE 0 END AS o1, CASE WHEN kind = 0 THEN -id ELSE id END AS o2, lower(trim(regexp_replace(question, '\s+', ' ', 'g'), ' ')) AS key FROM (SELECT * FROM j UNION ALL SELECT * FROM c))
SELECT kind, id, trim(question) AS question, trim(answer) AS answer, tags FROM u WHERE length(key) >= 2 AND trim(answer) <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY kind, o1, o2) = 1""")
simple("l20_sample_answers", lambda t: E.sample_answers(t("conversations").where("role = 'assistant'"), "conv_id", F.col("text"), 30), "WITH a AS (SELECT DISTINCT conv_id, sha256(trim(text)) AS answer_hash FROM conversations WHERE role = 'assistant' AND trim(text) <> '') SELECT * FROM a WHERE CAST('0x' || substr(sha256(conv_id || ':' || answer_hash), 1, 6) AS BIGINT) % 100 < 30")
simple("l22_sample_id", lambda t: t("conversations").where("role = 'user'").select(E.sample_id(F.col("role"), F.col("text")).alias("id")).distinct(), "SELECT DISTINCT 'synth-' || role || '-' || left(sha1(text), 10) AS id FROM conversations WHERE role = 'user'")
# conflicts
simple("d6_critical_diff", lambda t: t("part").select("p_partkey", G.differing_parts(F.col("p_name"), F.col("p_type")).alias("parts"), G.critical_diff(F.col("p_name"), F.col("p_brand")).alias("critical")), r"""
WITH p AS (SELECT *, len(list_filter(range(1, least(length(p_name), length(p_type)) + 1), lambda i: left(p_name, i) = left(p_type, i))) AS p FROM part), x AS (SELECT p_partkey, p_name, p_brand, p_name[p + 1:] AS x, p_type[p + 1:] AS y FROM p),
s AS (SELECT *, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: right(x, i) = right(y, i))) AS s FROM x)
SELECT p_partkey, left(x, length(x) - s) || left(y, length(y) - s) AS parts, regexp_matches(p_brand, '\d') AS critical FROM s""")
simple("d7_resolve_near_dups", lambda t: G.resolve_copies(t("documents"), S.engine_documents(t("documents"))))
simple("e4_arbitrate", lambda t: G.arbitrate(t("orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("date")).alias("effective_date"))), """
WITH m AS (SELECT o_custkey AS group_id, o_orderkey AS chunk_id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS effective_date FROM orders),
w AS (SELECT *, count(*) FILTER (effective_date IS NULL) OVER (PARTITION BY group_id) AS undated, max(effective_date) OVER (PARTITION BY group_id) AS last FROM m), v AS (SELECT *, count(*) FILTER (effective_date = last) OVER (PARTITION BY group_id) AS winners FROM w)
SELECT group_id, chunk_id, effective_date, coalesce(undated = 0 AND winners = 1 AND effective_date < last, false) AS removed FROM v""")


def conflicts(t):
    return t("orders").select(F.col("o_orderkey").alias("conflict_id"), F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1).alias("b"))


ACTION_LIST = ("KEEP_A", "DELETE_A", "DELETE_B", "IGNORED", "BURN")
simple("e6_apply_resolutions", lambda t: G.apply_resolutions(conflicts(t), t("orders").where("o_orderpriority != '5-LOW'").select(F.col("o_orderkey").alias("conflict_id"), F.element_at(F.array(*map(F.lit, ACTION_LIST)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("action"))), f"""
WITH c AS (SELECT o_orderkey AS conflict_id, o_custkey AS a, o_custkey + 1 AS b, CASE WHEN o_orderpriority <> '5-LOW' THEN {list(ACTION_LIST)}[o_orderkey % 5 + 1] END AS action FROM orders)
SELECT conflict_id, a, b, CASE WHEN action IS NULL THEN 'OPEN' WHEN action = 'BURN' THEN 'ERROR' WHEN action = 'IGNORED' THEN 'IGNORED' ELSE 'RESOLVED' END AS status, CASE action WHEN 'DELETE_A' THEN a WHEN 'DELETE_B' THEN b END AS deactivated FROM c""")
simple("e7_conflict_view", lambda t: G.conflict_view(conflicts(t), t("customer").withColumnRenamed("c_custkey", "chunk_id"), "c_name", "c_mktsegment"), "SELECT o_orderkey AS conflict_id, o_custkey AS a, o_custkey + 1 AS b, x.c_name AS a_c_name, x.c_mktsegment AS a_c_mktsegment, y.c_name AS b_c_name, y.c_mktsegment AS b_c_mktsegment FROM orders LEFT JOIN customer x ON x.c_custkey = o_custkey LEFT JOIN customer y ON y.c_custkey = o_custkey + 1")
# fields and reviews
DAY_TEXTS = ("1995-02-30", "1995-02-03x", "", "word")


def validated(t):
    day = F.element_at(F.array(*map(F.lit, DAY_TEXTS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    checks = {"size": G.validate_field(F.col("p_size").cast("string"), "NUMBER", pattern=r"\d"), "brand": G.validate_field(F.col("p_brand"), "NUMBER", allowed=["brand#11", "brand#12"]), "day": G.validate_field(day, "DATE", required=True)}
    return t("part").select("p_partkey", *(F.array_join(c, ",").alias(n) for n, c in checks.items()))


simple("i10_validate_fields", validated, "SELECT p_partkey, CASE WHEN length(CAST(p_size AS VARCHAR)) <> 1 THEN 'PATTERN' ELSE '' END AS size, CASE WHEN lower(p_brand) IN ('brand#11', 'brand#12') THEN 'NUMBER' ELSE 'NUMBER,ENUM' END AS brand, ['DATE', '', 'REQUIRED', 'DATE'][p_partkey % 4 + 1] AS day FROM part")
simple("i12_review_cases", lambda t: G.review_cases(t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("field_key"), (F.col("l_returnflag") != "A").alias("valid"), (F.col("l_discount") * 10).alias("confidence")), t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("rule"), (F.col("l_tax") > 0.02).alias("match"))), "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS subject, 'LOW_CONFIDENCE' AS kind FROM lineitem WHERE l_returnflag = 'A' OR l_discount * 10 < 0.75 UNION ALL SELECT DISTINCT l_orderkey, l_linestatus, 'MATERIAL_DIFF' FROM lineitem WHERE NOT l_tax > 0.02")
simple("i13_dispose_reviews", lambda t: G.dispose_reviews(t("orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("APPROVED").alias("status")), t("orders").where("o_orderpriority != '5-LOW'").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 4 == 1, "EDIT").when(F.col("o_orderkey") % 4 == 2, "REJECT").otherwise("OTHER").alias("action"))), "SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus <> 'O' THEN 'APPROVED' WHEN o_orderpriority = '5-LOW' THEN 'OPEN' ELSE ['OPEN', 'EDITED', 'REJECTED', 'OPEN'][o_orderkey % 4 + 1] END AS status FROM orders")
# lineage
simple("j2_field_state", lambda t: G.field_state(t("lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_returnflag").alias("field_key"), F.col("l_linenumber").alias("version"), F.col("l_quantity").alias("value"), (F.col("l_linestatus") == "O").alias("reviewed"))), "SELECT doc_id, field_key, l.version AS version, l.value AS value, CASE WHEN l.reviewed THEN 'HUMAN' ELSE 'MODEL' END AS source, versions FROM (SELECT l_partkey AS doc_id, l_returnflag AS field_key, max(struct_pack(version := l_linenumber, value := l_quantity, reviewed := l_linestatus = 'O')) AS l, count(DISTINCT l_linenumber) AS versions FROM lineitem GROUP BY 1, 2)")
simple("j3_add_edges", lambda t: G.add_edges(t("lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey").distinct(), t("lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"]), "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
simple("j4_document_lineage", lambda t: G.document_lineage({"version": t("orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus"), "edge": t("lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_returnflag")}, "doc_id"), "SELECT 'version' AS kind, o_orderkey AS doc_id, '{\"doc_id\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS payload FROM orders UNION ALL SELECT 'edge', l_orderkey, '{\"doc_id\":' || l_orderkey || ',\"l_linenumber\":' || l_linenumber || ',\"l_returnflag\":\"' || l_returnflag || '\"}' FROM lineitem")
# tasks
TASK_EVENTS = (("view", "LEASE"), ("click", "RETRY"), ("purchase", "COMPLETE"), ("error", "HEARTBEAT"))
LEGAL = ", ".join(f"('{f}', '{e}')" for f, e, _ in G.TRANSITIONS)
simple("k11_task_backlog", lambda t: G.state_counts(t("orders"), "o_orderstatus", ["F", "O", "P", "X"]), "SELECT s AS o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s)")


def task_log(t):
    event = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in TASK_EVENTS), F.lit("SUBMIT"))
    return t("events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), event.alias("event"))


simple("k12_task_audit", lambda t: G.task_audit(task_log(t)), f"""
WITH l AS (SELECT user_id AS task_id, event_id AS seq, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in TASK_EVENTS)} ELSE 'SUBMIT' END AS event FROM events),
g AS (SELECT *, CASE event WHEN 'LEASE' THEN 'RUNNING' WHEN 'RETRY' THEN 'PENDING' WHEN 'COMPLETE' THEN 'COMPLETED' WHEN 'SUBMIT' THEN 'PENDING' END AS target FROM l),
b AS (SELECT *, last_value(target IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT task_id, seq, event, before, coalesce(target, before) AS after, CASE WHEN target IS NULL THEN true WHEN before IS NULL THEN event = 'SUBMIT' ELSE (before, event) IN ({LEGAL}) END AS legal FROM b""")
simple("k13_expired_leases", lambda t: G.expired_leases(t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("DONE").alias("status"), F.col("o_orderdate").alias("lease_until")), F.lit("1997-01-01").cast("timestamp_ntz")), "SELECT o_orderkey, 'RUNNING' AS status, o_orderdate AS lease_until FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01'")
simple("k14_page", lambda t: G.page_by(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 20), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
simple("m3_trace_timeline", lambda t: dedup.latest_by(events(t), ["chunk_id"], F.desc("created_at"), F.desc("event_id")).select("chunk_id", "event_id", "event_type"), f"SELECT chunk_id, event_id, event_type FROM {EVENTS} QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, event_id DESC) = 1")
simple("m3_trace_rows", lambda t: dedup.placed_by(events(t), ["chunk_id"], "created_at", "event_id").select("chunk_id", "place", "event_id", "event_type", "created_at"), f"SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at, event_id) AS place, event_id, event_type, created_at FROM {EVENTS}")
simple("m3_user_latest", lambda t: dedup.placed_by(t("events"), ["user_id"], F.desc("ts"), F.desc("event_id"), most=100).select("user_id", "place", "event_id", "event_type"), "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, event_id, event_type FROM events QUALIFY place <= 100")
