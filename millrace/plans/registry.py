"""Registered queries of the library's operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, metrics, records, retrieval, search_index
from ..session import spread, stash
from ..sources import tables as S
from ..streaming import streams
from . import completions, curation, knowledge, verdicts
from .base import CALLS, CHUNKS, COSTED, DATES, ENTRIES, EVENTS, asked, costed, events, simple
from .search import BM25, stored_index, text_index

ASOF = "2024-01-31 00:00:00"
LANGS = {"english": ["the", "and"], "french": ["avec", "pour"], "german": ["nicht", "und"], "spanish": ["para", "con"]}
PROGRAM = {
    "steps": [
        {"op": "arith", "params": {"expr": "l_extendedprice * (1 - l_discount)"}, "to": "net"},
        {"op": "arith", "params": {"expr": "net / l_quantity"}, "to": "unit"},
        {"op": "enum", "params": {"field": "l_returnflag", "values": ["A", "R"]}, "to": "returned"},
        {"op": "regex", "params": {"field": "l_linestatus", "pattern": "[OF]"}, "to": "known"},
        {"op": "compare", "params": {"field": "unit", "cmp": ">", "right": 1000}, "to": "dear"},
    ],
    "outputs": ["net", "returned", "known", "dear"],
}

# sources
simple("a1_scan", lambda t: t("lineitem").where("l_returnflag = 'R' and l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity"), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
simple(
    "a8_merge_latest",
    lambda t: S.merge_latest(t("orders").select("o_orderkey", "o_totalprice"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (-F.col("l_extendedprice")).alias("o_totalprice")), ["o_orderkey"], ["o_totalprice"]),
    "SELECT o.o_orderkey, coalesce(u.p, o.o_totalprice) AS o_totalprice FROM orders o LEFT JOIN (SELECT l_orderkey, max(-l_extendedprice) AS p FROM lineitem GROUP BY 1) u ON u.l_orderkey = o.o_orderkey UNION ALL SELECT l_orderkey, max(-l_extendedprice) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1",
)
# text
simple("b1_clean_text", lambda t: t("documents").select("doc_id", X.clean_text(F.col("text")).alias("text")), rf"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), chr(10)) AS l FROM documents),
o AS (SELECT doc_id, list_transform(l, lambda x: regexp_replace(x, '^{X.SPACE}+|{X.SPACE}+$', '', 'g')) AS t FROM s),
f AS (SELECT doc_id, list(x) AS often FROM (
  SELECT doc_id, x FROM (SELECT doc_id, unnest(t) AS x FROM o) WHERE length(x) BETWEEN 1 AND 49 GROUP BY ALL HAVING count(*) >= 3) GROUP BY 1),
k AS (SELECT doc_id, list_filter(t, lambda x: NOT regexp_matches(x, '{X.PAGE_NUMBER}') AND NOT regexp_matches(x, '{X.RULE_LINE}')
  AND NOT coalesce(list_contains(often, x), false)) AS t FROM o LEFT JOIN f USING (doc_id)),
j AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(t, chr(10)), '[ \t\x{{A0}}]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM k)
SELECT doc_id, regexp_replace(text, '^{X.SPACE}+|{X.SPACE}+$', '', 'g') AS text FROM j""")
simple("b2_content_hash", lambda t: t("documents").select("doc_id", X.content_hash(F.col("text")).alias("hash")), r"SELECT doc_id, sha256(lower(regexp_replace(coalesce(text, ''), '\s+', '', 'g'))) AS hash FROM documents")
simple("b3_token_estimate", lambda t: t("documents").select("doc_id", X.token_estimate(F.col("text")).cast("long").alias("tokens")), rf"""
WITH r AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{X.ASCII_MARK}+') AS runs FROM documents)
SELECT doc_id, CAST(coalesce(list_sum(list_transform(runs, lambda w: ceil(length(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) / 4))), 0)
  + coalesce(list_sum(list_transform(runs, lambda w: length(regexp_replace(w, '[A-Za-z0-9]', '', 'g')))), 0) + len(regexp_extract_all(text, '{X.WIDE_MARK}')) AS BIGINT) AS tokens FROM r""")
simple("b4_text_similarity", lambda t: t("part").select("p_partkey", F.round(X.text_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity")), r"""
WITH p AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(p_type), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS b FROM part)
SELECT p_partkey, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) END AS similarity FROM p""")
simple("b5_looks_garbled", lambda t: t("documents").select("doc_id", X.looks_garbled(F.col("text")).alias("garbled")), rf"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '{X.NOT_SPACE}')) + len(regexp_extract_all(text, '[\x{{10000}}-\x{{10FFFF}}]')) AS n,
  len(regexp_extract_all(text, '{X.BAD_MARK}')) AS bad, len(regexp_extract_all(text, '\x{{0}}')) AS nul FROM documents)
SELECT doc_id, coalesce(n >= 10 AND (bad >= 0.1 * n OR nul >= 0.25 * n), false) AS garbled FROM c""")
simple("b7_one_line", lambda t: t("documents").select("doc_id", X.one_line(F.col("text"), 200).alias("snippet")), r"SELECT doc_id, left(trim(regexp_replace(text, '[\r\n]+', ' ', 'g'), ' '), 200) AS snippet FROM documents")
simple("b8_question_key", lambda t: t("conversations").where("role = 'user'").select("conv_id", "turn", X.question_key(F.col("text")).alias("key")), r"SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS key FROM conversations WHERE role = 'user'")
simple("f1_query_terms", lambda t: asked(t).select("query_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms")), """
WITH w AS (SELECT item_id AS query_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]{2,}'), lambda x: lower(x)) AS w FROM benchmark)
SELECT query_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS terms FROM w""")
simple("d2_shingles", lambda t: t("documents").select("doc_id", F.array_join(F.array_sort(X.shingles(F.col("text"))), " ").alias("shingles")),
       "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))), ' ') AS shingles FROM documents")
# duplicates
simple("d1_exact_dedup", lambda t: dedup.exact_dedup(S.engine_chunks(t("documents")), S.engine_documents(t("documents"))), rf"""
WITH c AS (SELECT doc_id, idx, sha256(lower(regexp_replace(content, '\s+', '', 'g'))) AS content_hash, effective_date AS d FROM {CHUNKS} JOIN {DATES} USING (doc_id)),
b AS (SELECT content_hash, doc_id, any_value(d) AS d FROM c GROUP BY 1, 2),
f AS (SELECT content_hash, arg_min(struct_pack(i := doc_id, d := d), doc_id) AS f FROM b GROUP BY 1),
l AS (SELECT content_hash, doc_id FROM b WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY d DESC, doc_id) = 1),
w AS (SELECT content_hash, CASE WHEN f.d IS NULL THEN f.i ELSE l.doc_id END AS winner FROM f LEFT JOIN l USING (content_hash))
SELECT doc_id, idx, content_hash, doc_id = winner AS active FROM c JOIN w USING (content_hash)""")
simple("d5_near_dup_pairs", lambda t: dedup.near_dup_pairs(t("documents")), """
WITH s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))) AS s FROM documents), r AS (SELECT s, min(doc_id) AS doc_id FROM s WHERE len(s) > 0 GROUP BY s)
SELECT a, b, round(similarity, 6) AS similarity FROM (SELECT x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS similarity FROM r x JOIN r y ON x.doc_id < y.doc_id AND least(len(x.s), len(y.s)) >= 0.9 * greatest(len(x.s), len(y.s))) WHERE similarity >= 0.9""")
simple("d5_near_dup_members", lambda t: dedup.near_dup_members(t("documents")), "WITH s AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))) AS s FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS representative FROM s WHERE len(s) > 0")
simple("d9_event_counts", lambda t: dedup.event_counts(events(t), ["RETRIEVED", "CITED", "DEDUP_EXACT_SKIPPED"]), f"SELECT k AS event_type, (SELECT count(*) FROM {EVENTS} WHERE event_type = k) AS n FROM (VALUES ('RETRIEVED'), ('CITED'), ('DEDUP_EXACT_SKIPPED')) v(k)")
# retrieval
simple("f2_keyword_search", lambda t: retrieval.keyword_search(asked(t), t("documents")), """
WITH w AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS w FROM benchmark), p AS (SELECT query_id, i, w[i] AS term FROM w, generate_series(1, len(w)) g(i)),
u AS (SELECT query_id, term, min(i) AS i FROM p GROUP BY 1, 2), t AS (SELECT query_id, term FROM u), n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT query_id, doc_id, round(count(*) / max(n), 6) AS score FROM t JOIN n USING (query_id) JOIN documents ON contains(lower(text), term) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20""")
simple("f4_bm25_search", lambda t: text_index(t).search(asked(t)), f"WITH {BM25} SELECT * FROM bm")
simple("f5_dense_search", lambda t: search_index.dense_top(t("embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), t("embeddings")), """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM v q JOIN v ON q.vec_id % 25 = 0 AND q.vec_id <> v.vec_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 20""")
simple("f13_assemble_context", lambda t: retrieval.assemble_context(text_index(t).search(asked(t)).select("query_id", "doc_id", "rank"), t("documents")), f"""
WITH {BM25}, z AS (SELECT query_id, rank, bm.doc_id, length(text) AS size, 12000 - coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM bm JOIN documents USING (doc_id))
SELECT query_id, rank, doc_id, CAST(least(size, rest) AS BIGINT) AS taken FROM z WHERE rest > 200""")
# graph, access, rules, lineage
simple("g3_relations", lambda t: records.upsert_relations(t("customer").select(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").cast("string").alias("target"), F.lit("IN").alias("type"))), "SELECT c_mktsegment AS source, CAST(c_nationkey AS VARCHAR) AS target, 'IN' AS type, CAST(count(*) AS DOUBLE) AS weight FROM customer GROUP BY 1, 2")
simple("g5_neighbours", lambda t: records.neighbours(t("nation").select(F.col("n_name").alias("source"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("target")), t("region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("entity")), 3), "SELECT 'R' || n_regionkey AS entity, n_name AS neighbour FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) <= 3")
simple("h1_classify", lambda t: t("documents").select("doc_id", X.classify(F.col("text"), LANGS, "other").alias("label")), "WITH s AS (SELECT doc_id, " + ", ".join(f"{' + '.join(f'CAST(contains(lower(text), {k!r}) AS INT)' for k in ks)} AS {n}" for n, ks in LANGS.items()) + " FROM documents) SELECT doc_id, CASE WHEN greatest(english, french, german, spanish) = 0 THEN 'other' WHEN english >= greatest(french, german, spanish) THEN 'english' WHEN french >= greatest(german, spanish) THEN 'french' WHEN german >= spanish THEN 'german' ELSE 'spanish' END AS label FROM s")
H3_ROWS = ", ".join(f"('{i}', '{d}')" for i, ds in records.ALLOWED.items() for d in ds)
simple(
    "h3_can_access",
    lambda t: records.can_access(t("customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("tech", "ADMIN", "guest", "product"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("identity"), F.element_at(F.array(*map(F.lit, ("safety", "business", "management"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("sub_domain")), "identity", "sub_domain"),
    f"WITH m(i, d) AS (VALUES {H3_ROWS}), c AS (SELECT c_custkey, ['tech', 'ADMIN', 'guest', 'product'][c_custkey % 4 + 1] AS identity, ['safety', 'business', 'management'][c_custkey % 3 + 1] AS sub_domain FROM customer) SELECT c.*, EXISTS (SELECT 1 FROM m WHERE m.d = sub_domain AND m.i = CASE WHEN lower(identity) IN (SELECT i FROM m) THEN lower(identity) ELSE 'business' END) AS allowed FROM c",
)
simple("h4_bucket", lambda t: records.bucket_decision(t("customer"), "rollout", "c_custkey", 30, deny=["3"], allow=["5"]).select("c_custkey", "reason", "on"), "SELECT c_custkey, CASE c_custkey WHEN 3 THEN 'DENY' WHEN 5 THEN 'ALLOW' ELSE 'BUCKET' END AS reason, c_custkey = 5 OR (c_custkey <> 3 AND (CAST('0x' || substr(sha256('rollout:' || c_custkey), 1, 8) AS BIGINT) & 2147483647) % 100 < 30) AS \"on\" FROM customer")
simple("i7_run_rules", lambda t: records.run_rules(t("lineitem"), PROGRAM).select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"), "returned", "known", "dear", "status"), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_returnflag IN ('A', 'R') AS returned, l_linestatus IN ('O', 'F') AS known, l_extendedprice * (1 - l_discount) / l_quantity > 1000 AS dear, 'SUCCESS' AS status FROM lineitem")
simple("i6_material_diff", lambda t: t("part").select("p_partkey", F.explode(records.material_diff(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")), F.create_map(F.lit("brand"), F.lit("Brand#1"), F.lit("kind"), F.col("p_type")))).alias("d")).select("p_partkey", "d.*"), "SELECT p_partkey, 'brand' AS key, p_brand AS value_a, 'Brand#1' AS value_b, p_brand IS NOT DISTINCT FROM 'Brand#1' AS match FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), NULL, p_size IS NULL FROM part UNION ALL SELECT p_partkey, 'kind', NULL, p_type, p_type IS NULL FROM part")
simple("j1_latest_version", lambda t: records.latest_version(t("lineitem"), "l_orderkey", "l_linenumber"), "SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1")
simple("j5_version_diff", lambda t: records.version_diff(t("orders").where("o_orderpriority != '5-LOW'"), t("orders").where("o_orderstatus != 'P'").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))), "o_orderkey", "o_totalprice"), "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_totalprice AS value_a, b.p AS value_b, a.o_totalprice IS DISTINCT FROM b.p AS changed FROM (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderstatus <> 'P') b ON a.o_orderkey = b.o_orderkey")
# metrics
F4 = ", ".join(f"count(*) FILTER (event_type = '{k}') AS {n}" for k, n in (("RETRIEVED", "retrieved"), ("CITED", "cited"), ("FEEDBACK_USEFUL", "useful"), ("FEEDBACK_USELESS", "useless")))
simple("k1_snapshot", lambda t: metrics.knowledge_snapshot(events(t), ASOF), f"SELECT {F4}, count(DISTINCT chunk_id) AS chunks FROM {EVENTS} WHERE created_at BETWEEN TIMESTAMP '{ASOF}' - INTERVAL 30 DAY AND TIMESTAMP '{ASOF}'")
simple("k2_staleness", lambda t: metrics.staleness(S.engine_documents(t("documents")).select(F.col("doc_id").alias("chunk_id"), F.col("effective_date").alias("created_at")), events(t), ASOF), f"""
WITH r AS (SELECT chunk_id, count(*) AS recent FROM {EVENTS} WHERE event_type = 'RETRIEVED' AND created_at >= TIMESTAMP '{ASOF}' - INTERVAL 30 DAY GROUP BY 1),
s AS (SELECT doc_id AS chunk_id, coalesce(recent, 0) AS recent, floor((0.5 * coalesce(exp(-(DATE '2024-01-31' - effective_date) / 180.0), 0) + 0.5 * least(1.0, coalesce(recent, 0) / 5)) * 1000 + 0.5) / 1000 AS score FROM {DATES} LEFT JOIN r ON chunk_id = doc_id)
SELECT *, score < 0.3 AS stale FROM s""")
simple("k3_suspect_useless", lambda t: metrics.suspect_useless(events(t)), f"SELECT * FROM (SELECT chunk_id, retrieved, useful, useless, round(useless / (useful + useless), 6) AS ratio FROM (SELECT chunk_id, count(*) FILTER (event_type = 'RETRIEVED') AS retrieved, count(*) FILTER (event_type = 'FEEDBACK_USEFUL') AS useful, count(*) FILTER (event_type = 'FEEDBACK_USELESS') AS useless FROM {EVENTS} GROUP BY 1) WHERE retrieved > 0 AND useful + useless > 0) WHERE ratio > 0.5")
simple("k4_labelled_precision", lambda t: metrics.labelled_precision(events(t)), f"SELECT round(count(*) FILTER (event_type = 'FEEDBACK_USEFUL') / count(*), 6) AS precision, count(*) AS n FROM {EVENTS} WHERE event_type IN ('FEEDBACK_USEFUL', 'FEEDBACK_USELESS')")
simple("k8_chunk_metrics", lambda t: metrics.chunk_metrics(events(t)), f"SELECT chunk_id, {F4}, max(created_at) AS last_use FROM {EVENTS} GROUP BY 1")
simple("k10_count_by", lambda t: metrics.count_by(events(t), "event_type"), f"SELECT event_type, count(*) AS n FROM {EVENTS} GROUP BY 1")
simple("l2_field_accuracy", lambda t: metrics.rate(t("labels"), F.col("quality") == 1), "SELECT round(avg(CAST(quality = 1 AS INT)), 6) AS rate, count(*) AS n FROM labels")
simple("l3_retrieval_hit_rate", lambda t: metrics.retrieval_hit_rate(events(t)), f"WITH e AS (SELECT * FROM {EVENTS}), l AS (SELECT chunk_id, max(CAST(event_type = 'FEEDBACK_USEFUL' AS INT)) AS u FROM e WHERE event_type LIKE 'FEEDBACK%' GROUP BY 1) SELECT round(avg(u), 6) AS rate, count(*) AS n FROM e JOIN l USING (chunk_id) WHERE event_type = 'RETRIEVED'")
simple("l13_seven_metrics", lambda t: curation.report(t, retrieval_hits=metrics.retrieval_hit_rate(events(t)), citations=metrics.rate(curation.citations(t), F.col("resolvable") & F.col("consistent"))), f"{ENTRIES['l13_metric_report'][1]} UNION ALL SELECT 'retrieval_hits', '', rate, n FROM ({ENTRIES['l3_retrieval_hit_rate'][1]}) UNION ALL SELECT 'citations', '', rate, n FROM ({ENTRIES['l4_citation_rate'][1]})")
simple("l8_response_times", lambda t: metrics.response_times(S.engine_calls(t("lineitem"))), f"SELECT purpose, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, count(*) AS n FROM {CALLS} WHERE status = 'OK' GROUP BY 1")
simple("l9_cost_per_turn", lambda t: metrics.cost_per_turn(costed(t)), f"SELECT round(coalesce(sum(cost), 0) / nullif(count(*) FILTER (purpose = 'CHAT'), 0), 6) AS cost_per_turn FROM {COSTED}")
simple("l15_aggregate_scores", lambda t: metrics.aggregate_scores(t("lineitem").select(F.col("l_linestatus").alias("metric"), F.col("l_returnflag").alias("source"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("value"))), "SELECT l_linestatus AS metric, l_returnflag AS source, round(avg(v), 4) AS mean, count(v) AS scored, count(*) - count(v) AS missing, CAST(grouping(l_returnflag) AS INT) AS all_sources FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_discount END AS v FROM lineitem) GROUP BY GROUPING SETS ((l_linestatus), (l_linestatus, l_returnflag))")
simple("m1_estimate_cost", lambda t: costed(t).select("l_orderkey", "l_linenumber", F.round("cost", 6).alias("cost")), f"SELECT l_orderkey, l_linenumber, round(cost, 6) AS cost FROM {COSTED}")
simple("m2_call_counters", lambda t: metrics.call_counters(costed(t)), f"SELECT purpose, model, status, count(*) AS n, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out, round(sum(cost), 4) AS cost FROM {COSTED} GROUP BY 1, 2, 3")
# screening
PII_SQL = "text"
for _p in X.OUTPUT_PII:
    PII_SQL = f"regexp_replace({PII_SQL}, '{_p}', '[REDACTED]', 'g')"
simple("n2_redact_output", lambda t: t("documents").select("doc_id", X.redact_output(F.col("text")).alias("text")), f"SELECT doc_id, {PII_SQL} AS text FROM documents")
simple("n3_screen", lambda t: t("documents").select("doc_id", X.first_match(F.col("text"), X.PROTECTED).alias("protected"), X.first_match(F.col("text"), X.INJECTION).alias("injection")), "SELECT doc_id, " + ", ".join("CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {i}" for i, p in enumerate(ps, 1)) + f" END AS {n}" for n, ps in (("protected", X.PROTECTED), ("injection", X.INJECTION))) + " FROM documents")
simple("n3_violations", lambda t: t("documents").select("doc_id", F.inline(X.violations(F.col("text")))), " UNION ALL ".join(f"SELECT doc_id, '{n}' AS violation, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {i}" for i, p in enumerate(ps, 1)) + f" END AS pattern, CAST({risk} AS DOUBLE) AS risk FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in ps) for n, (ps, risk) in X.SCREENS.items()))
# conversations
simple("o1_sessions", lambda t: records.list_sessions(t("conversations")), "SELECT conv_id, count(*) AS messages, min(turn) AS first_turn, max(turn) AS last_turn, left(coalesce(arg_min(text, struct_pack(t := turn, x := text)) FILTER (role = 'user'), arg_min(text, struct_pack(t := turn, x := text))), 40) AS title FROM conversations GROUP BY 1")
simple("o3_pair_answers", lambda t: records.pair_answers(t("conversations")), "SELECT q.conv_id, q.turn, q.text AS question, (SELECT arg_min(a.text, a.turn) FROM conversations a WHERE a.conv_id = q.conv_id AND a.turn > q.turn AND a.role = 'assistant' AND trim(a.text) <> '') AS answer FROM conversations q WHERE role = 'user'")
simple("o4_recent_turns", lambda t: records.recent_turns(t("conversations"), 3), "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS rank FROM conversations QUALIFY rank <= 3")
# streaming forms over the table
simple("p1_event_counts", lambda t: streams.event_counts(events(t).withColumn("created_at", F.col("created_at").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz")), f"SELECT date_trunc('day', created_at) AS start, event_type, count(*) AS n FROM {EVENTS} GROUP BY 1, 2")
simple("p2_idempotent", lambda t: streams.idempotent(events(t)), f"SELECT DISTINCT * FROM {EVENTS}")


def reader(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """Tables by name; the long texts of documents are worked on by all cores, however they are stored."""
    return lambda name: spread(S.read_table(spark, sf_dir, name)) if name == "documents" else S.read_table(spark, sf_dir, name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned documents without exact copies, searched by the benchmark passages; ranked sources with the text they give."""
    t = reader(spark, sf_dir)
    docs = t("documents").withColumn("text", X.clean_text(F.col("text")))
    first = docs.groupBy(X.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    docs = stash(docs.join(first.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"))
    index = stored_index(docs, f"{sf_dir}#cleaned")
    hits = retrieval.rrf_fuse([index.search(asked(t)), retrieval.keyword_search(asked(t), docs)])
    return retrieval.assemble_context(hits.select("query_id", "doc_id", "rank"), docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda spark, sf_dir, run=run: run(reader(spark, sf_dir))) for name, (run, _) in ENTRIES.items()}
    return {"flagship": flagship} | made


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
