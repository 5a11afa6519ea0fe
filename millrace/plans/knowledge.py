"""Registered queries of the operators in operators/knowledge.py, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import knowledge as K
from ..functions.replies import json_outer
from ..operators import metrics
from ..operators.retrieval import rrf_fuse
from .base import CHUNKS, EVENTS, events, simple
from ..sources import tables as S

ASOF = "2024-01-31 00:00:00"

simple("a6_json_outer", lambda t: t("events").select("event_id", json_outer(F.concat(F.lit("So: "), "props", F.lit(" ok")), "k int")["k"].alias("k")), """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")

BARE = lambda c: rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"
simple("b6_reconcile_pages", lambda t: K.reconcile_pages(t("part").select("p_partkey", F.col("p_name").alias("text"), F.col("p_type").alias("reading"), (F.col("p_size") / 50).alias("confidence"))), f"""
WITH p AS (SELECT p_partkey, p_name AS text, p_type AS reading, p_size / 50 AS confidence, {BARE('p_name')} AS a, {BARE('p_type')} AS b FROM part),
c AS (SELECT *, greatest(length(a), length(b)) > 0 AND 1 - levenshtein(a, b) / greatest(length(a), length(b)) < 0.85 AS conflict FROM p)
SELECT p_partkey, text, reading, confidence, conflict, CASE WHEN conflict AND confidence >= 0.8 THEN reading ELSE text END AS chosen FROM c""")

simple(
    "b10_render_template",
    lambda t: K.render_template(
        t("customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("code")),
        t("nation").select(F.col("n_nationkey").alias("code"), F.concat(F.lit("{c_name} of {segment} in "), "n_name").alias("body"), F.when(F.col("n_regionkey") < 3, "ACTIVE").otherwise("DRAFT").alias("status")),
        ["c_name", "segment"],
    ),
    """SELECT c_custkey, c_name, c_mktsegment AS segment, c_nationkey AS code, coalesce(c_name, '') || ' of ' || coalesce(c_mktsegment, '') || ' in ' || n_name AS rendered
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3""",
)

simple(
    "c3_map_pages",
    lambda t: K.map_pages(S.engine_chunks(t("documents")).select("doc_id", F.col("idx").alias("chunk_id"), "content"), S.engine_chunks(t("documents")).select("doc_id", F.col("idx").alias("page_no"), F.col("content").alias("text"))).select("doc_id", "chunk_id", "page_no"),
    rf"""WITH c AS (SELECT doc_id, idx, regexp_replace(content, '\s+', '', 'g') AS s FROM {CHUNKS}),
m AS (SELECT a.doc_id, a.idx, min(b.idx) AS page_no FROM c a JOIN c b USING (doc_id) WHERE length(a.s) >= 6 AND contains(b.s, left(a.s, 20)) GROUP BY 1, 2)
SELECT doc_id, c.idx AS chunk_id, page_no FROM c LEFT JOIN m USING (doc_id, idx)""",
)

simple("c7_delete_docs", lambda t: K.delete_docs(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), t("orders").where("o_orderstatus = 'F'"), "o_orderkey"), """
SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")

simple(
    "c8_set_effective_date",
    lambda t: K.set_effective_date(
        t("orders").select(
            "o_orderkey",
            F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date")).alias("existing"),
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 10 == 1, "x").otherwise("")).alias("asked"),
        ),
        "existing",
        "asked",
    ).select("o_orderkey", F.col("effective_date").cast("string").alias("effective_date"), "outcome"),
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 10 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS effective_date,
CASE WHEN o_orderstatus = 'F' THEN 'KEPT' WHEN o_orderkey % 10 <> 1 THEN 'SET' ELSE 'INVALID' END AS outcome FROM orders""",
)


def ranked(t, order):
    """For each kind of event its users in an order, as a ranked list."""
    rows = t("events").groupBy(F.col("event_type").alias("query_id"), F.col("user_id").alias("doc_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(order), "doc_id")))


LISTS = """g AS (SELECT event_type AS query_id, user_id AS doc_id, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2),
l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank FROM g
  UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, doc_id) FROM g)"""
simple("f6_rrf_fuse", lambda t: rrf_fuse([ranked(t, "n"), ranked(t, "v")]), f"""
WITH {LISTS}, s AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM l GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")

simple(
    "f9_acl_filter",
    lambda t: K.acl_filter(
        t("orders").select("o_orderkey", F.col("o_custkey").alias("chunk_id")),
        t("customer").select(F.col("c_custkey").alias("chunk_id"), (F.col("c_acctbal") > 0).alias("active")),
        t("customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("chunk_id"), (F.col("c_acctbal") > 1000).alias("active"), F.col("c_mktsegment").alias("domain")),
        {"domain": "BUILDING"},
    ),
    """SELECT o_orderkey, o_custkey AS chunk_id FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_acctbal > 0 AND (c_nationkey >= 20 OR (c_acctbal > 1000 AND c_mktsegment = 'BUILDING'))""",
)
HITS = "(SELECT user_id AS query_id, event_type AS parent_id, event_id AS child_index, round(value, 2) AS score, event_id AS place FROM events)"


def hits(t):
    return t("events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("parent_id"), F.col("event_id").alias("child_index"), F.round("value", 2).alias("score"), F.col("event_id").alias("place"))


simple("f10_accumulate", lambda t: K.accumulate(hits(t)), f"""
SELECT query_id, parent_id, min(place) AS place, max(score) AS score, (array_agg(child_index ORDER BY score DESC NULLS LAST, child_index))[1] AS child_index FROM {HITS} GROUP BY 1, 2""")
simple(
    "f12_apply_rerank",
    lambda t: K.apply_rerank(K.accumulate(hits(t)).drop("child_index"), t("events").where("value > 5").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("parent_id")).agg(F.count("*").alias("new_score"))),
    f"""WITH p AS (SELECT query_id, parent_id, min(place) AS place, max(score) AS score FROM {HITS} GROUP BY 1, 2),
s AS (SELECT user_id AS query_id, event_type AS parent_id, count(*) AS new_score FROM events WHERE value > 5 GROUP BY 1, 2),
j AS (SELECT p.*, new_score, count(*) OVER (PARTITION BY query_id) AS n, count(new_score) OVER (PARTITION BY query_id) AS k FROM p LEFT JOIN s USING (query_id, parent_id))
SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n >= 2 AND n = k THEN -new_score END, place, parent_id) AS place,
CAST(CASE WHEN n >= 2 AND n = k THEN new_score ELSE score END AS DOUBLE) AS score FROM j""",
)
simple("f15_record_retrieval", lambda t: K.record_retrieval(t("events").select(F.col("event_id").alias("chunk_id"), F.col("value").alias("similarity"))), """
SELECT event_id AS chunk_id, value AS similarity, e AS event_type FROM events, (VALUES ('RETRIEVED'), ('CITED')) x(e)""")
simple("f16_history_by_user", lambda t: K.history_by_user(t("events"), "user_id", "ts", "event_id", 5).select("user_id", "event_id", "rank"), """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 5""")

NODES = "(SELECT p_partkey AS id, p_partkey % 100 AS doc_id, p_brand AS type, p_size > 5 AS active FROM part)"
EDGES = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 100 AS doc_id, l_returnflag <> 'R' AS active FROM lineitem)"


def nodes(t):
    return t("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("doc_id"), F.col("p_brand").alias("type"), (F.col("p_size") > 5).alias("active"))


def edges(t):
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 100).alias("doc_id"), (F.col("l_returnflag") != "R").alias("active"))


def some_docs(t):
    return t("supplier").where("s_acctbal > 3000").select((F.col("s_suppkey") % 100).alias("doc_id"))


DOCS = "(SELECT s_suppkey % 100 AS doc_id FROM supplier WHERE s_acctbal > 3000)"
simple("g2_upsert_entities", lambda t: K.upsert_entities(t("part").select(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("type"), F.split("p_name", " ")[0].alias("description"), F.col("p_partkey").alias("order"))))
simple("g6_document_graph", lambda t: K.document_graph(nodes(t), edges(t), some_docs(t)), f"""
SELECT DISTINCT doc_id, 'NODE' AS kind, id FROM {NODES} WHERE active AND doc_id IN {DOCS} UNION ALL SELECT DISTINCT doc_id, 'EDGE', id FROM {EDGES} WHERE active AND doc_id IN {DOCS}""")
simple("g7_graph_stats", lambda t: K.graph_stats(nodes(t), edges(t)), f"""
SELECT (SELECT count(*) FROM {NODES} WHERE active) AS entities, (SELECT count(DISTINCT type) FROM {NODES} WHERE active) AS types, (SELECT count(*) FROM {EDGES} WHERE active) AS relations""")
simple("g8_deactivate_graph", lambda t: K.deactivate_graph(edges(t), some_docs(t)), f"SELECT doc_id, id, active AND doc_id NOT IN {DOCS} AS active FROM {EDGES}")

simple(
    "h2_tag_chunks",
    lambda t: K.tag_chunks(S.engine_chunks(t("documents")).where("idx = 0").select("doc_id", F.col("doc_id").alias("chunk_id"), "content"), t("labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")), t("labels").groupBy("doc_id").agg(F.when(F.max("quality") == 1, "good").otherwise("poor").alias("domain"))),
    f"""SELECT c.doc_id, c.doc_id AS chunk_id, coalesce(d.domain, 'general') AS domain, left(content, 200) AS snippet FROM {CHUNKS} c
LEFT JOIN (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'good' ELSE 'poor' END AS domain FROM labels GROUP BY 1) d ON d.doc_id = c.doc_id
WHERE idx = 0 AND c.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
simple("h5_newest_first", lambda t: K.newest_first(t("events"), F.col("event_type") == "error", "ts", "event_id", 1, 50).select("event_id", "place"), """
SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'error' QUALIFY place BETWEEN 51 AND 100""")

simple(
    "i9_rule_set_lifecycle",
    lambda t: K.rule_set_lifecycle(t("lineitem").groupBy(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("version")).agg(F.min("l_returnflag").alias("body"), (F.min("l_linestatus") == "F").alias("published"))),
    """WITH v AS (SELECT l_orderkey AS code, l_linenumber AS version, sha256(min(l_returnflag)) AS checksum, min(l_linestatus) = 'F' AS published FROM lineitem GROUP BY 1, 2)
SELECT code, version, checksum, checksum IS DISTINCT FROM lag(checksum) OVER (PARTITION BY code ORDER BY version) AS changed,
CASE WHEN NOT published THEN 'DRAFT' WHEN version = max(version) FILTER (WHERE published) OVER (PARTITION BY code) THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status FROM v""",
)
simple(
    "i11_assemble_extraction",
    lambda t: K.assemble_extraction(t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("value"), (F.col("l_discount") * 20 - 0.25).alias("confidence"), F.col("l_linenumber").alias("page_no"), (F.col("l_linestatus") == "O").alias("required"), F.lit(4).alias("pages")), "pages").select("l_orderkey", "l_linenumber", F.round("confidence", 6).alias("confidence"), "page_no", "reasons"),
    """WITH v AS (SELECT *, greatest(0.0, least(1.0, l_discount * 20 - 0.25)) AS sure FROM lineitem)
SELECT l_orderkey, l_linenumber, round(sure, 6) AS confidence, CASE WHEN l_linenumber <= 4 THEN l_linenumber END AS page_no,
concat_ws(',', CASE WHEN sure < 0.75 THEN 'LOW_CONFIDENCE' END, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'MISSING_REQUIRED' END) AS reasons FROM v""",
)
simple("j6_artifact_register", lambda t: K.artifact_register(S.engine_chunks(t("documents")).select("doc_id", F.lit(1).alias("version"), F.lit("OCR").alias("type"), F.col("idx").alias("page_no"), "content")), f"""
SELECT doc_id, 1 AS version, 'OCR' AS type, idx AS page_no, sha256(min(content)) AS sha256, CAST(strlen(min(content)) AS BIGINT) AS size FROM {CHUNKS} GROUP BY doc_id, idx""")
simple("j7_output_to_lineage", lambda t: K.output_to_lineage(t("orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority")), ["o_orderkey"], ["o_orderstatus", "priority"]), """
SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS value, 'RULE' AS source, 'RULED' AS edge FROM orders WHERE o_orderstatus IS NOT NULL
UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, 'RULE', 'RULED' FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IS NOT NULL""")

simple(
    "k6_dashboard_30d",
    lambda t: K.dashboard_30d(metrics.knowledge_snapshot(events(t), ASOF).select("retrieved", "cited"), metrics.staleness(t("customer").select(F.col("c_custkey").alias("chunk_id"), F.lit("2023-06-01").cast("date").alias("created_at")), events(t), ASOF), metrics.labelled_precision(events(t))),
    f"""WITH s AS (SELECT count(*) FILTER (WHERE event_type = 'RETRIEVED') AS retrieved, count(*) FILTER (WHERE event_type = 'CITED') AS cited FROM {EVENTS}
  WHERE created_at BETWEEN TIMESTAMP '{ASOF}' - INTERVAL 30 DAY AND TIMESTAMP '{ASOF}'),
r AS (SELECT chunk_id, count(*) AS n FROM {EVENTS} WHERE event_type = 'RETRIEVED' AND created_at >= TIMESTAMP '{ASOF}' - INTERVAL 30 DAY GROUP BY 1),
f AS (SELECT floor((0.5 * exp(-(DATE '{ASOF[:10]}' - DATE '2023-06-01') / 180) + 0.5 * least(1.0, coalesce(n, 0) / 5)) * 1000 + 0.5) / 1000 AS score FROM customer LEFT JOIN r ON chunk_id = c_custkey),
p AS (SELECT count(*) FILTER (WHERE event_type = 'FEEDBACK_USEFUL') AS u, count(*) FILTER (WHERE event_type = 'FEEDBACK_USELESS') AS w FROM {EVENTS})
SELECT retrieved, cited, (SELECT count(*) FROM f WHERE score < 0.3) AS stale, round(u / nullif(u + w, 0), 6) AS precision, u + w AS labelled FROM s, p""",
)
simple("k7_dashboard_7d", lambda t: K.dashboard_7d(events(t), ASOF), f"""
SELECT count(*) FILTER (WHERE event_type = 'RETRIEVED') AS retrieved, count(*) FILTER (WHERE event_type = 'CITED') AS cited, count(*) FILTER (WHERE event_type = 'FEEDBACK_USEFUL') AS useful,
count(*) FILTER (WHERE event_type = 'FEEDBACK_USELESS') AS useless, count(DISTINCT chunk_id) AS chunks FROM {EVENTS} WHERE created_at > TIMESTAMP '{ASOF}' - INTERVAL 7 DAY AND created_at <= TIMESTAMP '{ASOF}'""")
simple("k9_feedback_stats", lambda t: K.feedback_stats(events(t)), f"""
SELECT chunk_id, count(*) FILTER (WHERE event_type = 'FEEDBACK_USEFUL') AS useful, count(*) FILTER (WHERE event_type = 'FEEDBACK_USELESS') AS useless FROM {EVENTS}
WHERE event_type LIKE 'FEEDBACK%' GROUP BY 1""")
simple("l1_eval_window", lambda t: t("events").where(K.in_window(F.col("ts"), "2024-01-05 00:00:00", ASOF)).groupBy("event_type").agg(F.count("*").alias("n")), f"""
SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '{ASOF}' GROUP BY 1""")

# lookarounds are beyond the twin's expressions: tests hold masks against a plain search
simple("n1_mask_pii", lambda t: t("documents").select("doc_id", X.mask_pii(F.col("text")).alias("text")))


def screened(t):
    text = F.col("text")
    return K.screen_chain(t("conversations"), "text", [("mask", text.rlike(r"\d{4}"), False), ("question", text.rlike(r"\?"), True), ("long", F.length(text) > 120, True)])


CHAIN = r"""(SELECT conv_id, turn, regexp_matches(text, '\d{4}') AS a, contains(text, '?') AS b, length(text) > 120 AS c FROM conversations)"""
simple("n4_screen_chain", lambda t: screened(t).select("conv_id", "turn", "blocked", F.size("audit").cast("long").alias("audits"), F.array_join(F.transform("audit", lambda x: x["result"]), ",").alias("results")), f"""
SELECT conv_id, turn, coalesce(b OR c, false) AS blocked, CAST(CASE WHEN b THEN 2 ELSE 3 END AS BIGINT) AS audits,
concat_ws(',', CASE WHEN a THEN 'SANITIZE' ELSE 'PASS' END, CASE WHEN b THEN 'BLOCK' ELSE 'PASS' END, CASE WHEN coalesce(b, false) THEN NULL WHEN c THEN 'BLOCK' ELSE 'PASS' END) AS results FROM {CHAIN}""")
simple("n5_screening_report", lambda t: K.screening_report(screened(t)), f"""
SELECT 'mask' AS detector, CASE WHEN a THEN 'SANITIZE' ELSE 'PASS' END AS result, count(*) AS n FROM {CHAIN} GROUP BY ALL
UNION ALL SELECT 'question', CASE WHEN b THEN 'BLOCK' ELSE 'PASS' END, count(*) FROM {CHAIN} GROUP BY ALL
UNION ALL SELECT 'long', CASE WHEN c THEN 'BLOCK' ELSE 'PASS' END, count(*) FROM {CHAIN} WHERE NOT coalesce(b, false) GROUP BY ALL""")
simple("o2_session_messages", lambda t: K.session_messages(t("events"), "user_id", "event_id", "props", "k int").select("user_id", "event_id", "place", F.col("typed.k").alias("k")), """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
