"""Registered queries of operators/verdicts.py, operators/chunks.py and streaming/state.py, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import governance as G
from ..operators import verdicts as V
from ..session import dealt
from ..streaming import state
from .base import simple

# chunks and tables
def versioned(t):
    return t("documents").select("doc_id", (F.col("doc_id") % 3).alias("version"), "text")


simple("c1_split_chunks", lambda t: C.split_chunks(t("documents")))
simple("c2_parent_child", lambda t: C.parent_child_chunks(versioned(t)))
simple("c5_ingest", lambda t: C.ingest(versioned(t), t("labels").where("doc_id % 10 = 0"))[1])


#: Cells that a line becomes, about.
CELLS = 6


def cells(t):
    grid = "explode(sequence(0, 2)) AS row"
    # a line becomes six cells or more, which stay in the tasks that the lines are dealt to
    lines = dealt(t("lineitem"), CELLS * t("lineitem").count(), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("l_linestatus"), F.min("l_partkey").alias("l_partkey"))
    rows = lines.where("l_linenumber != 4 OR l_orderkey % 2 = 0").selectExpr("l_orderkey", "l_linenumber", "l_linestatus", "l_partkey", grid)
    rows = rows.selectExpr("*", "explode(sequence(0, IF(l_orderkey % 5 = 0 AND l_linenumber = 2, 2, 1))) AS col")
    text = "IF(row = 0, concat(' ', l_linestatus, col), concat_ws(':', l_partkey, row, col)) AS text"
    return rows.selectExpr("l_orderkey AS doc_id", "l_linenumber AS page_no", "row", "col", text)


simple("c4_stitch_tables", lambda t: C.stitch_tables(cells(t), CELLS * t("lineitem").count()), """
WITH l AS (SELECT l_orderkey AS d, l_linenumber AS p, min(l_linestatus) AS s, min(l_partkey) AS k,
    CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 2 THEN 3 ELSE 2 END AS w
  FROM lineitem WHERE l_linenumber <> 4 OR l_orderkey % 2 = 0 GROUP BY l_orderkey, l_linenumber),
g AS (SELECT *, CASE WHEN lag(p) OVER (PARTITION BY d ORDER BY p) = p - 1 THEN NULL ELSE p END AS opens FROM l),
r AS (SELECT d, p, s, k, w, max(opens) OVER (PARTITION BY d ORDER BY p) AS f FROM g),
h AS (SELECT r.*, (r.p > r.f AND r.s = a.s AND r.w = a.w)::INT AS again FROM r JOIN r a ON a.d = r.d AND a.p = r.f),
t AS (SELECT d, f, max(w) AS width, max(w) <> min(w) OR max(again) = 1 AS ambiguous FROM h GROUP BY d, f),
o AS (SELECT h.*, width, ambiguous, sum(3 - again) OVER (PARTITION BY d, f ORDER BY p) - 3 + again AS before FROM h JOIN t USING (d, f))
SELECT d AS doc_id, f AS first_page, p AS page_no, before - again + i AS row, c AS col,
  CASE WHEN i = 0 THEN ' ' || s || c ELSE k || ':' || i || ':' || c END AS text, width, ambiguous
FROM o, range(3) g(i), range(3) m(c) WHERE c < w AND (i > 0 OR again = 0)""")

simple(
    "c6_reparse",
    lambda t: C.reparse(
        t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("version"), F.when(F.col("l_linenumber") % 3 == 1, "ACTIVE").otherwise("SUPERSEDED").alias("status")),
        t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id")),
    ),
    """
WITH v AS (SELECT l_orderkey AS doc_id, l_linenumber AS version, CASE WHEN l_linenumber % 3 = 1 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status FROM lineitem),
a AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F')
SELECT doc_id, version, CASE WHEN doc_id IN (FROM a) THEN 'SUPERSEDED' ELSE status END AS status, NULL AS parent FROM v
UNION ALL SELECT doc_id, max(version) + 1, 'ACTIVE', max(version) FROM v WHERE doc_id IN (FROM a) GROUP BY 1""",
)

# conflicts
def reply(t):
    """Replies about pairs of parts: some deny, some name the pair in either order, some name another chunk, some are no JSON."""
    case = F.col("p_partkey") % 7
    ids = F.when(case == 1, F.concat(F.lit(', "chunkIdA": "'), "p_brand", F.lit('", "chunkIdB": "'), "p_type", F.lit('"')))
    ids = ids.when(case == 2, F.concat(F.lit(', "chunkIdA": "'), "p_type", F.lit('", "chunkIdB": "'), "p_brand", F.lit('"')))
    ids = ids.when(case == 3, F.concat(F.lit(', "chunkIdA": "'), "p_brand", F.lit('"'))).otherwise("")
    body = F.concat(F.lit('So {"conflict": '), F.when(case == 4, '"true"').when(case == 5, "false").otherwise("true"), ids, F.lit(', "entity": "'), "p_name", F.lit('", "attribute": "size", "valueA": "'), "p_size", F.lit('", "valueB": "x"} ok'))
    return t("part").select("p_partkey", F.col("p_brand").alias("a"), F.col("p_type").alias("b"), F.when(case == 6, F.lit("none {")).otherwise(body).alias("reply"))


simple("e5_parse_verdicts", lambda t: V.parse_verdicts(reply(t)), """
SELECT p_partkey, p_brand AS a, p_type AS b, p_name AS entity, 'size' AS attribute,
  CASE WHEN p_partkey % 7 = 2 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS value_a,
  CASE WHEN p_partkey % 7 = 2 THEN CAST(p_size AS VARCHAR) ELSE 'x' END AS value_b
FROM part WHERE p_partkey % 7 < 3""")


def judged_pairs(t):
    return t("lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 9).alias("a"), (F.col("l_partkey") % 9).alias("b"), F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("entity"), F.when(F.col("l_tax") > 0, F.col("l_linestatus")).alias("attribute"))


simple("e3_conflict_groups", lambda t: V.conflict_groups(judged_pairs(t)), """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS q, lower(l_returnflag) || '::' || CASE WHEN l_tax > 0 THEN lower(l_linestatus) ELSE '' END AS t, l_suppkey % 9 AS a, l_partkey % 9 AS b FROM lineitem),
u AS (SELECT * FROM e UNION SELECT q, t, b, a FROM e),
r AS (SELECT q, t, a AS x, a AS y FROM u UNION SELECT r.q, r.t, r.x, u.b FROM r JOIN u ON u.q = r.q AND u.t = r.t AND u.a = r.y)
SELECT q AS query_id, t AS topic, x AS chunk_id, min(y) AS group_id FROM r GROUP BY 1, 2, 3""")


def vectors(t):
    """Vectors as chunks of two domains; the rows with vec_id % 3 = 0 lie in one that is much the larger."""
    domain = F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b")
    return t("embeddings").where("vec_id is not null").select(domain.alias("domain"), (F.col("vec_id") % 2).cast("string").alias("sub_domain"), F.col("vec_id").alias("chunk_id"), "embedding", F.when(F.col("vec_id") % 5 == 0, "不是").otherwise("是").alias("content"))


simple("e1_conflict_scan", lambda t: V.conflict_scan(vectors(t), least=0.3).withColumn("similarity", F.round("similarity", 6)), """
WITH v AS (SELECT CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS domain, CAST(vec_id % 2 AS VARCHAR) AS sub_domain, vec_id,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT domain, sub_domain, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)
SELECT a.domain, a.sub_domain, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 6) AS similarity, CASE WHEN (a.vec_id % 5 = 0) <> (b.vec_id % 5 = 0) THEN 'CONFLICT' ELSE 'REDUNDANT' END AS hint
FROM n a JOIN n b ON a.domain = b.domain AND a.sub_domain = b.sub_domain AND a.vec_id < b.vec_id AND list_dot_product(a.e, b.e) > 0.3""")


def hits(t):
    texts = vectors(t).select("chunk_id", "embedding", F.concat("content", F.lit(" "), F.col("chunk_id").cast("string")).alias("content"))
    return texts.select(F.floor(F.col("chunk_id") / 10).alias("query_id"), "chunk_id", "embedding", "content")


simple("e2_conflict_candidates", lambda t: G.conflict_candidates(hits(t), 0.1), """
WITH v AS (SELECT vec_id // 10 AS q, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT a.q AS query_id, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.q = b.q AND a.vec_id < b.vec_id
WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.1""")

# retrieval and graph
FILTERS = ("domain = 'src1' AND subDomain IN ('en', \"de\") and owner = 'x'", "identity == staff")


def filtered(t):
    staff = F.when(F.col("doc_id") % 2 == 0, "staff").alias("required_identity")
    return t("documents").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")).alias("domain_tag"), F.col("lang").alias("sub_domain_tag"), staff)


simple("f8_parse_filter", lambda t: filtered(t).where(V.parse_filter(*FILTERS)).select("doc_id"), """
SELECT doc_id FROM documents WHERE doc_id % 3 = 1 AND lang IN ('en', 'de') AND doc_id % 2 = 0""")


def contexts(t):
    samples = t("lineitem").groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("place")).agg(F.min("l_partkey").alias("doc_id"))
    part = t("part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_type", "p_brand")
    parents = part.selectExpr("doc_id", "stack(2, 0, p_name, 1, concat(' ', p_type, ' ')) AS (parent_index, content)")
    return V.judge_context(samples, parents, part.where("doc_id % 4 != 0").selectExpr("doc_id", "p_brand AS name"), 250)


simple("f14_judge_context", contexts, """
WITH s AS (SELECT l_orderkey AS o, l_linenumber AS n, chr(10) || '【来源文档：' || CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE CAST(l_partkey AS VARCHAR) END || '】' || chr(10) || coalesce(trim(p_name) || chr(10) || trim(p_type) || chr(10), '') AS x
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) LEFT JOIN part ON p_partkey = l_partkey),
c AS (SELECT *, string_agg(x, '') OVER (PARTITION BY o ORDER BY n) AS upto FROM s),
f AS (SELECT *, length(upto) - length(x) AS start FROM c),
k AS (SELECT o, n, CASE WHEN length(upto) <= 250 THEN x ELSE left(x, 250 - start) || chr(10) || '…(已截断)' || chr(10) END AS x FROM f WHERE length(upto) <= 250 OR 250 - start > 100)
SELECT o AS sample_id, trim(coalesce((SELECT string_agg(x, '' ORDER BY n) FROM k WHERE k.o = d.o), ''), chr(10) || ' ') AS context FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem) d""")


def extracted(t):
    kind = F.when(F.col("p_partkey") % 3 == 0, "产品").otherwise("thing")
    entity = F.struct(F.concat(F.lit(" "), "p_name").alias("name"), kind.alias("type"), F.col("p_type").alias("description"))
    brand = F.struct(F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_brand")).alias("name"), F.lit("组织").alias("type"), F.lit(None).cast("string").alias("description"))
    link = F.struct(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.when(F.col("p_partkey") % 2 == 0, "属于").otherwise("of").alias("type"), F.lit("d").alias("description"))
    body = F.to_json(F.struct(F.array(entity, brand).alias("entities"), F.array(link).alias("relations")))
    return t("part").select(F.col("p_partkey").alias("chunk_id"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply"))


simple("g1_entities", lambda t: V.parse_extractions(extracted(t))[0], """
SELECT p_partkey AS chunk_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN '产品' ELSE '其他' END AS type, p_type AS description FROM part
UNION ALL SELECT p_partkey, p_brand, '组织', '' FROM part WHERE p_partkey % 5 <> 0""")
simple("g1_relations", lambda t: V.parse_extractions(extracted(t))[1], """
SELECT p_partkey AS chunk_id, p_name AS source, p_brand AS target, CASE WHEN p_partkey % 2 = 0 THEN '属于' ELSE '其他' END AS type, 'd' AS description FROM part WHERE p_partkey % 5 <> 0""")

# rules and golden sets
NET = {"steps": [{"op": "arith", "params": {"expr": "price * (1 - rate)"}, "to": "net"}, {"op": "compare", "params": {"field": "price", "cmp": ">", "right": 30000}, "to": "dear"}], "outputs": ["net", "dear"]}


def runs(t):
    price = F.when(F.col("l_linenumber") == 2, F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice"))
    given = F.to_json(F.struct(F.col("l_extendedprice").alias("price"), F.lit(0.5).alias("rate")))
    given = F.when(F.col("l_linenumber") == 3, F.lit("{broken")).otherwise(given)
    out = F.to_json(F.struct((price * 0.5).alias("net"), F.lit("x").alias("gone")))
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), given.alias("input"), out.alias("output"))


simple("i8_replay_rules", lambda t: V.replay_rules(runs(t), NET, "price double, rate double").select("run_id", "status", "key", "changed"), """
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS run_id, l_linenumber AS n FROM lineitem)
SELECT run_id, 'SUCCESS' AS status, key, CASE key WHEN 'net' THEN n = 2 ELSE true END AS changed FROM l, (VALUES ('net'), ('gone'), ('dear')) k(key) WHERE n <> 3
UNION ALL SELECT run_id, 'FAILED', NULL, NULL FROM l WHERE n = 3""")


def golden(t):
    expected = F.when(F.col("l_linenumber") == 1, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("net"), (F.col("l_extendedprice") * 0.5).cast("string"), F.lit("dear"), F.lit("true"), F.when(F.col("l_linenumber") == 2, "gone").otherwise("net2"), F.lit("1"))
    )
    plain = F.create_map(F.lit("net"), (F.col("l_extendedprice") * 0.5).cast("string"), F.lit("dear"), (F.col("l_extendedprice") > 30000).cast("string"))
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), F.col("l_extendedprice").alias("price"), F.lit(0.5).alias("rate"), F.when(F.col("l_linenumber") > 3, plain).otherwise(expected).alias("expected"))


simple("l11_rule_golden", lambda t: V.rule_golden(golden(t), NET), """
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS case_id, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber > 3 OR l_extendedprice > 30000 THEN 2 ELSE 1 END AS matched,
  CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber > 3 THEN 2 ELSE 3 END AS total FROM lineitem)
SELECT *, CASE WHEN total = 0 THEN 0 ELSE round(matched / total, 6) END AS score, matched = total AS passed FROM l""")


def parse_cases(t):
    cases = t("part").select(F.col("p_partkey").alias("case_id"), F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 4 != 0, F.array("p_brand", F.lit("a"), F.lit("STEEL"))).alias("contains"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 5).alias("pages"), F.when(F.col("p_size") % 2 == 0, F.lit(4)).alias("table_rows"))
    parsed = t("part").where("p_partkey % 6 != 0").select(F.col("p_partkey").alias("doc_id"), F.concat("p_type", "p_brand").alias("text"), (F.col("p_size") % 4).alias("pages_found"), F.when(F.col("p_size") % 8 < 5, F.col("p_size") % 8).alias("rows_found"))
    return V.parse_golden(cases, parsed)


simple("l12_parse_golden", parse_cases, """
WITH p AS (SELECT *, p_partkey % 6 <> 0 AS there, p_size % 4 <> 0 AS asks, p_size % 3 <> 0 AS paged, p_size % 2 = 0 AS tabled, p_partkey % 6 <> 0 AND p_size % 8 < 5 AS found FROM part),
c AS (SELECT p_partkey AS case_id,
  CASE WHEN there AND asks THEN 1 + contains(p_type || p_brand, 'a')::INT + contains(p_type || p_brand, 'STEEL')::INT ELSE 0 END
    + (paged AND p_size % 5 = CASE WHEN there THEN p_size % 4 ELSE 0 END)::INT + (tabled AND found AND p_size % 8 = 4)::INT AS passed_checks,
  3 * asks::INT + paged::INT + (tabled AND found)::INT AS total, tabled AND NOT found AS no_table FROM p)
SELECT case_id, passed_checks, total, CASE WHEN total = 0 THEN 0 ELSE round(passed_checks / total, 6) END AS score, passed_checks = total AND NOT no_table AS passed FROM c""")


def verdict_replies(t):
    n = F.col("doc_id") % 6
    said = lambda c: F.when(n == 3, "null").when(n == 4, F.concat(F.lit('" True"'))).otherwise(F.when(F.col(c) == 1, "true").otherwise("false"))
    body = F.concat(F.lit('{"faithfulness": '), said("quality"), F.lit(', "relevance": '), F.when(n == 3, '"maybe"').otherwise(said("toxic")), F.lit(', "reason": "r"}'))
    return t("labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("id"), F.when(n == 2, F.lit("no idea")).otherwise(body).alias("reply"))


simple("l21_apply_verdicts", lambda t: V.apply_verdicts(t("labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4).alias("attempts")), verdict_replies(t)), """
WITH l AS (SELECT doc_id AS id, doc_id % 4 + 1 AS attempts, doc_id % 6 IN (0, 1, 4, 5) AND quality IS NOT NULL AS judged, doc_id % 6 = 4 AS quoted, coalesce(quality = 1, false) AS q, coalesce(toxic = 1, false) AS x FROM labels)
SELECT id, attempts, CASE WHEN judged THEN quoted OR q END AS faithful, CASE WHEN judged THEN quoted OR x END AS relevant, CASE WHEN judged THEN 'r' END AS reason,
  CASE WHEN judged THEN 'JUDGED' WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status FROM l""")
simple("b9_normalise_samples", lambda t: V.normalise_samples(t("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.when(F.col("role") == "user", F.col("role")).alias("source"), F.when(F.col("turn") > 1, F.array("role")).alias("tags"))), """
SELECT conv_id || '-' || turn AS id, text AS question, [] AS contexts, CASE WHEN turn > 1 THEN [role] ELSE [] END AS tags, '' AS answer, '' AS reference,
  CASE WHEN role = 'user' THEN role ELSE 'seed-manual' END AS source, 'simple' AS difficulty, 'approved' AS "reviewStatus", 'manual' AS "answerOrigin",
  NULL AS domain, NULL AS "sourceRef", NULL AS "reviewedBy", NULL AS "reviewedAt", NULL AS note FROM conversations""")

# versions, lineage and tasks
simple("j1_list_versions", lambda t: V.list_versions(t("lineitem"), "l_orderkey", "l_linenumber"), """
SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS INT) AS place FROM lineitem""")
simple("j4_field_lineage", lambda t: V.field_lineage(t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("field_key"), "l_linenumber"), t("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("field_key"))), """
SELECT 'edge' AS kind, l_orderkey AS doc_id, l_returnflag AS field_key, '{"doc_id":' || l_orderkey || ',"field_key":"' || l_returnflag || '","l_linenumber":' || l_linenumber || '}' AS payload FROM lineitem
UNION ALL SELECT 'version', o_orderkey, o_orderstatus, '{"doc_id":' || o_orderkey || ',"field_key":"' || o_orderstatus || '"}' FROM orders""")


def tasks(t):
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "F", "PENDING").otherwise("DONE")
    queued = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY"))
    return t("orders").select("o_orderkey", F.col("o_custkey").alias("tenant"), status.alias("status"), F.col("o_orderdate").alias("next_run_at"), queued.alias("queued_at"))


simple("k11_running_by_tenant", lambda t: V.running_by_tenant(tasks(t)), "SELECT o_custkey AS tenant, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
simple("k13_stuck_tasks", lambda t: V.stuck_tasks(tasks(t), F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey"), """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1997-01-01' AND (o_orderkey % 3 = 0 OR o_orderdate - INTERVAL 1 DAY < TIMESTAMP '1996-01-01')""")

# stateful streams over the table
simple("p3_rate_audit", lambda t: state.rate_audit(t("events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").alias("at")), 1))


def deltas(t):
    last = F.col("role") == "assistant"
    return t("conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("text").alias("delta"), last.alias("done"))


simple("p5_answers", lambda t: state.answers_of(deltas(t)), """
WITH e AS (SELECT conv_id, min(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT conv_id AS session, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations JOIN e USING (conv_id) WHERE turn <= last GROUP BY 1""")
simple("p6_recent_turns", lambda t: state.recent_turns(t("conversations"), 4), """
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS rank FROM conversations QUALIFY rank <= 4""")
