"""Registered queries over stored indexes, graph search and near duplicates by arrival, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import governance as G
from ..operators import graph_search, near_index, retrieval, search_index
from ..operators.verdicts import parse_filter
from ..session import shared_folder, stash
from ..sources import tables as S
from .base import asked, simple

BM25 = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS w FROM documents),
e AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w), p AS (SELECT term, doc_id, len, count(*) AS tf FROM e GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w WHERE len(w) > 0),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))) AS term FROM benchmark),
bs AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY 1, 2
), bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs QUALIFY rank <= 20)"""


def stored_index(docs: DataFrame, key: str, *columns: str) -> search_index.TextIndex:
    """The index of docs under a key, built once in a session and read by all queries that need it."""
    spark = docs.sparkSession
    held = spark.sparkContext.__dict__.setdefault("_millrace_indexes", {})
    if key not in held:
        held[key] = search_index.TextIndex(spark, f"{shared_folder(spark)}/millrace-index-{uuid.uuid4().hex}").build(docs, *columns)
    return held[key]


def text_index(t) -> search_index.TextIndex:
    """The index of the documents, with their source and language to filter by. The files they stand in are its key."""
    docs = t("documents")
    rows = docs.select("doc_id", "text", F.col("source").alias("domain_tag"), F.col("lang").alias("sub_domain_tag"))
    return stored_index(rows, "\n".join(sorted(docs.inputFiles())), "domain_tag", "sub_domain_tag")


# hybrid search, history, contexts
SUB_DOMAIN = "sub_domain_tag IN (en, fr) AND unknown = x"


def vectors(t) -> DataFrame:
    """The documents' vectors, with the columns to filter by, stored."""
    tags = t("documents").select(F.col("doc_id"), F.col("source").alias("domain_tag"), F.col("lang").alias("sub_domain_tag"))
    return stash(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(tags, "doc_id"))


def hybrid(t) -> DataFrame:
    queries = asked(t).join(t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left")
    return search_index.hybrid_search(queries, text_index(t), vectors(t), parse_filter(SUB_DOMAIN))


HYBRID = f"""{BM25},
bf AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs JOIN documents d USING (doc_id) WHERE d.lang IN ('en', 'fr') QUALIFY rank <= 20),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ds AS (
  SELECT b.item_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(x.e, v.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score
  FROM benchmark b JOIN v x ON x.vec_id = b.item_id JOIN v ON v.vec_id <> x.vec_id JOIN documents d ON d.doc_id = v.vec_id AND d.lang IN ('en', 'fr')
), df AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 20),
hs AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT * FROM bf UNION ALL SELECT * FROM df) GROUP BY 1, 2),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hs QUALIFY rank <= 10)"""
simple("f7_hybrid_search", hybrid, f"WITH {HYBRID} SELECT * FROM hy")


def history(t) -> DataFrame:
    events = t("embeddings").select("vec_id", "embedding", F.col("label").alias("user"))
    return search_index.dense_top(events.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "user"), events, 10, by="user")


simple("f16_history_search", history, """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score
  FROM v q JOIN v ON q.vec_id % 25 = 0 AND q.vec_id <> v.vec_id AND q.label = v.label
)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")


def sources(t) -> DataFrame:
    """Sources of the contexts of the passages; a document stands for itself, and its label for its metadata."""
    docs = t("documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("name"))
    tags = t("labels").groupBy("doc_id").agg(F.max("quality").alias("version"), F.max("toxic").alias("page_no"))
    first = t("documents").select("doc_id", F.left("text", F.lit(300)).alias("content"))
    children = first.join(tags, "doc_id").select(F.col("doc_id").alias("chunk_id"), "version", "page_no", "content", F.concat(F.lit("a"), F.col("doc_id")).alias("artifact_id"))
    hits = text_index(t).search(asked(t)).withColumn("chunk_id", F.col("doc_id"))
    return retrieval.source_rows(hits, docs, children)


SOURCES = f"""{BM25},
z AS (
  SELECT bm.*, text, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place,
    12000 - coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM bm JOIN documents USING (doc_id)
), l AS (SELECT doc_id, max(quality) AS version, max(toxic) AS page_no FROM labels GROUP BY 1),
so AS (
  SELECT query_id, place, doc_id, coalesce(version, 0) AS version, page_no, CASE WHEN l.doc_id IS NOT NULL THEN left(trim(regexp_replace(left(text, 300), '[\\r\\n]+', ' ', 'g'), ' '), 200) END AS snippet,
    CASE WHEN l.doc_id IS NOT NULL THEN 'a' || doc_id END AS artifact_id, score, CASE WHEN doc_id % 3 <> 0 THEN source ELSE '未知文档' END AS name,
    '[' || place || '] 来源: ' || CASE WHEN doc_id % 3 <> 0 THEN source ELSE '未知文档' END || chr(10) || left(text, CAST(least(length(text), rest) AS BIGINT)) || chr(10) || chr(10) AS block
  FROM z LEFT JOIN l USING (doc_id) WHERE rest > 200
)"""
simple("f13_source_rows", sources, f"WITH {SOURCES} SELECT * FROM so")


def contexts(t) -> DataFrame:
    notes = t("benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), F.concat(F.lit("note "), F.col("item_id")).alias("note"))
    return retrieval.context_of(sources(t), notes)


simple("f13_contexts", contexts, f"""
WITH {SOURCES} SELECT query_id, string_agg(block, '' ORDER BY place) || CASE WHEN query_id % 2 = 0 THEN 'note ' || query_id ELSE '' END AS context FROM so GROUP BY query_id""")


# graph
def graph(t) -> tuple[DataFrame, DataFrame]:
    """Parts as entities, under a name with their brand; lines of orders as relations from parts to what has the supplier's number."""
    part = t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), (F.col("p_partkey") % 100).alias("chunk_id"), (F.col("p_size") > 5).alias("active"))
    line = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_id"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_orderkey").alias("chunk_id"), (F.col("l_returnflag") != "R").alias("active"))
    return part, line


def probes(t) -> DataFrame:
    """Names, parts of names and of brands, two characters and one."""
    p = t("part")
    pieces = [F.col("p_name"), F.upper(F.substring("p_name", 3, 5)), F.concat_ws(" ", "p_name", "p_brand"), F.right("p_brand", F.lit(2)), F.left("p_type", F.lit(1)), F.lit("no such name")]
    return p.select(F.explode(F.array(*pieces)).alias("probe")).distinct()


def entity_rows(t) -> DataFrame:
    found = graph_search.entity_search(probes(t), *graph(t))
    row = lambda kind, key, place: found[kind].select(F.lit(kind).alias("kind"), "probe", F.col(key).cast("long").alias("id"), place.cast("int").alias("place"))
    none = F.lit(None)
    return row("entities", "id", F.col("rank")).unionByName(row("neighbours", "id", F.col("rank"))).unionByName(row("edges", "relation_id", none)).unionByName(row("chunks", "chunk_id", none))


GRAPH = """ent AS (SELECT p_partkey AS id, concat_ws(' ', p_name, p_brand) AS name, p_partkey % 100 AS chunk_id FROM part WHERE p_size > 5),
rel AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS relation_id, l_partkey AS source, l_suppkey AS target, l_orderkey AS chunk_id FROM lineitem WHERE l_returnflag <> 'R'),
fnd AS (SELECT probe, id, row_number() OVER (PARTITION BY probe ORDER BY id) AS rank FROM (SELECT DISTINCT probe FROM prb) JOIN ent ON contains(lower(name), lower(probe)) QUALIFY rank <= 5),
tie AS (SELECT probe, relation_id, target AS id, chunk_id FROM fnd JOIN rel ON rel.source = fnd.id UNION ALL SELECT probe, relation_id, source, NULL FROM fnd JOIN rel ON rel.target = fnd.id),
nbr AS (
  SELECT probe, id, row_number() OVER (PARTITION BY probe ORDER BY id) AS rank
  FROM (SELECT DISTINCT probe, id FROM tie WHERE (probe, id) NOT IN (SELECT probe, id FROM fnd) AND id IN (SELECT id FROM ent)) QUALIFY rank <= 10
), chk AS (SELECT probe, ent.chunk_id FROM fnd JOIN ent USING (id) UNION SELECT probe, chunk_id FROM tie WHERE chunk_id IS NOT NULL)"""
simple("g4_entity_search", entity_rows, f"""
WITH prb AS (
  SELECT DISTINCT unnest([p_name, upper(p_name[3:7]), concat_ws(' ', p_name, p_brand), right(p_brand, 2), left(p_type, 1), 'no such name']) AS probe FROM part
), {GRAPH}
SELECT 'entities' AS kind, probe, id, CAST(rank AS INT) AS place FROM fnd UNION ALL SELECT 'neighbours', probe, id, CAST(rank AS INT) FROM nbr
UNION ALL SELECT DISTINCT 'edges', probe, relation_id, CAST(NULL AS INT) FROM tie UNION ALL SELECT 'chunks', probe, chunk_id, CAST(NULL AS INT) FROM chk""")


def expanded(t) -> DataFrame:
    """Chunks that entities bring to the names of parts as questions; orders are chunks, and their lines what was found before."""
    queries = t("part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit(" "), "p_name").alias("text"))
    hits = t("lineitem").where("l_linestatus = 'O'").select(F.col("l_partkey").alias("query_id"), F.col("l_orderkey").alias("chunk_id"))
    chunks = t("orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderstatus") != "P").alias("active"))
    return graph_search.graph_expand(queries, hits, *graph(t), chunks)


simple("f11_graph_expand", expanded, f"""
WITH ask AS (
  SELECT p_partkey AS query_id, unnest(list_concat([p_name], regexp_extract_all(lower(p_name), '[a-z0-9_]{{2,}}'))) AS probe, generate_subscripts(list_concat([p_name], regexp_extract_all(lower(p_name), '[a-z0-9_]{{2,}}')), 1) - 1 AS pos FROM part
), prb AS (SELECT DISTINCT probe FROM ask), {GRAPH},
inj AS (
  SELECT query_id, chunk_id, min(pos) AS pos FROM ask JOIN chk USING (probe) WHERE chunk_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    AND (query_id, chunk_id) NOT IN (SELECT l_partkey, l_orderkey FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1, 2
)
SELECT query_id, chunk_id, CAST(0.5 AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY pos, chunk_id) AS place FROM inj QUALIFY place <= 20""")


# near duplicates in two batches
def two_batches(t) -> DataFrame:
    """What an index finds among texts without exact copies that arrive in two halves."""
    dates = S.engine_documents(t("documents"))
    kept = G.exact_copies(t("documents"), dates)[1]
    half = kept.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    texts = t("documents").select("doc_id", "text").join(kept, "doc_id", "left_semi")
    index = near_index.NearIndex(texts.sparkSession, f"{shared_folder(texts.sparkSession)}/millrace-near-{uuid.uuid4().hex}")
    first = index.add(0, texts.where(F.col("doc_id") <= half), dates)
    return first.unionByName(index.add(1, texts.where(F.col("doc_id") > half), dates))


simple("d8_near_dup_index", two_batches)
