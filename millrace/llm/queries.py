"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import bpe, collocations, decontaminate, embedding_dedup, fill_middle, html_extract, line_dedup, ngram_join, quality, secrets, token_counts, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; long texts are worked on by all cores, however they are stored."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its text without later repeats, and how many lines went."""
    found = line_dedup.delete_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("_lines_removed").cast("long").alias("lines_removed"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, hash(text) AS t, CAST(i AS BIGINT) AS line, trim(s[i], ' ') AS s, len(regexp_extract_all(s[i], '[^\t-\r ]+')) AS words
  FROM (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS s FROM documents) d, generate_series(1, len(s)) g(i)
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY line) AS pos, sum(words) OVER (PARTITION BY doc_id, t ORDER BY line) AS ends
  FROM l WHERE words > 0
), v AS (
  SELECT *, list(s) OVER a AS g, max(ends) OVER a - (ends - words) AS total FROM w
  WINDOW a AS (PARTITION BY doc_id, t ORDER BY ends - words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), f AS (
  SELECT *, first_value(struct_pack(d := doc_id, t := t, p := pos)) OVER (PARTITION BY g ORDER BY doc_id, t, pos) AS o FROM v WHERE total >= 50
), a AS (
  SELECT DISTINCT doc_id, t, o.d AS d0, o.t AS t0, pos - o.p AS shift FROM f WHERE (doc_id, t, pos) IS DISTINCT FROM (o.d, o.t, o.p)
), e AS (
  SELECT a.*, w.line, w.words, w.pos - row_number() OVER (PARTITION BY a.doc_id, a.t, a.d0, a.t0, a.shift ORDER BY w.pos) AS run
  FROM a JOIN w ON w.doc_id = a.doc_id AND w.t = a.t JOIN w AS w0 ON w0.doc_id = a.d0 AND w0.t = a.t0 AND w0.pos = w.pos - a.shift AND w0.s = w.s
), r AS (
  SELECT doc_id, t, min(line) AS lo, max(line) AS hi FROM e GROUP BY doc_id, t, d0, t0, shift, run HAVING sum(words) >= 50
), x AS (SELECT doc_id, t, list(struct_pack(lo := lo, hi := hi)) AS runs FROM r GROUP BY ALL),
y AS (
  SELECT d.doc_id, d.text, x.runs, string_split(d.text, chr(10)) AS s FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id AND x.t = hash(d.text)
), z AS (
  SELECT *, list_filter(s, lambda q, i: len(list_filter(runs, lambda k: i >= k.lo AND i <= k.hi)) = 0) AS kept FROM y
)
SELECT doc_id, CASE WHEN runs IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
  CAST(CASE WHEN runs IS NULL THEN 0 ELSE len(s) - len(kept) END AS BIGINT) AS lines_removed FROM z
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\t-\r ]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM w
), k AS (SELECT list_sort(g) AS g, min(doc_id) AS c, len(g) AS n FROM g WHERE len(g) > 0 GROUP BY 1, 3),
e AS (SELECT c, n, unnest(g) AS s FROM k),
p AS (
  SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.s = b.s AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT c AS x, c AS y FROM k UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
m AS (SELECT x AS c, min(y) AS component_id FROM r GROUP BY x)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, CASE WHEN len(g.g) = 0 THEN g.doc_id ELSE m.component_id END AS component_id
FROM g LEFT JOIN k ON list_sort(g.g) = k.g LEFT JOIN m ON m.c = k.c
"""

OP9_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings
), e AS MATERIALIZED (
  SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.i <> b.i AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), r AS (SELECT i AS x, i AS y FROM v UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT r.x AS i, min(v.vec_id) AS c FROM r JOIN v ON r.y = v.i GROUP BY r.x),
n AS (SELECT a AS i, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, vec_id IS NOT DISTINCT FROM m.c AS kept
FROM v JOIN m ON m.i = v.i LEFT JOIN n ON n.i = v.i
"""

OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1,
    CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
), c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, unnest([w[i:i] FOR i IN range(1, len(w) + 1)]) AS g FROM w
  UNION ALL SELECT lang, unnest([w[i:i + 1] FOR i IN range(1, len(w))]) FROM w
  UNION ALL SELECT lang, unnest([w[i:i + 2] FOR i IN range(1, len(w) - 1)]) FROM w
), f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, g, max(f) AS longer FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM f WHERE len(g) = 3) GROUP BY ALL),
cut AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:len(c.g)]
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
kept AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_html_extraction, op2_quality_classifier, op3_token_counts, op4_toxicity, op5_secret_scan, op6_line_dedup, op7_bpe, op8_ngram_jaccard_join, op9_exact_topk, op10_decontamination)
    made += (op11_embedding_near_dedup, op12_fill_in_middle, op13_phrase_collocations)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op9_exact_topk": OP9_SQL, "op11_embedding_near_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_phrase_collocations": OP13_SQL}
