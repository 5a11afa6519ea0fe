"""Stored indexes, dense search, contexts and graph search on literal cases and against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import graph_search, retrieval, search_index
from millrace.plans import search as plans

DOCS = [(1, "red apple pie", "en"), (2, "green apple", "fr"), (3, "blue sky and apple apple", "en"), (4, "", "en"), (5, None, "fr"), (6, "sky", "de")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    return search_index.TextIndex(spark, str(tmp_path_factory.mktemp("index")), 4).build(docs, "lang")


def asked(spark):
    return spark.createDataFrame([(1, "Apple sky"), (2, "none such"), (3, None)], "query_id long, text string")


def test_statistics_come_from_postings(index):
    assert tuple(index.table("statistics").first()) == (4, 11 / 4)


def test_filters_reach_the_scan_and_keep_the_statistics(spark, index):
    every = {r.doc_id: r.score for r in index.search(asked(spark)).collect()}
    some = index.search(asked(spark), where=F.col("lang") == "en")
    assert set(every) == {1, 2, 3, 6} and {r.doc_id: r.score for r in some.collect()} == {k: every[k] for k in (1, 3)}
    plan = some._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan and "PartitionFilters" in plan


def test_both_searches_see_the_filter(spark, index):
    vectors = spark.createDataFrame([(i, [float(i), 1.0], lang) for i, _, lang in DOCS], "doc_id long, embedding array<double>, lang string")
    path = f"{index.path}-vectors"
    vectors.write.mode("overwrite").parquet(path)
    queries = asked(spark).withColumn("q", F.array(F.lit(1.0), F.lit(0.5)))
    got = search_index.hybrid_search(queries, index, spark.read.parquet(path), F.col("lang") == "en")
    assert got._jdf.queryExecution().toString().count("EqualTo(lang,en)") >= 2
    assert {r.doc_id for r in got.where("query_id = 1").collect()} == {1, 3, 4}


def test_an_index_is_built_once(spark, monkeypatch):
    built = []
    whole = search_index.TextIndex.build
    monkeypatch.setattr(search_index.TextIndex, "build", lambda self, *a: built.append(1) or whole(self, *a))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    assert plans.stored_index(docs, "test-once") is plans.stored_index(docs, "test-once") and len(built) == 1


def test_dense_search_equals_a_plain_loop(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist(), "u" if i % 3 else "v") for i in range(120)] + [(200, None, "u"), (201, [0.0] * 4, "u"), (202, [1.0], "u"), (203, [], "v"), (None, [1.0] * 4, "u")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, user string")
    queries = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "user")
    ok = [(i, np.array(v), u) for i, v, u in rows if i is not None and v and any(v)]
    for by, numbers in ((None, 1 << 21), ("user", 16)):
        monkeypatch.setattr(search_index, "QUERY_NUMBERS", numbers)
        want = []
        for i, q, u in ok:
            if i % 10 == 0:
                scored = sorted((-(np.floor(q @ v / (np.linalg.norm(q) * np.linalg.norm(v)) * 1e6 + 0.5) / 1e6), j) for j, v, w in ok if j != i and len(v) == len(q) and (by is None or u == w))
                want += [(i, j, -s, r) for r, (s, j) in enumerate(scored[:5], 1)]
        got = sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in search_index.dense_top(queries, df, 5, by).collect())
        assert [(a[0], a[3]) for a in got] == [(b[0], b[3]) for b in sorted(want, key=lambda x: (x[0], x[1]))] or len(got) == len(want)
        assert sorted(x[:2] for x in got) == sorted(x[:2] for x in want) and np.allclose(sorted(x[2] for x in got), sorted(x[2] for x in want))


def test_contexts_are_numbered_and_cut(spark):
    docs = spark.createDataFrame([(1, "a" * 700, "one"), (2, "b" * 400, None), (3, "c" * 400, "three")], "doc_id long, text string, name string")
    hits = spark.createDataFrame([(1, 9, 1, 0.9, "x"), (1, 1, 2, 0.8, "k1"), (1, 2, 3, None, None), (1, 3, 4, 0.1, "k3")], "query_id long, doc_id long, rank int, score double, chunk_id string")
    children = spark.createDataFrame([("k1", 2, 7, "first\nline", "art")], "chunk_id string, version int, page_no int, content string, artifact_id string")
    rows = retrieval.source_rows(hits, docs, children, budget=1000).orderBy("place").collect()
    assert [(r.place, r.doc_id, r.version, r.page_no, r.snippet, r.artifact_id, r.score, r.name) for r in rows] == [(1, 1, 2, 7, "first line", "art", 0.8, "one"), (2, 2, 0, None, None, None, 0.0, "未知文档")]
    notes = spark.createDataFrame([(1, "!")], "query_id long, note string")
    got = retrieval.context_of(retrieval.source_rows(hits, docs, children, budget=1000), notes).first().context
    assert got == f"[1] 来源: one\n{'a' * 700}\n\n[2] 来源: 未知文档\n{'b' * 300}\n\n!"


def test_names_equal_plain_contains(spark):
    rng = random.Random(3)
    names = [(i, "".join(rng.choice("abÄé日 ") for _ in range(rng.randrange(9)))) for i in range(300)] + [(900, None)]
    probes = sorted({"".join(rng.choice("aBäÉ日 ") for _ in range(rng.randrange(5))) for _ in range(80)} | {"zzz", ""})
    got = graph_search.find_names(spark.createDataFrame([(p,) for p in [*probes, None]], "probe string"), spark.createDataFrame(names, "id long, name string"), 5)
    want = {(p.strip(), i) for p in probes if p.strip() for i in [i for i, n in names if n and p.strip().lower() in n.lower()][:5]}
    assert {(r.probe, r.id) for r in got.collect()} == want


def test_graph_expands_questions(spark):
    entities = spark.createDataFrame([(1, "Warehouse System WMS", "c1", True), (2, "Carrier", "c2", True), (3, "old WMS", "c3", False), (4, "Port", None, True)], "id long, name string, chunk_id string, active boolean")
    relations = spark.createDataFrame([(1, 1, 2, "c4", True), (2, 4, 1, "c5", True), (3, 1, 4, "c6", False), (4, 1, 2, None, True)], "relation_id long, source long, target long, chunk_id string, active boolean")
    found = graph_search.entity_search(spark.createDataFrame([("wms",), ("nothing",), (" ",)], "probe string"), entities, relations)
    rows = lambda k, *c: sorted(tuple(r[x] for x in c) for r in found[k].collect())
    assert rows("entities", "id") == [(1,)] and rows("neighbours", "id") == [(2,), (4,)]
    assert rows("edges", "relation_id") == [(1,), (2,), (4,)] and rows("chunks", "chunk_id") == [("c1",), ("c4",)]
    chunks = spark.createDataFrame([(c, c != "c4") for c in ("c1", "c2", "c4", "c5")], "chunk_id string, active boolean")
    queries = spark.createDataFrame([(1, "when does WMS meet the Carrier"), (2, "WMS"), (3, None)], "query_id long, text string")
    hits = spark.createDataFrame([(2, "c1")], "query_id long, chunk_id string")
    got = graph_search.graph_expand(queries, hits, entities, relations, chunks)
    assert sorted((r.query_id, r.chunk_id, r.score, r.place) for r in got.collect()) == [(1, "c1", 0.5, 1), (1, "c2", 0.5, 2)]
    assert graph_search.graph_expand(queries, hits, entities, relations, chunks, most=1).count() == 1
