"""Steps whose work must grow no faster than the input."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from millrace import session
from millrace.operators import chunks, dedup, graph_search, retrieval, search_index, verdicts


def keys_of(sets, threshold):
    row, key = dedup.part_keys(pa.array([sorted(s) for s in sets], pa.list_(pa.int64())), threshold)
    return [set(key[row == i].tolist()) for i in range(len(sets))]


def test_similar_sets_always_share_a_part_and_others_hardly_ever():
    rng = random.Random(5)
    number = lambda: rng.randrange(-(1 << 63), 1 << 63)
    for threshold in (0.9, 0.7):
        near, far = [], []
        for _ in range(300):
            base = [number() for _ in range(rng.randrange(1, 400))]
            gone = rng.randrange(int(len(base) * (1 - threshold)) + 1)
            for drop, add, out in ((gone, 0, near), (gone // 2, gone // 2, near), (len(base) // 2, len(base) // 2, far)):
                x, y = set(base), set(base[drop:]) | {number() for _ in range(add)}
                if out is far or len(x & y) / len(x | y) >= threshold:
                    out.append((x, y))
        shared = [[bool(a & b) for a, b in (keys_of(p, threshold) for p in pairs)] for pairs in (near, [p for p in far if len(p[0]) > 50])]
        assert len(shared[0]) > 400 and all(shared[0])
        # similarity is a third: by 1 - (1 - 3 ** -4) ** 32, bands of four minima let a third of such pairs meet
        assert threshold < 0.9 or np.mean(shared[1]) < 0.02


def test_conflict_groups_of_short_lists_store_nothing_and_long_ones_agree(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(q, rng.randrange(12), rng.randrange(12), rng.choice("xyX"), None) for q in range(20) for _ in range(rng.randrange(1, 12))]
    said = spark.createDataFrame(rows, "query_id long, a long, b long, entity string, attribute string")
    found = lambda: sorted(map(tuple, verdicts.conflict_groups(said).collect()))
    with monkeypatch.context() as m:
        m.setattr(verdicts, "cut", None)  # no rounds are stored
        short = found()
    monkeypatch.setattr(verdicts, "LINKS_AT_ONCE", 3)
    assert found() == short and len({(r[0], r[1]) for r in short}) > 20


def test_keyword_search_equals_a_plain_search_and_returns_only_the_best(spark):
    rng = random.Random(4)
    bits = ["ab", "abc", "c", "x_1", "K\u212a", "\u4e2d\u6587", "Zab", "-", "\u00e9"]
    texts = [(i, None if i == 7 else " ".join(rng.choice(bits) + rng.choice(bits) for _ in range(6))) for i in range(60)]
    asks = [(1, "ab abc x_1"), (2, "\u4e2d\u6587 zab"), (3, "\u00e9"), (4, "kk nothere"), (5, ""), (6, "1a")]
    docs, queries = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asks, "query_id long, text string")
    terms = {r.query_id: r.t for r in queries.select("query_id", retrieval.query_terms("text").alias("t")).collect()}
    low = {r.doc_id: r.x for r in docs.selectExpr("doc_id", "lower(text) AS x").collect() if r.x is not None}
    want = []
    for q, t in terms.items():
        best = sorted((-round(n / len(t), 6), d) for d, x in low.items() if (n := sum(w in x for w in t)))[:5]
        want += [(q, d, -s, i) for i, (s, d) in enumerate(best, 1)]
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in retrieval.keyword_search(queries, docs, 5).collect()) == sorted(want)
    run = retrieval.holding(queries.select("query_id", retrieval.query_terms("text").alias("t")).toArrow(), 2)
    rows = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["ab abc"] * 50)], ["doc_id", "low"])
    assert sum(b.num_rows for b in run(iter([rows, rows]))) == 2


def test_equal_names_are_indexed_only_as_often_as_a_probe_returns_them(spark, monkeypatch):
    names = spark.createDataFrame([(i, ("Red ring", "red RING", "bolt")[i % 3]) for i in range(300)], "id long, name string")
    whole, seen = graph_search.name_index, []
    monkeypatch.setattr(graph_search, "name_index", lambda few: seen.append(few.count()) or whole(few))
    found = graph_search.find_names(spark.createDataFrame([("D R",), ("r",), ("BOLT",)], "probe string"), names)
    assert sorted((r.probe, r.id) for r in found.collect()) == [("BOLT", i) for i in (2, 5, 8, 11, 14)] + [(p, i) for p in ("D R", "r") for i in (0, 1, 3, 4, 6)]
    assert seen == [10]


def test_graph_expand_works_out_equal_questions_once_and_leaves_no_row_out(spark, monkeypatch):
    rng = random.Random(6)
    names = ["red box", "blue box", "red can"]
    part = [(i, rng.choice(names), 900 + i, i % 5 > 0) for i in range(1, 30)]
    line = [(i, rng.randrange(1, 30), rng.randrange(1, 30), rng.randrange(120), rng.random() < 0.8) for i in range(400)]
    asks = [(q, rng.choice([" red box", "blue box", "can", None])) for q in range(60)] + [(0, "blue box"), (1, "red can")]
    hits = [(rng.randrange(60), rng.randrange(120)) for _ in range(1500)]
    live = [(c, c % 7 > 0) for c in range(950)]
    stored, keep = [], graph_search.stash
    monkeypatch.setattr(graph_search, "stash", lambda df: stored.append(keep(df)) or stored[-1])
    tables = [spark.createDataFrame(asks, "query_id long, text string"), spark.createDataFrame(hits, "query_id long, chunk_id long"), spark.createDataFrame(part, "id long, name string, chunk_id long, active boolean"), spark.createDataFrame(line, "relation_id long, source long, target long, chunk_id long, active boolean"), spark.createDataFrame(live, "chunk_id long, active boolean")]
    got = sorted((r.query_id, r.place, r.chunk_id) for r in graph_search.graph_expand(*tables, most=4).collect())
    want, seen = [], set(hits)
    for q in range(60):
        first = {}
        for text in (t.strip() for i, t in asks if i == q and t):
            for at, probe in enumerate([text, *dict.fromkeys(text.split())]):
                found = [p for p in sorted(part) if p[3] and probe in p[1]][:5]
                for c in {p[2] for p in found} | {x[3] for x in line if x[4] and x[1] in {p[0] for p in found}}:
                    first[c] = min(at, first.get(c, at))
        rows = sorted((at, c) for c, at in first.items() if c % 7 and (q, c) not in seen)[:4]
        want += [(q, i, c) for i, (_, c) in enumerate(rows, 1)]
    assert got == want and len(want) > 150
    assert max(df.count() for df in stored if "probe" in df.columns and "at" in df.columns) <= 4 * 4


def test_conflict_scan_deals_products_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(verdicts, "PRODUCTS_AT_ONCE", 2)
    rng = random.Random(8)
    rows = [("a", "b", i, [rng.gauss(0, 1) for _ in range(4)], "x") for i in range(200)]
    chunks = spark.createDataFrame(rows, "domain string, sub_domain string, chunk_id long, embedding array<float>, content string")
    found = verdicts.conflict_scan(chunks, least=0.9, block=10)
    # 20 blocks make 210 products, two for a task
    assert "hashpartitioning(domain" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 105), REPARTITION_BY_NUM" in plan
    v = np.array([np.float32(r[3]) for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(zip(*(n.tolist() for n in np.nonzero(np.triu(v @ v.T > 0.9, 1)))))


def test_replies_are_parsed_once_for_each_row(spark):
    rows = [(1, "a", "b", 'x {"conflict": true, "entity": "e", "valueA": "1", "valueB": "2", "chunkIdA": "b", "chunkIdB": "a", "entities": [{"name": " n "}, {"name": " "}], "relations": [{"source": "n", "target": "n"}, {"source": "n", "target": "m"}]} {'), (2, "a", "b", "{}"), (3, "a", "b", None)]
    replies = spark.createDataFrame(rows, "chunk_id long, a string, b string, reply string")
    entities, relations = verdicts.parse_extractions(replies)
    for df, want in ((verdicts.parse_verdicts(replies).select("chunk_id", "entity", "value_a", "value_b"), [(1, "e", "2", "1")]), (entities.select("chunk_id", "name"), [(1, "n")]), (relations.select("chunk_id", "source", "target"), [(1, "n", "n")])):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
        assert [tuple(r) for r in df.collect()] == want


def test_pages_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_AT_ONCE", 10)
    cells = spark.range(800).selectExpr("id div 40 AS doc_id", "id div 4 % 10 AS page_no", "id div 2 % 2 AS row", "id % 2 AS col", "CAST(id AS STRING) AS text")
    for df in (chunks.stitch_tables(cells), chunks.stitch_tables(cells, 800)):
        assert ", 20), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 800


def test_bands_of_known_number_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_AT_ONCE", 10)
    dealt, keep = [], dedup.dealt
    monkeypatch.setattr(dedup, "dealt", lambda df, n, *keys: dealt.append(keep(df, n, *keys)) or dealt[-1])
    bands = spark.range(400).selectExpr("id AS doc_id", "id % 150 AS band")
    got = sorted(map(tuple, dedup.lsh_candidates(bands, n=400).collect()))
    assert got == sorted(map(tuple, dedup.lsh_candidates(bands).collect())) and len(got) == 350
    assert [df.rdd.getNumPartitions() for df in dealt] == [40]


def test_an_index_counts_words_within_each_text_and_deals_the_texts_by_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(search_index, "DOCS_A_TASK", 4)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["ab", "AB", "cd", "\u4e2d\u6587", "e"]) for _ in range(rng.randrange(30))), rng.choice("xy")) for i in range(60)]
    # rows of one id count as one document where length and columns are equal
    docs += [(7, docs[7][1], docs[7][2]), (8, "ab ab", "z"), (None, "ab cd", "x"), (None, "cd cd", "x"), (60, None, "x"), (61, "", "y")]
    want = Counter()
    for i, text, tag in docs:
        low = (text or "").lower()
        words = re.findall("[a-z0-9_]{2,}", low) + re.findall("(?=([\u4e00-\u9fff]{2}))", low)
        want.update((w, i, len(words), tag) for w in words)
    plans, keep = [], search_index.postings_of
    monkeypatch.setattr(search_index, "postings_of", lambda rows, *c: plans.append((rows.rdd.getNumPartitions(), keep(rows, *c))) or plans[-1][1])
    schema = "doc_id long, text string, tag string"
    index = search_index.TextIndex(spark, str(tmp_path / "all"), 4).build(spark.createDataFrame(docs, schema), "tag")
    assert Counter({(r.term, r.doc_id, r.len, r.tag): r.tf for r in index.table("postings").collect()}) == want
    assert index.table("postings").count() == len(want) and plans[0][0] == 17
    once = search_index.TextIndex(spark, str(tmp_path / "once"), 4).build(spark.createDataFrame(docs[:60], schema), "tag")
    assert "Aggregate" not in plans[1][1]._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.df) for r in once.table("frequencies").collect()} == set(Counter(r.term for r in once.table("postings").collect()).items())


def test_splitting_counts_a_word_once_and_deals_few_files_to_all_cores(spark, monkeypatch, tmp_path):
    rng = random.Random(10)
    plain = lambda text: sum(-(-(n := len(re.findall("[0-9A-Za-z]", run))) // 4) + len(run) - n for run in re.findall(r"[\x00-\x08\x0e-\x1b!-\x7f]+", text)) + len(chunks._single.findall(text))
    bits = ["word", "a,b", "x" * 30, "!" * 40, "\u4e16", "\u00e9", " ", "\n", "\t", "\x00", ". "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(400))) for _ in range(300)]
    monkeypatch.setattr(chunks, "RUNS_HELD", 5)  # emptied over and over
    assert [chunks.tokens(t) for t in texts] == [plain(t) for t in texts] and len(chunks._costs) <= 5
    monkeypatch.setattr(chunks, "RUNS_HELD", 1 << 16)
    counted, keep = [], chunks._word
    chunks._costs.clear()
    monkeypatch.setattr(chunks, "_word", type("W", (), {"findall": lambda self, run: counted.append(run) or keep.findall(run)})())
    chunks.split_text("some, words. " * 3000, 100, 10)
    assert sorted(counted) == ["some,", "words."]
    docs = spark.createDataFrame([(i, 0, "one two") for i in range(40)], "doc_id long, version int, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    for df in (chunks.parent_child_chunks(one), chunks.split_chunks(one)):
        assert df.rdd.getNumPartitions() == 4 and df.count() == 40


def test_versions_are_dealt_by_rows_and_sorted_once(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_AT_ONCE", 5)
    rng = random.Random(11)
    rows = [(rng.randrange(40), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["ACTIVE", "SUPERSEDED", None])) for _ in range(390)]
    rows += [(None, 3, "ACTIVE"), (90, None, "ACTIVE"), (91, 7, "ACTIVE"), (91, 7, "ACTIVE")]
    ids = [*range(0, 40, 3), 0, 3, 3, None, 77, 90, 91]
    versions = spark.createDataFrame(rows, "doc_id long, version int, status string")
    found = chunks.reparse(versions, spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    asks = {i for i in ids if i is not None}
    last = {d: max((v for i, v, _ in rows if i == d and v is not None), default=None) for d in asks & {r[0] for r in rows}}
    want = [(d, v, "SUPERSEDED" if d in asks and s == "ACTIVE" else s, None) for d, v, s in rows] + [(d, None if p is None else p + 1, "ACTIVE", p) for d, p in last.items()]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert found.dtypes == [("doc_id", "bigint"), ("version", "int"), ("status", "string"), ("parent", "int")]
    # 414 rows, of which eight count as one
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 11), REPARTITION_BY_NUM" in plan and "Join" not in plan and "Aggregate" not in plan
