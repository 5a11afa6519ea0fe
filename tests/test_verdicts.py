"""Literal and brute-force cases of chunks, verdicts, intake and stateful streams."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import chunks as C
from millrace.operators import verdicts as V
from millrace.sources import intake
from millrace.streaming import state


def test_tokens_agree_with_the_expression(spark):
    rng = random.Random(5)
    texts = ["a-b-c-d", "", "x　世界", "é\x00b"] + ["".join(rng.choice("ab1-. \n世，é  \x1c😀") for _ in range(rng.randrange(60))) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.token_estimate(F.col("t"))).collect()
    assert [n for _, n in sorted(got)] == [C.tokens(t) for t in texts]


def test_split_keeps_headings_first_and_sentence_ends_last():
    assert C.split_text("# A\n\none two three.\n## B\nfour five six seven. eight nine", 5, 2) == ["# A", "one two three.", "## B", "four five six", "five six seven.", "eight nine"]
    assert C.split_text("第一句。第二句！第三句？", 4, 0) == ["第一句。", "第二句！", "第三句？"]
    assert C.split_text("第一句。第二句！第三句？", 8, 4) == ["第一句。", "第二句！第三句？"]
    assert C.split_text("世" * 7, 3, 0) == ["世世世", "世世世", "世"]
    assert C.split_text("  short  ", 9, 0) == ["short"]
    assert C.split_text(None, 9, 0) == C.split_text(" \n ", 9, 0) == []


def test_no_chunk_exceeds_its_size_and_none_of_the_text_is_lost():
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "c ", ". ", "\n", "\n\n", "\n# ", "世", "。", "\n```", "-", "longwordlongword"]) for _ in range(300))
        size = rng.randrange(5, 60)
        parts = C.split_text(text, size, 0)
        assert max(map(C.tokens, parts)) <= size
        assert "".join("".join(parts).split()) == "".join(text.split())


def test_chunk_tables_of_null_empty_and_repeated_documents(spark):
    docs = spark.createDataFrame([(1, 0, None, 9), (2, 0, "", 9), (3, 0, "one two", 9), (3, 0, "one two", 9), (None, 0, "x", 9)], "doc_id long, version int, text string, idx int")
    assert sorted(map(tuple, C.split_chunks(docs).collect())) == [(3, 0, "one two")] * 2
    rows = C.parent_child_chunks(docs).collect()
    assert [(r.doc_id, r.parent_index, r.child_index, r.content) for r in rows] == [(3, 0, 0, "one two")] * 2
    assert rows[0].chunk_id == hashlib.sha256(b"3:0:0:0").hexdigest()


def test_parents_hold_their_children():
    text = " ".join(f"word{i}." for i in range(3000))
    parents = C.split_text(text, *C.PARENT)
    assert len(parents) > 5
    assert all(c in p for p in parents for c in C.split_text(p, *C.CHILD))


def test_ingest_outcomes(spark):
    docs = spark.createDataFrame([(1, 1, "alpha beta"), (2, 1, "Alpha  beta"), (3, 1, " \n "), (4, 1, None), (5, 1, "gamma"), (6, 1, "delta")], "doc_id long, version int, text string")
    chunks, outcomes = C.ingest(docs, spark.createDataFrame([(5,), (5,)], "doc_id long"))
    assert {r.doc_id: r.outcome for r in outcomes.collect()} == {1: "INGESTED", 2: "MERGED", 3: "REJECTED", 4: "REJECTED", 5: "SKIPPED", 6: "INGESTED"}
    assert sorted(r.content for r in chunks.collect()) == ["alpha beta", "delta"]


def test_stitched_pages_drop_the_repeated_header(spark):
    rows = [(p, r, c, t) for p in (1, 2) for r, line in enumerate([["Name ", "N"], [f"x{p}", "1"]]) for c, t in enumerate(line)] + [(4, 0, 0, "Name")]
    cells = spark.createDataFrame([(7, *x) for x in rows], "doc_id long, page_no int, row int, col int, text string")
    got = sorted((r.first_page, r.row, r.col, r.text, r.width, r.ambiguous) for r in C.stitch_tables(cells).collect())
    assert got == [(1, 0, 0, "Name ", 2, True), (1, 0, 1, "N", 2, True), (1, 1, 0, "x1", 2, True), (1, 1, 1, "1", 2, True), (1, 2, 0, "x2", 2, True), (1, 2, 1, "1", 2, True), (4, 0, 0, "Name", 1, False)]


def test_conflict_scan_over_blocks_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), None, i, [rng.gauss(0, 1) for _ in range(3)], rng.choice(["是", "不是"])) for i in range(80)] + [("z", "s", 900, [0.0] * 3, "x"), ("z", "s", 901, [1.0] * 3, "x"), ("a", None, 902, [1.0] * 3, " ")]
    chunks = spark.createDataFrame(rows, "domain string, sub_domain string, chunk_id long, embedding array<double>, content string")
    known = spark.createDataFrame([(1, 0), (2, 3)], "a long, b long")
    cos = lambda u, v: sum(x * y for x, y in zip(u, v)) / math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
    want = {(x[2], y[2], "CONFLICT" if x[4] != y[4] else "REDUNDANT") for x in rows[:80] for y in rows[:80] if x[0] == y[0] and x[2] < y[2] and cos(x[3], y[3]) > 0.8 and (x[2], y[2]) not in {(0, 1), (2, 3)}}
    got = [(r.a, r.b, r.hint) for r in V.conflict_scan(chunks, known, block=9).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert V.conflict_scan(chunks.limit(0)).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", "s"), (None, "y", "s")], "domain_tag string, sub_domain_tag string, required_identity string")
    n = lambda *e: df.where(V.parse_filter(*e)).count()
    assert [n(None), n(""), n("owner = 'x'"), n("domain = 'a'"), n("domain == a"), n('domain in ("a", \'b\')'), n("subDomain IN ('x') AND identity = s"), n("domain = 'a'", "identity = s"), n("domain IN ()")] == [3, 3, 3, 1, 1, 2, 1, 0, 3]


def test_files(spark, tmp_path):
    for name, body in {"a.txt": "héllo".encode(), "b.MD": b"\xff!", "c.exe": b"x", "d.pdf": b"", "e.docx": b"12"}.items():
        (tmp_path / name).write_bytes(body)
    rows = {r.path.rsplit("/", 1)[1]: r for r in intake.scan_files(spark, str(tmp_path)).collect()}
    assert {k: (r.kind, r.size, r.reason) for k, r in rows.items()} == {"a.txt": ("TEXT", 6, None), "b.MD": ("TEXT", 2, None), "c.exe": (None, 1, "unsupported"), "e.docx": ("OFFICE_OOXML", 2, None)}
    assert rows["e.docx"].sha256 == hashlib.sha256(b"12").hexdigest() and rows["c.exe"].sha256 is None
    assert sorted(r.text for r in intake.read_text_docs(spark, str(tmp_path)).collect()) == ["héllo", "�!"]


def test_corpus_errors(spark, tmp_path):
    def load(*rows):
        at = tmp_path / f"{len(rows)}{len(str(rows))}.jsonl"
        at.write_text("\n".join(json.dumps(r) for r in rows))
        return intake.load_corpus(spark, str(at))

    row = lambda i, d="d", c="c": {"id": i, "domain": d, "content": c}
    assert load(row("1"), row("2"), {"_comment": "x"}).count() == 2
    for bad in ([], [row("1")], [row("1"), row("2", c="")], [row("1"), row("2"), {"id": "3", "domain": "d"}]):
        with pytest.raises(intake.IntakeError):
            load(*bad)


def test_eval_report(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"runId": "r", "tool": {"judgeModel": "m"}, "metrics": {"faithfulness": {"value": 0.5}}, "samples": [{"id": "1", "tags": ["a", "b" * 600], "contexts": ["c"], "scores": {"context_recall": 1}, "errors": {}}, {}]}))
    runs, samples = intake.load_eval_report(spark, str(tmp_path / "r.json"))
    run = runs.first()
    assert (run.status, run.judgeModel, run.sampleCount, run.faithfulness, run.context_recall) == ("ERROR", "m", 0, 0.5, None)
    a, b = sorted(samples.collect(), key=lambda r: r.id)
    assert (a.source, len(a.tags), a.tags[:3], a.contexts, a.context_recall, a.errors) == ("seed-manual", 512, "a,b", '["c"]', 1.0, None)
    assert (b.id, b.answer, b.tags, b.reviewStatus) == ("unknown", "", None, "approved")


def audit_by_hand(rows, per_minute):
    tokens, last, out = {}, {}, {}
    for key, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        have = min(per_minute, tokens[key] + (t - last[key]) * per_minute / 60) if key in tokens else per_minute
        out[i] = (have >= 1, 0 if have >= 1 else max(1, math.ceil((1 - have) * 60 / per_minute)))
        tokens[key], last[key] = have - (have >= 1), t
    return out


def stream(spark, tmp_path, df, parts, key, run, mode="append"):
    """The rows that run gives over a stream of the parts of df (by the value of key), one batch each."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    src = str(tmp_path / "in")
    for p in parts:
        df.where(F.col(key) == p).coalesce(1).write.mode("append").parquet(src)
    got = []
    q = run(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.outputMode(mode).trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: got.extend((n, *r) for r in b.collect())).start()
    q.awaitTermination(30)
    q.stop()
    return got


def test_rate_audit_of_table_and_stream(spark, tmp_path):
    rng = random.Random(1)
    rows, at = [], 1000
    for i in range(120):
        at += rng.randrange(0, 9)
        rows.append((rng.choice("uuv"), i, at))
    df = spark.createDataFrame(rows, "key string, event_id int, s long").select("key", "event_id", F.timestamp_seconds("s").alias("at"), (F.col("event_id") / 40).cast("int").alias("part"))
    want = audit_by_hand(rows, 6)
    assert {r.event_id: (r.allowed, r.retry_after) for r in state.rate_audit(df, 6).collect()} == want
    assert {False, True} == {a for a, _ in want.values()}
    got = stream(spark, tmp_path, df, range(3), "part", lambda s: state.rate_audit(s, 6))
    assert {r[2]: (r[3], r[4]) for r in got} == want


def test_answers_of_table_and_stream(spark, tmp_path):
    rows = [("a", 1, "x", False, 0), ("a", 2, None, None, 0), ("b", 1, "q", False, 0), ("a", 3, "y", True, 1), ("a", 4, "z", True, 1), ("a", 5, "w", True, 2), ("c", 1, "", True, 2)]
    df = spark.createDataFrame(rows, "session string, seq int, delta string, done boolean, part int")
    want = [("a", "xy"), ("c", "")]
    assert sorted(map(tuple, state.answers_of(df).collect())) == want
    assert sorted(r[1:] for r in stream(spark, tmp_path, df, range(3), "part", state.answers_of)) == want


def test_recent_turns_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, t, "user", t // 3) for t in range(6)] + [(2, 0, "user", 0)], "conv_id long, turn int, role string, part int")
    got = stream(spark, tmp_path, df, range(2), "part", lambda s: state.recent_turns(s, 2), "update")
    last = {r[1]: [x[2] for x in got if x[1] == r[1] and x[0] == max(y[0] for y in got if y[1] == r[1])] for r in got}
    assert last == {1: [5, 4], 2: [0]}
