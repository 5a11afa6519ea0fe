"""Ingest with dates and near duplicates, and the stream of it, which a lost or repeated batch does not change."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunks as C
from millrace.streaming.intake import Library, stream_ingest, text_stream

WORDS = [f"w{i}" for i in range(300)]


def documents(n, seed):
    rng = random.Random(seed)
    bases = [" ".join(rng.choice(WORDS) for _ in range(50)) for _ in range(6)]
    out = []
    for i in range(n):
        words = rng.choice(bases).split()
        if rng.random() < 0.6:
            words[rng.randrange(50)] = rng.choice(WORDS)
        out.append((i, 1, " ".join(words) if i % 9 else " \n"))
    return out


def test_ingest_drops_near_copies_of_other_documents(spark):
    text = " ".join(WORDS[:80])
    docs = spark.createDataFrame([(1, 1, text), (2, 1, text + " more"), (3, 1, text), (4, 1, ""), (5, 1, "other words"), (6, 1, text + " 77")], "doc_id long, version long, text string")
    kept, outcomes = C.ingest(docs, docs.select("doc_id").where("doc_id = 5"))
    assert {r.doc_id: r.outcome for r in outcomes.collect()} == {1: "INGESTED", 2: "MERGED", 3: "MERGED", 4: "REJECTED", 5: "SKIPPED", 6: "INGESTED"}
    assert sorted(r.doc_id for r in kept.collect()) == [1, 6] and all(r.verified for r in outcomes.collect())
    dates = spark.createDataFrame([(1, "2024-01-01"), (3, "2024-02-01")], "doc_id long, d string").select("doc_id", F.to_date("d").alias("effective_date"))
    assert {r.doc_id: r.outcome for r in C.ingest(docs, docs.select("doc_id").where("false"), dates, near=False)[1].collect()} == {1: "MERGED", 2: "INGESTED", 3: "INGESTED", 4: "REJECTED", 5: "INGESTED", 6: "INGESTED"}


def rows_of(library):
    return sorted((r.doc_id, r.content) for r in library.chunks().collect()), sorted((r.doc_id, r.outcome) for r in library.read("outcomes").collect())


def test_stream_equals_ingest_of_all_and_survives_a_kill(spark, tmp_path, monkeypatch):
    docs = documents(45, 3)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        part = [dict(zip(("doc_id", "version", "text"), d, strict=True)) for d in docs[15 * k : 15 * k + 15]]
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        # files are taken in the order of their times
        import os

        os.utime(folder / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    kept, outcomes = C.ingest(spark.createDataFrame(docs, "doc_id long, version long, text string"), spark.createDataFrame([], "doc_id long"))
    want = sorted((r.doc_id, r.content) for r in kept.collect()), sorted((r.doc_id, r.outcome) for r in outcomes.collect())
    library = Library(spark, str(tmp_path / "library"))
    whole = Library.write

    def killed(self, name, batch, df):
        if name == "chunks" and batch == 1:
            raise RuntimeError("killed between two writes")
        whole(self, name, batch, df)

    monkeypatch.setattr(Library, "write", killed)
    with pytest.raises(Exception, match="killed"):
        stream_ingest(text_stream(spark, str(folder), 1), library, str(tmp_path / "checkpoint")).awaitTermination()
    monkeypatch.setattr(Library, "write", whole)
    stream_ingest(text_stream(spark, str(folder), 1), library, str(tmp_path / "checkpoint")).awaitTermination()
    got = rows_of(library)
    assert got[0] == want[0]
    assert got[1] == want[1]
    library.add(spark.createDataFrame(docs[15:30], "doc_id long, version long, text string"), 1)
    assert rows_of(library) == got
    library.add(spark.createDataFrame(docs[:5], "doc_id long, version long, text string"), 3)
    again = library.read("outcomes").where("batch = 3").collect()
    assert {r.outcome for r in again} <= {"SKIPPED", "REJECTED"} and rows_of(library)[0] == got[0]


def test_ingest_stores_texts_once(spark, monkeypatch):
    stored, keep = [], C.stash
    monkeypatch.setattr(C, "stash", lambda df: stored.append(set(df.columns) & {"text", "content"}) or keep(df))
    docs = spark.createDataFrame([(1, 1, "alpha beta"), (1, 1, "alpha beta"), (2, None, "gamma"), (None, 1, "delta"), (3, 1, "-"), (4, 1, "---"), (5, 1, "x")], "doc_id long, version int, text string")
    kept, outcomes = C.ingest(docs, docs.select("doc_id").where("doc_id = 5"))
    got = sorted(((r.doc_id, r.outcome, r.chunks) for r in outcomes.collect()), key=str)
    assert got == [(1, "INGESTED", 2), (1, "INGESTED", 2), (2, "MERGED", 0), (3, "INGESTED", 1), (4, "REJECTED", 0), (5, "SKIPPED", 0), (None, "MERGED", 0)]
    assert sorted(r.content for r in kept.collect()) == ["-", "alpha beta", "alpha beta"]
    assert [s for s in stored if s] == [{"content"}]
