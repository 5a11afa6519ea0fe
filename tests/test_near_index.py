"""Near duplicates by arrival and the stored index against the rule applied one arrival after the other."""

import random

from pyspark.sql import functions as F

from millrace.operators import dedup, governance, near_index
from millrace.operators.dedup import all_near_dup_pairs

WORDS = [f"w{i}" for i in range(400)]


def copies(seed, n=80):
    """(doc_id, text, effective_date): groups of near copies, one of them with a third of all rows; some differ in a digit only."""
    rng = random.Random(seed)
    bases = [rng.sample(WORDS, 60) for _ in range(12)]
    out = []
    for i in range(n):
        text = list(bases[0] if rng.random() < 0.33 else rng.choice(bases))
        for _ in range(rng.randrange(3)):
            text[rng.randrange(60)] = rng.choice([*WORDS, "7", "8"])
        out.append((i, " ".join(text), None if rng.random() < 0.3 else f"2024-01-{rng.randrange(1, 29):02d}"))
    return out


def tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, d string")
    return df.select("doc_id", "text"), df.select("doc_id", F.to_date("d").alias("effective_date"))


def rows_of(df):
    return sorted((r.a, r.b, r.outcome, r.loser) for r in df.collect())


def one_by_one(pairs, dates, texts, critical):
    """The rule as it is told: each arrival meets those before it that are still there."""
    near, lost, out = {}, set(), []
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    for b in sorted(near):
        for a in sorted(near[b]):
            if b in lost:
                break
            if a in lost:
                continue
            if critical[a, b]:
                out.append((a, b, "CONFLICT", None))
                continue
            loser = a if dates[a] and dates[b] and dates[b] > dates[a] else b
            lost.add(loser)
            out.append((a, b, "MERGED", loser))
    return sorted(out, key=lambda r: r[:2])


def expected(spark, texts, dates):
    pairs = all_near_dup_pairs(texts).select("a", "b").distinct()
    sides = [texts.select(F.col("doc_id").alias(n), F.col("text").alias(f"{n}t")) for n in "ab"]
    judged = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", governance.critical_diff(F.col("at"), F.col("bt")).alias("c")).collect()
    by_id = {r.doc_id: r.effective_date for r in dates.collect()}
    return one_by_one([(r.a, r.b) for r in judged], by_id, None, {(r.a, r.b): r.c for r in judged})


def test_arrivals_in_stretches_equal_the_rule(spark, monkeypatch):
    texts, dates = tables(spark, copies(1))
    want = expected(spark, texts, dates)
    assert {r[2] for r in want} == {"CONFLICT", "MERGED"}
    assert rows_of(near_index.arrivals(texts, dates)) == want
    monkeypatch.setattr(near_index, "FIRST", 20)
    monkeypatch.setattr(near_index, "GROWTH", 4)
    assert rows_of(near_index.arrivals(texts, dates)) == want


def test_three_batches_equal_all_at_once_and_a_replay_changes_nothing(spark, tmp_path):
    texts, dates = tables(spark, copies(2, 60))
    want = expected(spark, texts, dates)
    index = near_index.NearIndex(spark, str(tmp_path / "index"), buckets=8)
    parts = [texts.where(f"doc_id >= {lo} and doc_id < {hi}") for lo, hi in ((0, 15), (15, 40), (40, 60))]
    got = [rows_of(index.add(i, p, dates)) for i, p in enumerate(parts)]
    assert sorted(sum(got, [])) == want
    kept = lambda: sorted(r.doc_id for r in index.part("documents", 9, texts.select("doc_id")).join(index.part("lost", 9, texts.select("doc_id")), "doc_id", "left_anti").collect())
    before = kept()
    assert before == sorted(set(range(60)) - {r[3] for r in want})
    for i in (1, 2):
        assert rows_of(index.add(i, parts[i], dates)) == got[i]
    assert kept() == before
    assert index.add(3, texts.where("false"), dates).count() == 0


def test_no_texts(spark):
    texts, dates = tables(spark, [(1, None, None), (2, "", None), (3, "a", None)])
    assert near_index.arrivals(texts, dates).count() == 0


def test_size_estimates_do_not_grow_with_the_rounds(spark, monkeypatch):
    """A chain in which each pair waits for the one before it; every second one is void."""
    sizes, keep = [], governance.stash

    def known(df):
        sizes.append((out := keep(df))._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(governance, "stash", known)
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long").select("a", "b", F.struct("b", "a").alias("at"), F.col("b").alias("loser"))
    assert rows_of(governance.settled(chain)) == [(i, i + 1, "MERGED", i + 1) for i in range(0, 9, 2)]
    assert len(sizes) >= 8 and max(sizes) <= 64


def test_only_texts_that_share_a_band_are_kept_and_others_are_read_for_their_bands_alone(spark, monkeypatch):
    texts, dates = tables(spark, [*copies(4, 30), *((100 + i, " ".join(f"x{i}y{j}" for j in range(50)), None) for i in range(40))])
    kept, keep = [], near_index.rows_of
    monkeypatch.setattr(near_index, "rows_of", lambda *args: kept.append(keep(*args)) or kept[-1])
    assert rows_of(near_index.arrivals(texts, dates)) == expected(spark, texts, dates)
    assert all(r.doc_id < 100 for df in kept for r in df.collect())
    # `only` by what it leaves out, and by a join where that is too much; rows are also picked in parts
    some = texts.select("doc_id").where("doc_id % 3 > 0")
    want = expected(spark, texts.join(some, "doc_id", "left_semi"), dates)
    assert rows_of(near_index.arrivals(texts, dates, only=some)) == want
    monkeypatch.setattr(near_index, "BROADCAST_IDS", 3)
    monkeypatch.setattr(dedup, "BROADCAST_IDS", 9)
    assert rows_of(near_index.arrivals(texts, dates, only=some)) == want


def test_critical_differences_of_pairs_equal_the_expression(spark):
    words = ["a", "b", "7", "\u0661", "\u4e0d", "\U0001f600", "x%", "", "e\u0301", "\u5143"]
    rng = random.Random(7)
    made = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
    rows = spark.createDataFrame([(i, made(), made()) for i in range(400)], "id long, a_text string, b_text string").withColumn("want", governance.critical_diff(F.col("a_text"), F.col("b_text")))
    got = governance.told_critical(rows).collect()
    assert len(got) == 400 and all(r.want == r.critical for r in got) and len({r.want for r in got}) == 2


def test_pieces_of_documents_arrive_in_stretches_too_and_fewer_pairs_meet(spark, monkeypatch):
    texts, dates = tables(spark, copies(5))
    place = F.struct((F.col("doc_id") / 2).cast("long").alias("d"), F.col("doc_id").alias("i"))
    texts, dates = texts.withColumn("doc_id", place), dates.withColumn("doc_id", place)
    met, keep = [], near_index.similar
    monkeypatch.setattr(near_index, "similar", lambda pairs, *rest: met.append(pairs.count()) or keep(pairs, *rest))
    whole = rows_of(near_index.arrivals(texts, dates, own="d"))
    once = sum(met)
    met.clear()
    monkeypatch.setattr(near_index, "FIRST", 20)
    monkeypatch.setattr(near_index, "GROWTH", 4)
    assert rows_of(near_index.arrivals(texts, dates, own="d")) == whole and len(whole) > 20
    assert sum(met) < 0.8 * once


def test_the_first_batch_of_an_index_meets_no_empty_one(spark, tmp_path, monkeypatch):
    texts, dates = tables(spark, copies(6, 30))
    old, keep = [], near_index.meet
    monkeypatch.setattr(near_index, "meet", lambda bands, old_bands, *rest: old.append(old_bands) or keep(bands, old_bands, *rest))
    index = near_index.NearIndex(spark, str(tmp_path / "index"), buckets=4)
    rows = [rows_of(index.add(i, texts.where(f"doc_id % 30 >= {15 * i} and doc_id % 30 < {15 * i + 15}"), dates)) for i in range(2)]
    assert sorted(sum(rows, [])) == expected(spark, texts, dates)
    assert old[0] is None and old[1] is not None
