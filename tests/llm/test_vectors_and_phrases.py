"""Embedding near-duplicates, the fill-in-middle transformation and phrase collocations against brute force and odd rows."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import collocations, embedding_dedup, fill_middle, topk

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


# embeddings
def takes_part(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def plain_duplicates(rows, least=0.9):
    link, dims = defaultdict(set), defaultdict(list)
    for i, (_, v) in enumerate(rows):
        if takes_part(v):
            dims[len(v)].append(i)
    for places in dims.values():
        m = np.array([rows[i][1] for i in places], "float64")
        m /= np.linalg.norm(m, axis=1)[:, None]
        for a, b in zip(*np.nonzero(m @ m.T >= least), strict=True):
            if a != b:
                link[places[a]].add(places[b])
    out, seen = [], set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        least_id = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
        out += [(rows[x][0], len(link[x]), least_id, rows[x][0] == least_id) for x in group]
    return sorted(out, key=repr)


def vectors(rng):
    def near(v, e):
        w = v + e * rng.normal(size=v.shape)
        return (w / np.linalg.norm(w)).astype("float32").tolist()

    base = rng.normal(size=(20, 8))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, near(base[rng.integers(20)], rng.choice([0.05, 0.15, 0.3]))) for i in range(500)]
    rows += [(1000 + i, rows[5][1]) for i in range(20)] + [(2000 + i, near(base[0], 0.02)) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [(4000, None), (4001, []), (4002, [0.0] * 8), (4003, [nan] + [1.0] * 7), (4004, [None] + [1.0] * 7), (4005, [inf] + [1.0] * 7), (4006, [1.0, 2.0]), (4007, [2.0, 4.0])]
    return rows + [(None, rows[5][1]), (4008, [1e30] * 8), (4009, [2e30] * 8), (4010, [-0.0] + [1.0] * 7), (4011, [0.0] + [1.0] * 7), (7, rows[7][1]), (None, [3.0, -1.0])]


@pytest.mark.parametrize("sizes", [(8192, 65536, 24, 1024), (64, 128, 2, 16)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, sizes):
    """With whole bins, and with cells and visitors dealt to many bins and blocks."""
    for name, size in zip(("BIN_ROWS", "BLOCK_ROWS", "LEAST_BINS", "AT_ONCE"), sizes, strict=True):
        monkeypatch.setattr(embedding_dedup, name, size)
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors(np.random.default_rng(3))], "vec_id long, embedding array<float>, key string, home int")
    rows = [tuple(r)[:2] for r in df.collect()]
    assert sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=repr) == plain_duplicates(rows)


def test_near_duplicates_of_few_rows(spark):
    kind = "vec_id long, embedding array<double>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame([(1, [0.0]), (2, None)], kind)).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    # a cosine of just the threshold links
    edge = [(1, [10.0, 0.0, 0.0]), (2, [9.0, 19**0.5, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [8.0, 6.0, 0.0])]
    least = embedding_dedup.exact_cosine(np.array(edge[0][1]), np.array(edge[1][1]))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(edge, kind), least).collect()}
    assert got[1] == 1 and got[3] == 0


def test_visits_reach_every_linked_pair():
    """Wherever two vectors of a cosine of the threshold have their homes, one visits the other's."""
    rng = np.random.default_rng(5)
    x = embedding_dedup.normed(rng.normal(size=(400, 6)))
    turn = rng.normal(size=x.shape)
    turn = embedding_dedup.normed(turn - (turn * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + 0.19**0.5 * turn
    centroids = embedding_dedup.fit_cells(x, 30, 0.9)
    (hx, cx, vx), (hy, cy, vy) = (embedding_dedup.assign(v, centroids, 0.9) for v in (x, y))
    rows = np.arange(len(x))
    assert len(centroids) > 10 and (hx != hy).any() and cx.any()
    assert ((hx == hy) | vx[rows, hy] | vy[rows, hx]).all()


def test_copies_are_handed_on_a_few_at_a_time_and_visits_are_bits():
    """What a task holds grows neither with the bins that a vector visits nor, but for a bit each, with the cells."""

    class Rows:
        dtypes = [("v", "array<float>")]

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    rng = np.random.default_rng(9)
    v = embedding_dedup.normed(rng.normal(size=(3000, 8))).astype("float32")
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 8), pa.int32()), pa.array(v.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:032x}" for i in range(len(v))]), pa.array(np.full(len(v), 8), pa.int32()), lists, pa.array(np.ones(len(v), "int64"))], ["key", "dims", "v", "m"])
    centroids = embedding_dedup.fit_cells(v[:500].astype("float64"), 200, 0.9)
    homes = pa.Table.from_batches(embedding_dedup.assigned(Rows(), {8: centroids}, 0.9)(iter([batch]))).combine_chunks().to_batches()[0]
    assert {len(x) for x in homes["visits"].to_pylist()} == {-(-len(centroids) // 8)}
    residents = np.bincount(homes["home"].to_numpy(), minlength=len(centroids))
    plan = embedding_dedup.Plan([SimpleNamespace(dims=8, cell=c, residents=int(n), visitors=len(v)) for c, n in enumerate(residents) if n])
    out = list(embedding_dedup.dealt(Rows(), plan)(iter([homes])))
    assert max(len(b) for b in out) <= embedding_dedup.COPIES_AT_ONCE < sum(len(b) for b in out)
    # each visitor is in the bins of the cells it visits, once
    _, _, mask = embedding_dedup.assign(v.astype("float64"), centroids, 0.9)
    mask[np.flatnonzero(~homes["core"].to_numpy(zero_copy_only=False)), homes["home"].to_numpy()[~homes["core"].to_numpy(zero_copy_only=False)]] = True
    want = sorted((i, b) for i in range(len(v)) for b in {plan.bins[8, c] for c in np.flatnonzero(mask[i]) if (8, c) in plan.bins})
    assert sorted((int(k, 16), b) for x in out for k, b, r in zip(x["key"].to_pylist(), x["bin"].to_pylist(), x["resident"].to_pylist(), strict=True) if not r) == want


# fill in the middle
def plain_fim(i, text):
    t = text or ""
    u, digest = UNIT.findall(t), sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h, n = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, n, "plain", None, None, t)
    if h[3] % 100 < 80:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_equals_plain_python(spark, monkeypatch):
    rng = random.Random(1)
    parts = ["a", "é", "日本", " ", "\n", "\t", "\x00", "<", "P>", "<P>", "\x1c", "　", "word", "\U0001f600", "<S"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "  "), (None, "some words here"), (5003, "long " * 60000), (7, "twice over"), (7, "twice over")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, form string, h1 int")
    expected = sorted((plain_fim(*r) for r in rows), key=repr)
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    for size in (4 << 20, 40):
        monkeypatch.setattr(fill_middle, "SLICE_BYTES", size)
        assert sorted((tuple(r) for r in fill_middle.fill_middle(df).collect()), key=repr) == expected
    digests = Counter((r.doc_id, r.restored_sha256) for r in fill_middle.digests(df).collect())
    assert digests == Counter((i, sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert fill_middle.digests(df.limit(0)).count() == 0


# phrases
def plain_collocations(rows, least=10, first=2000, longest=3):
    counts, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for q, f in candidates.items():
            for p in {q[i : i + k] for k in range(2, len(q)) for i in range(len(q) - k + 1)}:
                inside[p] = max(inside[p], f)
        ranked = []
        for p, a in candidates.items():
            if not (p in inside and 100 * inside[p] >= 50 * a):
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(ranked)[:first], 1)]
    return sorted(out)


def test_collocations_equal_brute_force(spark, monkeypatch):
    rng, words = random.Random(2), ["the", "The", "of", "é", "É", "a", "b", "in", "日本", "x-y", "New", "york", "\x1c", "\xa0z"]
    gaps = [" ", "  ", "\t", ". ", ", ", "\n"] + [" "] * 6
    rows = [(rng.choice(["en", "fr", None, ""]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), ("en", " ,.\n"), ("en", "word " * 30000), ("de", "same line over and over"), *[("de", "same line over and over")] * 12]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, w1 string, n int")
    for size in (4 << 20, 50):
        monkeypatch.setattr(collocations, "SLICE_BYTES", size)
        assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == plain_collocations(rows)
    got = sorted(tuple(r) for r in collocations.collocations(df, longest=4, least=5, first=7).collect())
    assert got == plain_collocations(rows, least=5, first=7, longest=4)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_scores_pass_64_bits_exactly(spark):
    a, left, right = 10**12 + 7, 10**12 + 39, 3 * 10**12 + 61
    counts = spark.createDataFrame([("en", ["x"], left), ("en", ["y"], right), ("en", ["x", "y"], a), ("en", [], 10**13)], "lang string, words array<string>, f long")
    assert collocations.scored(counts).first().score == 10**6 * a * a // (left * right)


def test_bit_maps_have_all_their_hashes(spark):
    from millrace.llm.bits import bit_map

    rng = np.random.default_rng(1)
    hashes = rng.integers(-(2**63), 2**63, 20000)
    found = bit_map(spark.createDataFrame([(int(h),) for h in hashes], "h long"), len(hashes))
    assert found.has(hashes).all() and found.has(rng.integers(-(2**63), 2**63, 20000)).mean() < 0.1


def test_top_k_of_large_components(spark):
    """Scores are exact where sums along the lists would pass 64 bits, and an error where a score itself does; odd tables."""
    kind = "vec_id long, embedding array<double>, score int"
    big = 3e6
    rows = [(i, [big if j == i % 16 else float(i - j) for j in range(16)], 0) for i in range(64)] + [(100, None, 0), (101, [], 0)]
    rows.append((5, rows[5][1], 0))
    df = spark.createDataFrame(rows, kind)
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id = 3"), 3).collect()]
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e, _ in rows if e}
    want = sorted((-sum(a * b for a, b in zip(v[3], v[i], strict=True)), i) for i in v if i != 3)[:3]
    assert [(r[2], r[3]) for r in sorted(got, key=lambda r: r[1])] == [(i, -s) for s, i in want]
    with pytest.raises(Exception, match="64 bits"):
        huge = spark.createDataFrame([(i, [1e15, 1e15], 0) for i in range(3)], kind)
        topk.top_k(huge, huge, 2).collect()
    assert topk.top_k(df.limit(0), df, 3).count() == 0 and topk.top_k(df, df.limit(0), 3).count() == 0
