"""Severity of toxic language by cumulative-link (proportional-odds) ordinal regression.

Features are the distinct lower-case words of a text and the beginnings of its longer words, all
taken once. P(grade <= k) = sigmoid(cut_k - w.x) with one weight vector for all thresholds; the
result is the expected grade. Labels give toxic or not; a toxic training row is graded 1, 2 or 3 by
the terciles of the share of its features that are chosen ones, so that a long text is no graver for its length. Training uses about SAMPLE_ROWS labelled rows drawn by a hash of the id, and
keeps as features at most MAX_FEATURES of those that occur mostly in toxic rows; every row is
scored from its whole text.

Null and empty texts have severity of a text without features. Several labels of one id count as
the largest. Without labelled toxic rows every severity is 0 and nothing is toxic. Each input row
gives one row. The severity from which a text counts as toxic is the one that best splits the sample.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stash
from .common import CHEAP_ENTRIES, Memo, map_rows
from .learn import in_sample, one_label

SAMPLE_ROWS = 12_000
MAX_FEATURES = 4096
#: A feature needs this many rows, and one in this many of the toxic rows.
LEAST_ROWS, ONE_IN = 3, 200
LEAST_Z = 3.0
LEAST_SHARE = 0.95
GRADES = 3
STEM_LENGTHS = (4, 5)
EDGES = ".,;:!?\"'()[]{}<>*#%&$|-"
EPOCHS, RATE, DECAY = 500, 0.05, 1e-4

#: Weights by feature, cuts, and the expected severity from which a text counts as toxic.
Model = tuple[dict[int, float], np.ndarray, float]


def features_of(chunk: str) -> tuple[int, ...]:
    """Features of one run without white space: its word, and the beginnings of a longer one."""
    word = chunk.lower().strip(EDGES)
    if not word:
        return ()
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass"))]
    out += [zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "surrogatepass")) for n in STEM_LENGTHS if len(word) > n]
    return tuple(out)


def sparse(text: str, known: Memo) -> np.ndarray:
    """The distinct features of a text, in order."""
    return np.sort(np.fromiter({f for c in set(text.split()) for f in known[c]}, np.int64))


def marked(rows: DataFrame, n1: int, n0: int) -> np.ndarray:
    """Features most of whose rows are toxic, at most MAX_FEATURES, those with the highest z scores of their log odds; in order."""
    a, n = F.sum("toxic"), F.count("*")
    counts = rows.select("toxic", F.explode("x").alias("id")).groupBy("id").agg(a.alias("a"), n.alias("n"))
    got = counts.where((F.col("n") >= max(LEAST_ROWS, n1 // ONE_IN)) & (F.col("a") >= LEAST_SHARE * F.col("n"))).toArrow().sort_by("id")
    ids, ca = got["id"].to_numpy(), got["a"].to_numpy().astype(float)
    cb = got["n"].to_numpy() - ca
    z = (np.log((ca + 0.1) / (n1 - ca + 0.1)) - np.log((cb + 0.1) / (n0 - cb + 0.1))) / np.sqrt(1 / (ca + 0.5) + 1 / (cb + 0.5))
    order = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    return np.sort(ids[order[z[order] >= LEAST_Z]])


def chosen(rows: DataFrame, ids: np.ndarray) -> DataFrame:
    """Per row (toxic, cols, of): which of ids its text has, by place, and how many features it has."""
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("cols", T.ArrayType(T.LongType())), T.StructField("of", T.LongType())])

    def start():
        return lambda y, x: {"toxic": y, "cols": [np.flatnonzero(np.isin(ids, v, assume_unique=True)) for v in x], "of": list(map(len, x))}

    return map_rows(rows.select("toxic", "x"), schema, start)


def ordinal_fit(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered cuts of the cumulative-link model, by Adam. (rows, cols): where features are 1."""
    k, n = int(grades.max()), len(grades)
    w = np.zeros(n_features)
    # cuts = first, then first plus exponentials: ordered whatever the parameters are
    c = np.r_[1.0, np.zeros(k - 1)]
    theta, m, v = np.r_[w, c], 0.0, 0.0
    weight = np.where(grades == 0, 0.5 / max(1, (grades == 0).sum()), 0.5 / max(1, (grades > 0).sum()))
    for t in range(1, EPOCHS + 1):
        w, c = theta[:n_features], theta[n_features:]
        cuts = np.cumsum(np.r_[c[0], np.exp(c[1:])])
        eta = np.bincount(rows, w[cols], n)
        p = 1 / (1 + np.exp(-(eta[:, None] - cuts[None, :])))
        hi = np.c_[np.ones(n), p]
        lo = np.c_[p, np.zeros(n)]
        at = np.arange(n)
        pr = np.maximum(hi[at, grades] - lo[at, grades], 1e-9)
        d_hi = np.c_[np.zeros(n), p * (1 - p)][at, grades]
        d_lo = np.c_[p * (1 - p), np.zeros(n)][at, grades]
        g_eta = -weight * (d_hi - d_lo) / pr
        g_w = np.bincount(cols, g_eta[rows], n_features)
        g_cut = np.zeros(k)
        np.add.at(g_cut, grades[grades > 0] - 1, (weight * d_hi / pr)[grades > 0])
        np.add.at(g_cut, grades[grades < k], -(weight * d_lo / pr)[grades < k])
        g_c = np.r_[g_cut.sum(), np.exp(c[1:]) * np.cumsum(g_cut[::-1])[::-1][1:]]
        grad = np.r_[g_w + DECAY * w, g_c]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    c = theta[n_features:]
    return theta[:n_features], np.cumsum(np.r_[c[0], np.exp(c[1:])])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Weights by feature, and cuts. Reads all labels for counts, and the texts of the sample."""
    known = one_label(labels, "toxic")
    n = known.count()
    # About SAMPLE_ROWS rows whatever the input, so they may be broadcast.
    drawn = known.where(in_sample(F.col("doc_id"), SAMPLE_ROWS, n, 3))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("x", T.ArrayType(T.LongType()))])

    def start():
        memo = Memo(features_of, CHEAP_ENTRIES)
        return lambda t, y: {"toxic": [int(v == 1) for v in y], "x": [sparse(s or "", memo) for s in t]}

    # copies would count a rare word as often as they occur
    rows = stash(map_rows(texts, schema, start).distinct())
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n1:
        return {}, np.zeros(0), 1.0
    ids = marked(rows, n1, n - n1)
    if not len(ids):
        return {}, np.zeros(0), 1.0
    # Only the chosen features of the sample reach the driver.
    x = chosen(rows, ids).toArrow().to_pylist()
    # sums must not depend on the order in which tasks end
    x.sort(key=lambda r: (r["toxic"], r["cols"], r["of"]))
    toxic, sizes = np.array([r["toxic"] == 1 for r in x]), np.array([r["of"] for r in x])
    parts = [np.asarray(r["cols"], np.int64) for r in x]
    cols, at = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(v) for v in parts])
    density = np.bincount(at, minlength=len(x)) / np.maximum(sizes, 1)
    third = np.quantile(density[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + (density > third[0]).astype(int) + (density > third[1]), 0)
    w, cuts = ordinal_fit(at, cols, grades, len(ids))
    severity = expected(np.bincount(at, w[cols], len(x)), cuts)
    return dict(zip(ids.tolist(), w.tolist(), strict=True)), cuts, best_split(severity, toxic)


def expected(eta: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The expected grade: the sum of the chances to exceed each threshold."""
    return (1 / (1 + np.exp(-np.clip(eta[:, None] - cuts[None, :], -50, 50)))).sum(1)


def best_split(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap at which most rows are on their side, toxic and other rows weighing alike."""
    s = np.unique(severity)
    if len(s) < 2:
        return float(s[0]) + 1e-9
    a = np.searchsorted(np.sort(severity[toxic]), s) / max(1, toxic.sum())
    b = np.searchsorted(np.sort(severity[~toxic]), s) / max(1, (~toxic).sum())
    i = max(1, int(np.argmax(b - a)))
    return float((s[i - 1] + s[i]) / 2)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """Per document (doc_id, severity, toxic); severity is the expected grade, from 0 to GRADES."""
    return with_severity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, ["doc_id"])


def with_severity(docs: DataFrame, model: Model, keep: list[str], carry_text: bool = False) -> DataFrame:
    """The columns in keep, and the text if asked for, with severity and toxic."""
    weights, cuts, reject = model
    names = [*keep, "text"] if carry_text else keep
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("severity", T.DoubleType()), T.StructField("toxic", T.BooleanType())])

    def start():
        memo = Memo(lambda c: [f for f in features_of(c) if f in weights], CHEAP_ENTRIES)

        def work(texts: list, *rest: list) -> dict:
            eta = np.array([sum(map(weights.__getitem__, set().union(*map(memo.__getitem__, set((t or "").split()))))) for t in texts])
            severity = expected(eta, cuts) if len(cuts) else np.zeros(len(texts))
            return dict(zip(keep, rest, strict=True)) | {"text": texts, "severity": severity, "toxic": severity >= reject}

        return work

    return map_rows(docs.select("text", *keep), schema, start)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on a bounded sample of labels and grades every document."""
    return grade(docs, fit(docs, labels))
