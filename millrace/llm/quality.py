"""Quality scores by positive-unlabelled learning.

A logistic model over text statistics minimises the non-negative unbiased risk: trusted positives
are labelled rows of quality 1, the unlabelled set is web text drawn without regard to labels, and
the class prior is estimated from these two sets alone. Labels of held-out rows are never
read. Training uses at most about SAMPLE_ROWS positives and as many unlabelled rows, drawn by a
hash of the id; every row is scored from its whole text.

Null and empty texts get the score of an empty text. Rows with a null id are not held out. Several
labels of one id count as the largest. With no positive labels every score is the prior 0.5. Each
input row gives one row; other columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows
from .learn import in_sample, is_held_out, one_label

#: About how many positives, and how many unlabelled rows, the model is fitted on.
SAMPLE_ROWS = 8000
THRESHOLD = 0.3
EPOCHS, RATE, DECAY = 400, 0.05, 1e-3
#: The class prior with which rows are ranked before it is estimated, and the shares of positives in the regions compared for it.
FIRST_PRIOR, REGIONS = 0.5, np.linspace(0.1, 0.95, 18)

#: Classes of bytes; the classes of neighbours are counted in pairs.
CLASSES = 16


def byte_classes() -> np.ndarray:
    c = np.full(256, 15, np.uint8)
    for k, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "#$%&*", "\"'`", "()[]{}<>", "-_/\\+=", ":;@~^")):
        c[[ord(x) for x in members]] = k
    c[128:] = 14
    return c


TABLE = byte_classes()
N_EXTRA = 9
N_FEATURES = CLASSES * CLASSES + N_EXTRA


def statistics(text: str) -> np.ndarray:
    """Square roots of the shares of neighbouring byte classes, repetition, lengths."""
    out = np.zeros(N_FEATURES, np.float32)
    kinds = TABLE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if len(kinds) > 1:
        pairs = np.bincount((kinds[:-1] << 4) | kinds[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / (len(kinds) - 1))
    words = text.split()
    n = len(words)
    if n:
        seen = len(set(words))
        twice, thrice = sum(map(eq, words, words[1:])) / n, sum(map(eq, words, words[2:])) / n
        out[-N_EXTRA:] = (np.log1p(n) / 10, twice, np.sqrt(twice), min(twice, thrice) ** 0.25, twice > 0.3, seen / n, np.log1p(seen) / 10, np.log1p(len(text) / n), np.log1p(text.count("\n")) / 10)
    return out


def nn_pu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with the least non-negative unbiased risk
    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), by Adam on full batches."""
    w, m, v = np.zeros(positive.shape[1] + 1), 0.0, 0.0
    a = np.c_[positive, np.ones(len(positive))].astype(np.float64)
    b = np.c_[unlabelled, np.ones(len(unlabelled))].astype(np.float64)
    for t in range(1, EPOCHS + 1):
        gp, gu = a @ w, b @ w
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        as_negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        from_negative = b.T @ su / len(b) - prior * (a.T @ sp) / len(a)
        grad = prior * (a.T @ (sp - 1)) / len(a) + from_negative if as_negative >= 0 else -from_negative
        grad = grad + DECAY * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled. In any region the unlabelled are at least that share times
    as dense as the positives, so the least quotient bounds it; the regions are the highest scores of a
    model fitted on every other row, and the densities those of the rows it has not seen."""
    w, b = nn_pu_fit(positive[::2], unlabelled[::2], FIRST_PRIOR)
    sp, su = positive[1::2] @ w + b, unlabelled[1::2] @ w + b
    if not len(sp) or not len(su):
        return FIRST_PRIOR
    # two standard errors below: a prior that is too high makes the risk of negatives negative, which stops learning
    found = [((su >= np.quantile(sp, 1 - share)).sum(), share) for share in REGIONS]
    return float(np.clip(min((n - 2 * np.sqrt(n)) / len(su) / share for n, share in found), 0.05, 0.95))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Centre, scale, weights and bias. Reads all ids for counts, and the texts of the sample."""
    free = labels.where(~is_held_out(F.col("doc_id")))
    known = one_label(free, "quality")
    n_positive = known.where("quality = 1").count()
    none = (np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    if not n_positive:
        return none
    n_docs = docs.select("doc_id").count()
    trusted = known.where((F.col("quality") == 1) & in_sample(F.col("doc_id"), SAMPLE_ROWS, n_positive, 1)).select("doc_id", F.lit(True).alias("trusted"))
    web = in_sample(F.col("doc_id"), SAMPLE_ROWS, n_docs, 2) & ~is_held_out(F.col("doc_id"))
    # The trusted rows number about SAMPLE_ROWS whatever the input, so they may be broadcast.
    drawn = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(trusted), "doc_id", "left").select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"), F.coalesce(web, F.lit(False)).alias("web")).where("trusted or web")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("trusted", T.BooleanType()), T.StructField("web", T.BooleanType()), T.StructField("x", T.BinaryType())])

    def start():
        return lambda ids, texts, p, u: {"doc_id": ids, "trusted": p, "web": u, "x": [statistics(t or "").tobytes() for t in texts]}

    # one row for each id, so that the bound holds for rows too; in order, so that sums do not depend on how tasks end
    each = map_rows(drawn, schema, start).groupBy("doc_id", "trusted", "web").agg(F.min("x").alias("x"))
    rows = each.toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return none
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)
    p, u = rows["trusted"].to_numpy(), rows["web"].to_numpy()
    if not p.any() or not u.any():
        return none
    centre, scale = x[u].mean(0), x[u].std(0) + 0.01
    z = np.clip((x - centre) / scale, -8, 8)
    w, b = nn_pu_fit(z[p], z[u], class_prior(z[p], z[u]))
    return centre, scale, w, b


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document (doc_id, held_out, score, predicted)."""
    centre, scale, w, b = fit(docs, labels)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )

    def start():
        def work(ids: list, held: list, texts: list) -> dict:
            x = np.stack([statistics(t or "") for t in texts])
            g = np.clip((x - centre) / scale, -8, 8) @ w + b
            s = 1 / (1 + np.exp(-g))
            return {"doc_id": ids, "held_out": held, "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)), F.col("text").cast("string")), schema, start)
