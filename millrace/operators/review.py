"""Review of evaluation sets (L23): actions of reviewers applied to samples in order, and what came of each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Where a sample stands, and the words of its state.
PENDING, GOLDEN, REJECTED = "pending", "golden", "rejected"
APPROVED, SYNTHETIC, EXPERT, PROXY, MANUAL = "approved", "synthetic", "expert", "reference-proxy", "manual"

TEXTS = ("question", "answer", "reference", "source", "answerOrigin", "reviewStatus", "difficulty", "note", "reviewedBy")
LISTS = ("contexts", "tags")
FIELDS = ", ".join([*(f"{c} string" for c in TEXTS), *(f"{c} array<string>" for c in LISTS)])
RESULT = f"kind string, id string, {FIELDS}, seq long, action string, outcome string"


def without_repeats(held: list[str], new: list[str] | None) -> list[str]:
    held = list(held)
    for x in (x.strip() for x in new or [] if x is not None):
        if x and x not in held:
            held.append(x)
    return held


def lacks(sample: dict) -> str:
    """What a sample still needs before it may be approved."""
    return ",".join(c for c in ("question", "answer", "contexts") if not sample[c])


def act(slots: dict[str, dict], a: dict) -> str:
    """Applies one action to the slots of an id (pending, golden, rejected) and gives its outcome: done, or why it was refused."""
    said = lambda c: a[c] is not None
    stamp = {"reviewedBy": a["reviewedBy"]} | ({"note": a["note"]} if said("note") and a["note"] else {})
    match a["action"]:
        case "add":
            if GOLDEN in slots:
                return "REFUSED:exists"
            new = {c: (a[c] or "").strip() for c in ("question", "answer", "reference")}
            new |= {"source": EXPERT, "answerOrigin": MANUAL, "reviewStatus": APPROVED, "difficulty": a["difficulty"] or "simple", "note": a["note"], "reviewedBy": a["reviewedBy"]}
            new |= {c: without_repeats([], a[c]) for c in LISTS}
            if missing := lacks(new):
                return f"REFUSED:missing {missing}"
            slots[GOLDEN] = new
            return "DONE"
        case "edit":
            sample = slots.get(PENDING)
            if sample is None:
                return "REFUSED:in golden" if GOLDEN in slots else "REFUSED:not found"
            if not any(said(c) for c in ("question", "answer", "reference", "difficulty", "note", *LISTS)):
                return "REFUSED:nothing to change"
            sample |= {c: a[c].strip() for c in ("question", "answer", "reference") if said(c)}
            if said("answer") and sample["answerOrigin"] == PROXY:
                sample["answerOrigin"] = MANUAL
            if a["clear"]:
                sample["contexts"] = []
            sample |= {c: without_repeats(sample[c], a[c]) for c in LISTS}
            sample |= {c: a[c] for c in ("difficulty", "note") if said(c)} | {"reviewedBy": a["reviewedBy"]}
            return "DONE"
        case "approve":
            sample = slots.get(PENDING)
            if sample is None:
                return "KEPT:in golden" if GOLDEN in slots else "REFUSED:not found"
            if missing := lacks(sample):
                return f"REFUSED:missing {missing}"
            if sample["source"] == SYNTHETIC and sample["answerOrigin"] == PROXY and not a["keep_proxy"]:
                return "REFUSED:proxy answer"
            slots[GOLDEN] = slots.pop(PENDING) | stamp | {"reviewStatus": APPROVED}
            return "DONE"
        case "reject":
            place = PENDING if PENDING in slots else GOLDEN if GOLDEN in slots else None
            if place is None:
                return "REFUSED:not found"
            slots[REJECTED] = slots.pop(place) | stamp | {"reviewStatus": REJECTED}
            return "DONE"
    return "REFUSED:unknown action"


def review_eval_set(samples: DataFrame, actions: DataFrame) -> DataFrame:
    """What actions (id, seq, action, question, answer, reference, difficulty, note, reviewedBy, contexts, tags, clear, keep_proxy) leave
    of samples (id, place: pending or golden, and their fields): rows of kind pending, golden and rejected with a sample's fields,
    and of kind log with the outcome of each action. Actions on one id apply in order of seq.

    approve needs question, answer and contexts, and keep_proxy where a synthetic answer is still the reference's copy; edit works on
    pending samples only, a new answer makes such a copy a manual one, contexts and tags are appended without repeats; add puts an
    expert's sample straight into golden unless the id is there; reject takes a pending sample, else a golden one. The rows of
    an id pass one task in order, a batch at a time, with the sample alone carried on."""
    ship(samples.sparkSession)
    none = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    fields = lambda df: [*(none(df, c, "string") for c in TEXTS), *(none(df, c, "array<string>") for c in LISTS)]
    old = samples.select(F.col("id").cast("string").alias("id"), F.lit(-1).cast("long").alias("seq"), F.col("place").alias("action"), *fields(samples), F.lit(False).alias("clear"), F.lit(False).alias("keep_proxy"))
    new = actions.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), F.col("action"), *fields(actions), F.coalesce("clear", F.lit(False)).alias("clear"), F.coalesce("keep_proxy", F.lit(False)).alias("keep_proxy"))
    rows = old.unionByName(new).where("id is not null and seq is not null").repartition("id").sortWithinPartitions("id", "seq", "action")

    def row(kind: str, i: str, sample: dict | None = None, seq: int | None = None, action: str | None = None, outcome: str | None = None) -> dict:
        return {"kind": kind, "id": i} | {c: (sample or {}).get(c) for c in (*TEXTS, *LISTS)} | {"seq": seq, "action": action, "outcome": outcome}

    def review(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in RESULT.split(", ")]
        frame = lambda out: pd.DataFrame(out, columns=names).astype({"seq": "Int64"})
        now, slots = None, {}
        for batch in batches:
            out: list[dict] = []
            for a in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                a |= {c: None if a[c] is None else list(a[c]) for c in LISTS}
                if a["id"] != now:
                    out += [row(k, now, s) for k, s in slots.items()]
                    now, slots = a["id"], {}
                if a["seq"] < 0:
                    slots[a["action"]] = {c: a[c] for c in TEXTS} | {c: a[c] or [] for c in LISTS}
                else:
                    out.append(row("log", now, seq=a["seq"], action=a["action"], outcome=act(slots, a)))
            yield frame(out)
        yield frame([row(k, now, s) for k, s in slots.items()])

    return rows.mapInPandas(review, RESULT)
