"""Conflicts, task logs, reviews, extracted fields, and lineage edges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import once
from ..session import cut, ship, stash

#: What makes a difference critical; the transitions of a task (from, event, to).
DIGIT_OR_PERCENT = r"[\d%％]"
DATE_PART = r"\d{4}[-/年.]"
CURRENCY_UNIT = r"[元万千亿]"
NEGATION = r"禁止|不得|取消|不|未|无|非"
CRITICAL = "|".join((DIGIT_OR_PERCENT, DATE_PART, CURRENCY_UNIT, NEGATION))
#: Java's digits are those of ASCII.
CRITICAL_MARK = re.compile(CRITICAL, re.ASCII)
TRANSITIONS = (
    ("PENDING", "DISPATCH", "DISPATCH"),
    ("PENDING", "LEASE", "RUNNING"),
    ("DISPATCH", "LEASE", "RUNNING"),
    ("RUNNING", "SUSPEND", "SUSPENDED"),
    ("RUNNING", "WAIT_HUMAN", "WAITING_HUMAN"),
    ("SUSPENDED", "RESUME", "PENDING"),
    ("WAITING_HUMAN", "RESUME", "PENDING"),
    ("WAITING_HUMAN", "HUMAN_RESOLVE", "COMPLETED"),
    ("RUNNING", "REQUEST_CANCEL", "CANCELING"),
    ("SUSPENDED", "REQUEST_CANCEL", "CANCELING"),
    ("CANCELING", "CANCEL", "CANCELLED"),
    ("RUNNING", "RETRY", "PENDING"),
    ("RUNNING", "COMPLETE", "COMPLETED"),
    ("RUNNING", "FAIL", "FAILED"),
    ("FAILED", "REPLAY", "PENDING"),
    ("CANCELLED", "REPLAY", "PENDING"),
)
ACTIONS = ("KEEP_A", "KEEP_B", "KEEP_BOTH", "MERGE", "DELETE_A", "DELETE_B", "IGNORED")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two texts, bit by bit from the highest that the shorter one's length may have: at most
    31 comparisons, no loop over characters."""
    shortest = F.least(F.length(a), F.length(b))
    # one bit more than the logarithm says, which is rounded
    highest = F.least(F.floor(F.log2(F.greatest(shortest, F.lit(1)))) + 1, F.lit(30)).cast("int")
    steps = F.sequence(highest, F.lit(0), F.lit(-1))

    def longer(n: Column, k: Column) -> Column:
        m = n + F.pow(F.lit(2), k).cast("int")
        return F.when((m <= shortest) & (F.substring(a, n + 1, m - n) == F.substring(b, n + 1, m - n)), m).otherwise(n)

    return F.aggregate(steps, F.lit(0), longer)


def differing_parts(a: Column, b: Column) -> Column:
    """What is left of both texts, one after the other, without the beginning and then the end they share."""

    def tails(p: Column) -> Column:
        x, y = F.substring(a, p + 1, F.length(a)), F.substring(b, p + 1, F.length(b))
        return F.struct(x.alias("x"), y.alias("y"), F.reverse(x).alias("rx"), F.reverse(y).alias("ry"))

    def heads(t: Column) -> Column:
        cut = lambda s: F.concat(F.left(t["x"], F.length(t["x"]) - s), F.left(t["y"], F.length(t["y"]) - s))
        return once(common_prefix(t["rx"], t["ry"]), cut)

    return once(common_prefix(a, b), lambda p: once(tails(p), heads))


def critical_diff(a: Column, b: Column) -> Column:
    """Whether two texts differ in a digit, date, currency unit or negation; false for a missing text."""
    return F.when(a == b, False).otherwise(F.coalesce(differing_parts(a, b).rlike(CRITICAL), F.lit(False)))


def told_critical(rows: DataFrame) -> DataFrame:
    """rows (.., a_text, b_text) with critical, as critical_diff tells it, instead of the texts. Slices of Python's texts are compared at
    once; as a fold of substrings it took some milliseconds for each pair."""
    kept = [c for c in rows.columns if c not in ("a_text", "b_text")]

    def shared(x: str, y: str) -> int:
        low, high = 0, min(len(x), len(y))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
        return low

    def differs(x: str | None, y: str | None) -> bool:
        if x is None or y is None or x == y:
            return False
        n = shared(x, y)
        x, y = x[n:], y[n:]
        n = shared(x[::-1], y[::-1])
        return bool(CRITICAL_MARK.search(x[: len(x) - n] + y[: len(y) - n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("a_text"), batch.column("b_text"), strict=True)
            told = pa.array([differs(x.as_py(), y.as_py()) for x, y in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), told], [*kept, "critical"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("critical", T.BooleanType())]))


def judged_pairs(pairs: DataFrame, docs: DataFrame, dates: DataFrame) -> DataFrame:
    """(a, b, at, loser) of near-duplicate pairs (a < b): who would lose if both were there, the document of the earlier date if both
    have one, else the later arrival; null where the difference is critical. at: the time of the pair, (b, a)."""
    from .dedup import rows_of

    pairs = stash(pairs.select("a", "b").distinct())
    ids = stash(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = rows_of(docs.select("doc_id", "text"), ids).join(rows_of(dates.select("doc_id", "effective_date"), ids), "doc_id", "left")
    side = lambda n: texts.select(F.col("doc_id").alias(n), F.col("text").alias(f"{n}_text"), F.col("effective_date").alias(f"{n}_date"))
    rows = told_critical(pairs.join(side("a"), "a").join(side("b"), "b"))
    loser = F.when(F.col("critical"), None).when(F.col("b_date") > F.col("a_date"), F.col("a")).otherwise(F.col("b"))
    return stash(rows.select("a", "b", F.struct("b", "a").alias("at"), loser.alias("loser")))


def resolve_near_dups(pairs: DataFrame, docs: DataFrame, dates: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(a, b, outcome, loser) of near-duplicate pairs (a < b): a conflict without a loser where the difference is critical, else a
    merge whose loser is the document of the earlier date if both have one, else the later arrival.

    Documents arrive in order of their ids and meet those before them in the same order. Who has lost meets nobody any more, so
    such pairs are left out. Each round settles the pairs whose two documents cannot lose in an unsettled earlier pair. Conflicts
    among the known pairs (a, b, in any order) are not written again."""
    return settled(judged_pairs(pairs, docs, dates), known)


def settled(open_: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(a, b, outcome, loser) of judged pairs, as resolve_near_dups says. Rounds are stashed, not checkpointed: a checkpoint hands on
    the optimizer's estimate of its size, the product of what was joined, whose digits tripled with each round, in time and in the driver's memory."""
    done = open_.where("false")
    while True:
        unsettled = open_.where("loser is not null").groupBy(F.col("loser").alias("doc_id")).agg(F.min("at").alias("may"))
        lost = done.where("loser is not null").select(F.col("loser").alias("doc_id"), F.col("at").alias("lost"))
        fate = unsettled.join(lost, "doc_id", "full")
        x, y = (fate.select(F.col("doc_id").alias(n), F.col("may").alias(f"{n}_may"), F.col("lost").alias(f"{n}_lost")) for n in "ab")
        both = open_.join(x, "a", "left").join(y, "b", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("at"), F.lit(False))
        state = F.when(before("a_lost") | before("b_lost"), "void").when(before("a_may") | before("b_may"), "open").otherwise("done")
        judged = stash(both.select("a", "b", "at", "loser", state.alias("state")))
        done = stash(done.unionByName(judged.where("state = 'done'").drop("state")))
        open_ = judged.where("state = 'open'").drop("state")
        if not open_.limit(1).count():
            break
    done = done.select("a", "b", F.when(F.col("loser").isNull(), "CONFLICT").otherwise("MERGED").alias("outcome"), "loser")
    if known is None:
        return done
    seen = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("CONFLICT").alias("outcome"))
    return done.join(seen, ["a", "b", "outcome"], "left_anti")


def exact_copies(docs: DataFrame, dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, outcome, loser) of exact copies with the one that stays (EXACT), and the ids (doc_id) of those that stay, stored."""
    from .dedup import exact_dedup

    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    copies = cut(exact_dedup(texts.select("doc_id", F.lit(0).alias("idx"), F.col("text").alias("content")), dates).select("doc_id", "content_hash", "active"))
    kept = copies.where("active").select(F.col("doc_id").alias("kept"), "content_hash")
    exact = copies.where("not active").join(kept, "content_hash").select(F.least("doc_id", "kept").alias("a"), F.greatest("doc_id", "kept").alias("b"), F.lit("EXACT").alias("outcome"), F.col("doc_id").alias("loser"))
    return exact, cut(kept.select(F.col("kept").alias("doc_id")))


def resolve_copies(docs: DataFrame, dates: DataFrame) -> DataFrame:
    """(a, b, outcome, loser): exact copies with the one that stays (EXACT), and the near duplicates among those that stay."""
    from .near_index import arrivals

    exact, kept = exact_copies(docs, dates)
    return exact.unionByName(arrivals(docs.select("doc_id", "text"), dates, only=kept))


def conflict_candidates(hits: DataFrame, least: float = 0.85) -> DataFrame:
    """(query_id, a, b): pairs among the few chunks of a query whose cosine is at least `least` and whose difference is critical.
    hits: query_id, chunk_id, embedding, content; a query has at most k of them."""
    from .evaluation import cosine

    x, y = (hits.select("query_id", F.col("chunk_id").alias(n), F.col("embedding").alias(f"{n}_v"), F.col("content").alias(f"{n}_t")) for n in "ab")
    near = x.join(y, "query_id").where("a < b").where(cosine(F.col("a_v"), F.col("b_v")) >= least)
    return near.where(critical_diff(F.col("a_t"), F.col("b_t"))).select("query_id", "a", "b")


def arbitrate(members: DataFrame) -> DataFrame:
    """members (group_id, chunk_id, effective_date) with removed: true for all but the latest, where every date is known and
    one chunk alone has the latest; else the whole group stays."""
    groups = members.groupBy("group_id").agg(F.count_if(F.col("effective_date").isNull()).alias("undated"), F.max("effective_date").alias("last"))
    rows = members.join(groups, "group_id")
    at_last = rows.where("effective_date = last").groupBy("group_id").agg(F.count("*").alias("winners"))
    decided = rows.join(at_last, "group_id", "left").withColumn("decided", (F.col("undated") == 0) & (F.col("winners") == 1))
    return decided.select("group_id", "chunk_id", "effective_date", (F.col("decided") & (F.col("effective_date") < F.col("last"))).alias("removed"))


def apply_resolutions(conflicts: DataFrame, actions: DataFrame) -> DataFrame:
    """conflicts (conflict_id, a, b) with status and the chunk that goes; an action outside the list is an error and changes nothing."""
    act = F.col("action")
    status = F.when(act.isNull(), "OPEN").when(~act.isin(*ACTIONS), "ERROR").when(act == "IGNORED", "IGNORED").otherwise("RESOLVED")
    gone = F.when(act == "DELETE_A", F.col("a")).when(act == "DELETE_B", F.col("b"))
    return conflicts.join(actions.select("conflict_id", "action"), "conflict_id", "left").select("conflict_id", "a", "b", status.alias("status"), gone.alias("deactivated"))


def conflict_view(conflicts: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """conflicts with the named columns of both chunks, which may be missing."""
    for side in "ab":
        conflicts = conflicts.join(chunks.select(F.col("chunk_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side, "left")
    return conflicts


def validate_field(value: Column, kind: str = "STRING", required: bool = False, pattern: str | None = None, allowed: list[str] | None = None) -> Column:
    """Array of the checks that a value fails: REQUIRED, or any of the type's name, PATTERN and ENUM. Blank optional values pass."""
    v = F.trim(value)
    typed = {
        "NUMBER": v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
        "BOOLEAN": F.lower(v).isin("true", "false"),
        "DATE": F.try_to_timestamp(F.left(v, F.lit(10)), F.lit("yyyy-MM-dd")).isNotNull(),
        "STRING": F.lit(True),
    }[kind]
    tests = [F.when(~typed, kind)]
    if pattern:
        tests.append(F.when(~v.rlike(f"^(?:{pattern})$"), "PATTERN"))
    if allowed:
        tests.append(F.when(~F.lower(v).isin([a.lower() for a in allowed]), "ENUM"))
    missing = F.array(F.lit("REQUIRED")) if required else F.array().cast("array<string>")
    return F.when(F.coalesce(v, F.lit("")) == "", missing).otherwise(F.array_compact(F.array(*tests)))


def review_cases(fields: DataFrame, diffs: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_id, subject, kind): a LOW_CONFIDENCE case for each invalid or unsure field, one MATERIAL_DIFF case for each document
    and rule with a row that does not match."""
    unsure = fields.where(~F.col("valid") | (F.coalesce("confidence", F.lit(1.0)) < least)).select("doc_id", F.col("field_key").alias("subject"), F.lit("LOW_CONFIDENCE").alias("kind"))
    unlike = diffs.where(~F.col("match")).select("doc_id", F.col("rule").alias("subject"), F.lit("MATERIAL_DIFF").alias("kind")).distinct()
    return unsure.unionByName(unlike)


def dispose_reviews(cases: DataFrame, actions: DataFrame) -> DataFrame:
    """cases (case_id, status) after actions (case_id, action): only open cases change."""
    after = F.create_map(*(F.lit(x) for p in (("APPROVE", "APPROVED"), ("REJECT", "REJECTED"), ("EDIT", "EDITED")) for x in p))
    status = F.when(F.col("status") == "OPEN", F.coalesce(after[F.col("action")], F.col("status"))).otherwise(F.col("status"))
    return cases.join(actions.select("case_id", "action"), "case_id", "left").select("case_id", status.alias("status"))


def field_state(changes: DataFrame) -> DataFrame:
    """The current value of each field from its changes (doc_id, field_key, version, value, reviewed), and how many versions it has had."""
    last = F.max(F.struct("version", "value", "reviewed"))
    rows = changes.groupBy("doc_id", "field_key").agg(last.alias("l"), F.countDistinct("version").alias("versions"))
    return rows.select("doc_id", "field_key", "l.version", "l.value", F.when(F.col("l.reviewed"), "HUMAN").otherwise("MODEL").alias("source"), "versions")


def add_edges(edges: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """edges with the new ones that are not among them, each once."""
    fresh = new.select(*edges.columns).dropDuplicates(keys).join(edges.select(*keys), keys, "left_anti")
    return edges.unionByName(fresh)


def document_lineage(kinds: dict[str, DataFrame], doc_id: str) -> DataFrame:
    """Long form (kind, doc_id, payload) of the tables that describe documents; the payload is the row as JSON."""
    out: DataFrame | None = None
    for kind, df in kinds.items():
        rows = df.select(F.lit(kind).alias("kind"), F.col(doc_id), F.to_json(F.struct(*sorted(df.columns))).alias("payload"))
        out = rows if out is None else out.unionByName(rows)
    return out


def state_counts(df: DataFrame, column: str, states: list[str]) -> DataFrame:
    """Rows in each of the watched states, zeros included, from one aggregate row."""
    counts = df.agg(*(F.count_if(F.col(column) == s).alias(s) for s in states))
    pairs = F.array(*(F.struct(F.lit(s).alias(column), F.col(f"`{s}`").alias("n")) for s in states))
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def task_audit(log: DataFrame) -> DataFrame:
    """log (task_id, seq, event) with the state before it, the state after it, and whether the transition is legal.

    Every event of the list has one target, so the state before a row is the target of the last such event; other
    events leave the state as it is and are legal. An event at the start is legal only if it is SUBMIT.
    """
    targets = dict((e, to) for _, e, to in TRANSITIONS) | {"SUBMIT": "PENDING"}
    target = F.create_map(*(F.lit(x) for p in sorted(targets.items()) for x in p))[F.col("event")]
    w = Window.partitionBy("task_id").orderBy("seq")
    before = F.last("target", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("target", target).withColumn("before", before)
    listed = F.concat_ws(">", "before", "event").isin([f"{f}>{e}" for f, e, _ in TRANSITIONS])
    legal = F.when(F.col("target").isNull(), True).when(F.col("before").isNull(), F.col("event") == "SUBMIT").otherwise(listed)
    return rows.select("task_id", "seq", "event", "before", F.coalesce("target", "before").alias("after"), legal.alias("legal"))


def expired_leases(tasks: DataFrame, asof: Column) -> DataFrame:
    return tasks.where((F.col("status") == "RUNNING") & (F.col("lease_until") < asof))


def page_by(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of an order, from 0, of 1 to 100 rows."""
    size = min(max(size, 1), 100)
    return df.orderBy(*order).offset(page * size).limit(size)
