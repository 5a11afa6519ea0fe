"""Screening of texts by an ordered chain of detectors (N4, N5), for tables and for streams of answers (P5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: How much of a text an audit keeps, and how grave a block is.
KEPT, SEVERITY = 4000, "HIGH"
AUDIT = "array<struct<detector: string, result: string, risk: double, content: string>>"
VIOLATION = "array<struct<violation: string, reason: string, content: string, severity: string>>"


@dataclass(frozen=True)
class Detector:
    """What a detector does with a text: rewrite gives the text that goes on, or find gives the reason to block it, null for none."""

    name: str
    risk: float
    rewrite: Callable[[Column], Column] | None = None
    find: Callable[[Column], Column] | None = None
    violation: str | None = None


def screen(name: str, products: tuple[str, ...] = ()) -> Detector:
    """A blocking detector for one of the pattern lists of functions.text; the reason is the place of the first pattern that matches."""
    patterns, risk = X.screens(products)[name]
    return Detector(name.lower(), risk, find=lambda t: F.concat(F.lit("pattern "), X.first_match(t, patterns).cast("string")), violation=name)


def blocked_kinds(kinds: tuple[str, ...]) -> Detector:
    """A blocking detector for kinds of personal data that may not pass even masked."""
    patterns = {"ID_CARD": X.ID_CARD, "PHONE": X.PHONE, "BANK_CARD": X.BANK_CARD, "EMAIL": f"[{X.LOCAL}]+@{X.DOMAIN}"}
    find = lambda t: F.coalesce(*(F.when(t.rlike(patterns[k]), F.lit(k)) for k in kinds))
    return Detector("pii_block", 0.9, find=find, violation="PII")


MASK = Detector("pii_mask", 0.5, rewrite=X.mask_pii)
REDACT = Detector("pii_redact", 0.5, rewrite=X.redact_output)


def input_chain(products: tuple[str, ...] = (), blocked: tuple[str, ...] = ()) -> list[Detector]:
    """What questions pass: masks, then the injection screen; kinds of personal data to block come first."""
    return [*([blocked_kinds(blocked)] if blocked else []), MASK, screen("PROMPT_INJECTION", products)]


def output_chain(products: tuple[str, ...] = ()) -> list[Detector]:
    """What answers pass: redaction, then the screens for prompts that leak and for protected material."""
    return [REDACT, screen("SYSTEM_PROMPT_LEAK", products), screen("PROTECTED_MATERIAL", products)]


def screen_texts(rows: DataFrame, text: str, chain: list[Detector]) -> DataFrame:
    """rows with content, blocked, audits and violations: each detector gets the text that the one before it left. A rewrite that
    changes the text is a SANITIZE, the first reason to block a BLOCK that ends the chain: content is null then, and the violation
    has the text as it came. audits has a row for each detector that ran, with the text that it got. A null or blank text passes
    unseen, without audits."""
    seen = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    state = F.struct(F.col(text).alias("content"), F.lit(False).alias("blocked"), F.array().cast(AUDIT).alias("audits"), F.array().cast(VIOLATION).alias("violations"))
    passed = state
    by = lambda d: lambda s: step(d, s, F.col(text))
    for d in chain:
        state = X.once(state, by(d))
    rows = rows.withColumn("_state", F.when(seen, state).otherwise(passed))
    return rows.withColumns({c: F.col(f"_state.{c}") for c in ("content", "blocked", "audits", "violations")}).drop("_state")


def step(d: Detector, s: Column, came: Column) -> Column:
    """The state of a text (content, blocked, audits, violations) after one detector more."""
    now, runs = s["content"], ~s["blocked"]
    after = F.when(runs, d.rewrite(now)).otherwise(now) if d.rewrite else now
    reason = F.when(runs, d.find(now)) if d.find else F.lit(None).cast("string")

    def told(r: Column) -> Column:
        stop = r["reason"].isNotNull()
        result = F.when(stop, "BLOCK").when(~r["after"].eqNullSafe(now), "SANITIZE").otherwise("PASS")
        risk = F.when(stop | ~r["after"].eqNullSafe(now), F.lit(d.risk)).otherwise(F.lit(0.0))
        audit = F.array(F.struct(F.lit(d.name).alias("detector"), result.alias("result"), risk.alias("risk"), F.left(now, F.lit(KEPT)).alias("content")))
        broken = F.array(F.struct(F.lit(d.violation).cast("string").alias("violation"), r["reason"].alias("reason"), F.left(came, F.lit(KEPT)).alias("content"), F.lit(SEVERITY).alias("severity")))
        return F.struct(
            F.when(stop, None).otherwise(r["after"]).alias("content"),
            (s["blocked"] | stop).alias("blocked"),
            F.when(runs, F.concat(s["audits"], audit.cast(AUDIT))).otherwise(s["audits"]).alias("audits"),
            F.when(stop, F.concat(s["violations"], broken.cast(VIOLATION))).otherwise(s["violations"]).alias("violations"),
        )

    return X.once(F.struct(after.alias("after"), reason.alias("reason")), told)


def rows_of(screened: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, place from 1, and the fields of each element of a column. The outer form keeps the chain from being repeated in a filter of
    empty arrays, which Spark would else put before it."""
    rows = screened.select(*keys, F.posexplode_outer(column).alias("place", "x")).where("place is not null")
    return rows.select(*keys, (F.col("place") + 1).alias("place"), "x.*")


def audit_rows(screened: DataFrame, *keys: str) -> DataFrame:
    """A row for each detector that ran on a text, in order: keys, place, detector, result, risk and the text it got."""
    return rows_of(screened, "audits", *keys)


def violation_rows(screened: DataFrame, *keys: str) -> DataFrame:
    """A row for each text that was blocked: keys, violation, reason, the text as it came, and severity."""
    return rows_of(screened, "violations", *keys).drop("place")


def report(screened: DataFrame) -> DataFrame:
    """(kind, name, value, n): how often each detector had each result, and each kind of violation each severity; both are closed lists."""
    both = F.concat(
        F.transform("audits", lambda x: F.struct(F.lit("audit").alias("kind"), x["detector"].alias("name"), x["result"].alias("value"))),
        F.transform("violations", lambda x: F.struct(F.lit("violation").alias("kind"), x["violation"].alias("name"), x["severity"].alias("value"))),
    )
    return rows_of(screened.select(both.alias("found")), "found").groupBy("kind", "name", "value").agg(F.count("*").alias("n"))


def screen_answers(answers: DataFrame, chain: list[Detector] | None = None) -> DataFrame:
    """(session, content, blocked, violation, reason, audits) of whole answers (session, text) of a table or a stream: streaming.state.answers_of
    gives each session's answer once, when its first `done` comes, so each passes the chain once."""
    rows = screen_texts(answers, "text", output_chain() if chain is None else chain)
    first = F.get("violations", F.lit(0))
    return rows.select("session", "content", "blocked", first["violation"].alias("violation"), first["reason"].alias("reason"), "audits")
