"""Rules, lineage, graph, chat and access over tables (G, H, I, J, O)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bucket

#: What each identity may read, by sub-domain.
ALLOWED = {
    "business": ["business", "product"],
    "product": ["business", "product", "management"],
    "tech": ["business", "product", "tech", "safety"],
    "testing": ["business", "product", "testing"],
    "admin": ["business", "product", "tech", "testing", "safety", "management"],
}


class RuleError(ValueError):
    """A rule program that cannot be compiled."""


ARITH = re.compile(r"[\w\s.+*/()-]+")


def arith(expression: str, known: dict[str, Column]) -> Column:
    """A Column for + - * / and parentheses over numbers and fields; null for division by zero or a missing field."""
    if not ARITH.fullmatch(expression):
        raise RuleError(f"illegal expression: {expression}")
    import ast

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in (ast.Add, ast.Sub, ast.Mult, ast.Div):
            a, b = build(node.left), build(node.right)
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b)}[type(node.op)]()
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in known:
            return known[node.id].try_cast("double")
        raise RuleError(f"illegal expression: {expression}")

    try:
        return build(ast.parse(expression, mode="eval").body)
    except SyntaxError as e:
        raise RuleError(str(e)) from e


def step_column(op: str, p: dict, known: dict[str, Column], maps: set[str] = frozenset()) -> Column:
    if op == "materialDiff":
        for side in (p["left"], p["right"]):
            if side not in maps:
                raise RuleError(f"materialDiff needs a map: {side}")
        return material_diff(known[p["left"]], known[p["right"]])
    if op == "const":
        return F.lit(p["value"])
    if op == "arith":
        return arith(p["expr"], known)
    if op not in ("map", "regex", "enum", "compare"):
        raise RuleError(f"unknown op: {op}")
    if p["field"] not in known:
        raise RuleError(f"undefined field: {p['field']}")
    x = known[p["field"]]
    if op == "map":
        return x
    text = x.cast("string")
    if op == "regex":
        return F.coalesce(text.rlike(f"^(?:{p['pattern']})$"), F.lit(False))
    if op == "enum":
        return F.coalesce(text.isin([str(v) for v in p["values"]]), F.lit(False))
    right = known[p["right"][1:]] if str(p["right"]).startswith("$") else F.lit(p["right"])
    if p["cmp"] in ("==", "!="):
        same = F.coalesce(text == right.cast("string"), F.lit(False))
        return same if p["cmp"] == "==" else ~same
    a, b = x.try_cast("double"), right.try_cast("double")
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[p["cmp"]]


def run_rules(df: DataFrame, program: dict) -> DataFrame:
    """df with the program's outputs, which replace columns of the same name, and a status: FAILED where arithmetic has no result. The program
    (steps: op, params, to; outputs) compiles to columns; steps may use fields and earlier steps."""
    known = {c: F.col(f"`{c}`") for c in df.columns}
    maps = {c for c, kind in df.dtypes if kind.startswith("map<")}
    failed = F.lit(False)
    made: list[str] = []
    for s in program["steps"]:
        if not s.get("to"):
            raise RuleError("a step needs a target")
        known[s["to"]] = step_column(s["op"], s.get("params", {}), known, maps)
        if s["op"] == "map" and s["params"]["field"] in maps:
            maps.add(s["to"])
        else:
            maps.discard(s["to"])
        failed = failed | known[s["to"]].isNull() if s["op"] == "arith" else failed
        made.append(s["to"])
    outputs = program.get("outputs") or made
    if missing := set(outputs) - set(made):
        raise RuleError(f"undefined outputs: {sorted(missing)}")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (*outputs, "status")]
    return df.select(*kept, *(known[o].alias(o) for o in outputs), F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"))


def material_diff(a: Column, b: Column) -> Column:
    """Rows (key, value_a, value_b, match) over the keys of two maps, the left's first."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(a, k).alias("value_a"), F.try_element_at(b, k).alias("value_b"), F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)).alias("match")))


def version_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Values of two versions by key, with a flag for those that differ or stand in one version only."""
    x, y = a.select(key, F.col(value).alias("value_a")), b.select(key, F.col(value).alias("value_b"))
    return x.join(y, key, "full").withColumn("changed", ~F.col("value_a").eqNullSafe(F.col("value_b")))


def latest_version(versions: DataFrame, doc: str, version: str) -> DataFrame:
    return versions.groupBy(doc).agg(F.max(version).alias(version))


def upsert_relations(seen: DataFrame) -> DataFrame:
    """One relation for each source, target and type, weighing one for each sighting; where seen has description and order, with
    its descriptions merged as those of entities are."""
    key = ["source", "target", "type"]
    weights = seen.groupBy(*key).agg(F.sum(F.lit(1.0)).alias("weight"))
    if "description" not in seen.columns:
        return weights
    from .knowledge import merged_descriptions

    # a struct around the keys joins null keys too
    return weights.withColumn("k", F.struct(*key)).join(merged_descriptions(seen, key).select(F.struct(*key).alias("k"), "description"), "k").drop("k")


def neighbours(edges: DataFrame, matched: DataFrame, most: int = 10) -> DataFrame:
    """(entity, neighbour): up to `most` neighbours of each matched entity that are not matched themselves, by name."""
    out = edges.select(F.col("source").alias("entity"), F.col("target").alias("neighbour"))
    both = out.unionByName(edges.select(F.col("target").alias("entity"), F.col("source").alias("neighbour"))).distinct()
    near = both.join(matched, "entity", "left_semi").join(matched.select(F.col("entity").alias("neighbour")), "neighbour", "left_anti")
    w = Window.partitionBy("entity").orderBy("neighbour")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("entity", "neighbour")


def neighbour_edges(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """The edges (source, target, ..) from or to matched entities (entity), each once."""
    ends = matched.select("entity").distinct()
    out = edges.join(ends.withColumnRenamed("entity", "source"), "source", "left_semi").select(*edges.columns)
    back = edges.join(ends.withColumnRenamed("entity", "target"), "target", "left_semi").select(*edges.columns)
    return out.unionByName(back).distinct()


def can_access(df: DataFrame, identity: str, sub_domain: str) -> DataFrame:
    """df with allowed: whether the identity may read the sub-domain; an unknown identity counts as business."""
    who = F.when(F.lower(identity).isin(list(ALLOWED)), F.lower(identity)).otherwise("business")
    matrix = F.create_map(*(x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return df.withColumn("allowed", F.array_contains(matrix[who], F.col(sub_domain)))


def bucket_decision(df: DataFrame, feature: str, key: str, percent: int, deny: list[str] = (), allow: list[str] = ()) -> DataFrame:
    """df with on and reason: deny list, allow list, nobody or everybody, else by bucket."""
    k, b = F.col(key).cast("string"), bucket(feature, F.col(key).cast("string"))
    reason = F.when(k.isin(list(deny)), "DENY").when(k.isin(list(allow)), "ALLOW").when(F.lit(percent <= 0), "OFF").when(F.lit(percent >= 100), "FULL").otherwise("BUCKET")
    return df.withColumn("reason", reason).withColumn("on", F.col("reason").isin("ALLOW", "FULL") | ((F.col("reason") == "BUCKET") & (b < percent)))


def list_sessions(messages: DataFrame, title: int = 40) -> DataFrame:
    """Per conversation: number of messages, first and last turn, title from the first user message, else the first."""
    first = F.coalesce(F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"], F.min(F.struct("turn", "text"))["text"])
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.left(first, F.lit(title)).alias("title"))


def pair_answers(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user message with the next assistant message that says something."""
    said = F.when((F.col("role") == "assistant") & (F.trim("text") != ""), F.col("text"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rangeBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("answer", F.last(said, ignorenulls=True).over(w)).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def recent_turns(messages: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("conv_id", "turn", "role", "rank")
