"""Model replies, conflicts, replays, golden sets, filters and evaluation samples.

Replies of models come as text columns; what does not parse gives no verdict and never an error."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import json_outer, with_json
from ..functions.text import SPACE
from ..session import cut, ship, stash
from .governance import critical_diff
from .records import run_rules

#: Types of entities and relations, and the one for all others; names a filter may use.
ENTITY_TYPES = ("人物", "组织", "产品", "地点", "概念", "事件", "规则")
RELATION_TYPES = ("属于", "包含", "依赖", "影响", "合作", "对抗", "引用", "继承")
OTHER_TYPE = "其他"
FILTER_FIELDS = {
    "domain": "domain_tag",
    "domain_tag": "domain_tag",
    "subDomain": "sub_domain_tag",
    "sub_domain_tag": "sub_domain_tag",
    "identity": "required_identity",
    "required_identity": "required_identity",
}
#: What an evaluation sample has where it says nothing.
SAMPLE_DEFAULTS = {"source": "seed-manual", "difficulty": "simple", "reviewStatus": "approved", "answerOrigin": "manual"}
SAMPLE_OPTIONAL = ("domain", "sourceRef", "reviewedBy", "reviewedAt", "note")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """replies (.., a, b, reply) that state a conflict of a and b, with entity, attribute, value_a and value_b. A reply that
    names chunks must name those two; in the other order its values change places. Other replies go."""
    fields = "conflict boolean, entity string, attribute string, valueA string, valueB string, chunkIdA string, chunkIdB string"
    r = with_json(replies, F.col("reply"), fields, "r").where("r.conflict")
    silent = F.col("r.chunkIdA").isNull() & F.col("r.chunkIdB").isNull()
    asked = F.col("r.chunkIdA").isin(F.col("a"), F.col("b")) & F.col("r.chunkIdB").isin(F.col("a"), F.col("b"))
    swapped = F.coalesce(F.col("r.chunkIdA") == F.col("b"), F.lit(False))
    value = lambda x, y: F.when(swapped, F.col(f"r.{y}")).otherwise(F.col(f"r.{x}"))
    kept = r.where(silent | F.coalesce(asked, F.lit(False)))
    named = kept.withColumns({"entity": F.col("r.entity"), "attribute": F.col("r.attribute"), "value_a": value("valueA", "valueB"), "value_b": value("valueB", "valueA")})
    return named.drop("r", "reply")


#: Links of one topic of a query up to which one task walks through them; longer lists go on in rounds.
LINKS_AT_ONCE = 4096


def least_of_linked(a: pd.Series, b: pd.Series) -> dict:
    """The least node that each node reaches by links of a and b."""
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = top(x), top(y)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(root)}


def conflict_groups(verdicts: DataFrame) -> DataFrame:
    """(query_id, topic, chunk_id, group_id): the chunks of each topic (entity and attribute, without case) of a query that
    verdicts (query_id, a, b, entity, attribute) link; group_id is the least of them. A chunk may be in groups of several topics.

    Topics of up to LINKS_AT_ONCE links are worked out in one pass, as one shuffle brings them together; only longer ones go on in
    rounds that are stored."""
    topic = F.concat_ws("::", F.coalesce(F.lower("entity"), F.lit("")), F.coalesce(F.lower("attribute"), F.lit("")))
    key = ["query_id", "topic"]
    ship(verdicts.sparkSession)
    edges = verdicts.select("query_id", topic.alias("topic"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartition(*key).distinct()
    edges = edges.withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    # a topic with a single link needs no walk
    one = edges.where("n = 1").select(*key, F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk_id"), F.col("a").alias("group_id"))
    kind = dict(edges.dtypes)["a"]
    pair = F.array_sort(F.collect_list(F.struct("a", "b"))).alias("links")
    lists = edges.where(F.col("n").between(2, LINKS_AT_ONCE)).groupBy(*key).agg(pair)
    node = F.pandas_udf(lambda links: links.map(lambda x: sorted(least_of_linked([r["a"] for r in x], [r["b"] for r in x]).items())), f"array<struct<chunk_id {kind}, group_id {kind}>>")
    some = lists.select(*key, F.inline(node("links")))
    many = stash(edges.where(F.col("n") > LINKS_AT_ONCE).drop("n"))
    out = one.unionByName(some)
    return out if many.isEmpty() else out.unionByName(linked_in_rounds(many, key))


def linked_in_rounds(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, chunk_id, group_id) of links (key, a, b), by rounds in which chains halve."""
    both = edges.unionByName(edges.select(*key, F.col("a").alias("b"), F.col("b").alias("a"))).distinct()
    both = cut(both.select(*key, F.col("a").alias("chunk_id"), F.col("b").alias("other")))
    label = both.groupBy(*key, "chunk_id").agg(F.min(F.least("chunk_id", "other")).alias("group_id"))
    while True:
        seen = both.join(label.select(*key, F.col("chunk_id").alias("other"), F.col("group_id").alias("theirs")), [*key, "other"])
        least = seen.groupBy(*key, "chunk_id").agg(F.min("theirs").alias("theirs"))
        # a label is itself a chunk: its own label is at least as low, so chains halve
        jump = label.select(*key, F.col("chunk_id").alias("group_id"), F.col("group_id").alias("root"))
        moved = label.join(least, [*key, "chunk_id"]).join(jump, [*key, "group_id"])
        low = F.least("group_id", "theirs", "root")
        moved = cut(moved.select(*key, "chunk_id", low.alias("group_id"), (low < F.col("group_id")).alias("moved")))
        label = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return label


#: Products of two blocks that one task works out, about.
PRODUCTS_AT_ONCE = 16


def conflict_scan(chunks: DataFrame, known: DataFrame | None = None, least: float = 0.8, block: int = 1024) -> DataFrame:
    """(domain, sub_domain, a, b, similarity, hint): the pairs a < b inside a domain and sub-domain of chunks (domain,
    sub_domain, chunk_id, embedding, content) whose cosine is above `least`: CONFLICT where the difference is critical, else
    REDUNDANT. Pairs in known (a, b, in any order) are left out, and so is every group that holds a vector without length.

    The rows of a group are dealt to blocks of about `block` rows; each pair of blocks is one task's product, and only hits
    leave it. So a group of n rows costs n / block copies of its vectors and no task holds more than two blocks."""
    key = ["domain", "sub_domain"]
    rows = chunks.where(F.coalesce(F.length(stripped(F.col("content"))), F.lit(0)) > 0)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = rows.select(*(F.coalesce(k, F.lit("")).alias(k) for k in key), "chunk_id", "embedding", norm.alias("norm"))
    groups = rows.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("norm").alias("shortest"))
    groups = stash(groups.where("shortest > 0"))
    tasks = (groups.agg(F.sum(F.expr("blocks * (blocks + 1L) / 2"))).first()[0] or 0) // PRODUCTS_AT_ONCE
    dealt = rows.join(groups, key).withColumn("mine", F.pmod(F.xxhash64("chunk_id"), "blocks").cast("int"))
    cell = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = dealt.select(*key, "chunk_id", "embedding", "mine", cell)
    spread = spread.select(*key, "chunk_id", "embedding", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    # as many tasks as there are products to share, however small they are as bytes
    spread = spread.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(tasks)), *key, "i", "j")

    def product(part: pa.Table) -> pa.Table:
        if len(pc.unique(pc.list_value_length(part["embedding"]))) > 1 or part["embedding"].null_count:
            raise ValueError("vectors of one group have different lengths")
        v = part["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(part), -1)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        ids, mine = part["chunk_id"].to_numpy(), part["mine"].to_numpy()
        i, j = part["i"][0].as_py(), part["j"][0].as_py()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        scores = v[left] @ v[right].T
        x, y = np.nonzero(scores > least)
        p, q, s = ids[left][x], ids[right][y], scores[x, y]
        # within one block each pair comes twice, and a vector meets itself
        once = p < q if i == j else p != q
        p, q, s = p[once], q[once], s[once]
        a, b = np.where(p < q, p, q), np.where(p < q, q, p)
        names = [pa.repeat(part[k][0], len(a)) for k in key]
        of = part.schema.field("chunk_id").type
        return pa.table([*names, pa.array(a, of), pa.array(b, of), pa.array(s, pa.float64())], [*key, "a", "b", "similarity"])

    kind = dict(rows.dtypes)["chunk_id"]
    hits = spread.groupBy(*key, "i", "j").applyInArrow(product, f"domain string, sub_domain string, a {kind}, b {kind}, similarity double")
    if known is not None:
        hits = hits.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    for side in "ab":
        hits = hits.join(chunks.select(F.col("chunk_id").alias(side), F.col("content").alias(f"{side}_text")), side)
    hint = F.when(critical_diff(F.col("a_text"), F.col("b_text")), "CONFLICT").otherwise("REDUNDANT")
    return hits.select(*key, "a", "b", "similarity", hint.alias("hint"))


def parse_filter(*expressions: str | None) -> Column:
    """The condition that filter expressions state together: field = v, field == v or field IN (v, ..), joined by AND.
    Conditions on other fields or without a value are left out; nothing left keeps every row. Null values fail."""
    kept = []
    for part in (p.strip() for e in expressions for p in re.split(r"(?i)\s+AND\s+", e or "")):
        m = re.match(r"(?is)(.+?) IN (.*)", part) or re.match(r"(?s)([^=]+)={1,2}(.*)", part)
        field = FILTER_FIELDS.get(m[1].strip()) if m else None
        values = re.sub(r"(?s)^\((.*)\)$", r"\1", m[2].strip()).split(",") if field else []
        values = [re.sub(r'(?s)^"(.*)"$', r"\1", re.sub(r"(?s)^'(.*)'$", r"\1", v.strip())) for v in values]
        if values := [v for v in values if v]:
            kept.append(F.coalesce(F.col(field).isin(values), F.lit(False)))
    return reduce(lambda x, y: x & y, kept, F.lit(True))


def judge_context(samples: DataFrame, parents: DataFrame, names: DataFrame, budget: int = 6000, least: int = 100) -> DataFrame:
    """(sample_id, context): the parents (doc_id, parent_index, content) of the documents of a sample (sample_id, place, doc_id), by
    place, each under a heading with its document's name. The first that exceeds the budget is cut and marked if more than `least`
    characters are left; all after it go. A sample without documents has an empty context."""
    said = parents.where(F.length(stripped(F.col("content"))) > 0).select("doc_id", F.struct("parent_index", stripped(F.col("content")).alias("c")).alias("p"))
    bodies = said.groupBy("doc_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("p")), lambda p: F.concat(p["c"], F.lit("\n")))).alias("body"))
    listed = samples.where(F.length(F.trim(F.col("doc_id").cast("string"))) > 0)
    rows = listed.join(names.select("doc_id", "name"), "doc_id", "left").join(bodies, "doc_id", "left")
    heading = F.concat(F.lit("\n【来源文档："), F.coalesce("name", F.col("doc_id").cast("string")), F.lit("】\n"))
    rows = rows.select("sample_id", "place", F.concat(heading, F.coalesce("body", F.lit(""))).alias("section"))
    w = Window.partitionBy("sample_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.length("section")).over(w)).withColumn("left", F.lit(budget) - F.col("end") + F.length("section"))
    whole = F.col("end") <= budget
    part = F.when(whole, F.col("section")).otherwise(F.concat(F.left("section", F.col("left").cast("int")), F.lit("\n…(已截断)\n")))
    kept = rows.where(whole | (F.col("left") > least)).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("x")))).alias("parts"))
    context = stripped(F.concat_ws("", F.transform("parts", lambda p: p["x"])))
    return samples.select("sample_id").distinct().join(kept, "sample_id", "left").select("sample_id", F.coalesce(context, F.lit("")).alias("context"))


def parse_extractions(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (chunk_id, name, type, description) and relations (chunk_id, source, target, type, description) of replies
    (chunk_id, reply). Blank names go, types outside the lists count as the other type, and both ends of a relation must be
    entities of the same reply."""
    fields = "entities array<struct<name string, type string, description string>>, relations array<struct<source string, target string, type string, description string>>"
    r = with_json(replies.select("chunk_id", "reply"), F.col("reply"), fields, "r")
    text = lambda c: stripped(F.coalesce(c, F.lit("")))
    closed = lambda c, known: F.when(text(c).isin(*known), text(c)).otherwise(OTHER_TYPE)
    entity = F.transform("r.entities", lambda e: F.struct(text(e["name"]).alias("name"), closed(e["type"], ENTITY_TYPES).alias("type"), text(e["description"]).alias("description")))
    # as a generator's output the list is made once; inline_outer spares a filter that would make it again
    r = r.select("chunk_id", "r", F.explode(F.array(F.filter(entity, lambda e: e["name"] != ""))).alias("entities"))
    relation = F.transform("r.relations", lambda x: F.struct(text(x["source"]).alias("source"), text(x["target"]).alias("target"), closed(x["type"], RELATION_TYPES).alias("type"), text(x["description"]).alias("description")))
    held = lambda end: F.array_contains(F.col("entities.name"), end)
    relations = F.filter(relation, lambda x: held(x["source"]) & held(x["target"]))
    return r.select("chunk_id", F.inline_outer("entities")).where("name is not null"), r.select("chunk_id", F.inline_outer(relations)).where("source is not null")


def as_map(columns: list[str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns)))


def same_value(a: Column, b: Column) -> Column:
    """Whether two values are the same text or the same number; two nulls are the same."""
    return F.coalesce(a.try_cast("double") == b.try_cast("double"), a.eqNullSafe(b))


def replay_rules(runs: DataFrame, program: dict, schema: str) -> DataFrame:
    """(run_id, status, key, old, new, changed): runs (run_id, input and output as JSON) under another program, by key of both
    outputs; values as text. An input that does not parse gives one FAILED row without a key."""
    read = runs.select("run_id", "output", F.from_json("input", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    broken = F.coalesce(F.col("r._bad").isNotNull(), F.lit(True))
    read = read.withColumn("broken", broken)
    done = run_rules(read.where("not broken").select("run_id", "output", "r.*").drop("_bad"), program)
    outputs = program.get("outputs") or [s["to"] for s in program["steps"]]
    old = F.coalesce(F.from_json("output", "map<string,string>"), F.create_map().cast("map<string,string>"))
    both = done.select("run_id", "status", old.alias("o"), as_map(outputs).alias("n"))
    both = both.select("run_id", "status", "o", "n", F.explode(F.array_union(F.map_keys("o"), F.map_keys("n"))).alias("key"))
    diff = both.select("run_id", "status", "key", F.try_element_at("o", "key").alias("old"), F.try_element_at("n", "key").alias("new"))
    failed = read.where("broken").selectExpr("run_id", "'FAILED' AS status", "CAST(NULL AS STRING) AS key", "CAST(NULL AS STRING) AS old", "CAST(NULL AS STRING) AS new", "CAST(NULL AS BOOLEAN) AS changed")
    return diff.withColumn("changed", ~same_value(F.col("old"), F.col("new"))).unionByName(failed)


def rule_golden(cases: DataFrame, program: dict, expected: str = "expected") -> DataFrame:
    """cases (case_id, inputs, and expected: a map from output to its text) with matched, total, score (0 without
    expectations) and passed: no output is missing or differs."""
    outputs = program.get("outputs") or [s["to"] for s in program["steps"]]
    ran = run_rules(cases, program).select("case_id", F.map_entries(expected).alias("e"), as_map(outputs).alias("n"))
    held = F.filter("e", lambda x: F.array_contains(F.map_keys("n"), x["key"]) & same_value(x["value"], F.try_element_at("n", x["key"])))
    counted = ran.select("case_id", F.size(held).alias("matched"), F.coalesce(F.size("e"), F.lit(0)).alias("total"))
    score = F.when(F.col("total") > 0, F.round(F.col("matched") / F.col("total"), 6)).otherwise(0.0)
    return counted.select("*", score.alias("score"), (F.col("matched") == F.col("total")).alias("passed"))


def parse_golden(cases: DataFrame, parsed: DataFrame) -> DataFrame:
    """cases (case_id, doc_id, contains: texts, pages, table_rows; null asks nothing) against parsed documents (doc_id, text,
    pages_found, rows_found): passed_checks, total, score (0 without checks) and passed. A missing document is an empty one; an
    expected table that is not there fails the case without counting as a check."""
    rows = cases.join(parsed.select("doc_id", "text", "pages_found", "rows_found"), "doc_id", "left")
    held = F.coalesce(F.size(F.filter("contains", lambda c: F.contains(F.coalesce("text", F.lit("")), c))), F.lit(0))
    asked = F.coalesce(F.size("contains"), F.lit(0))
    no_table = F.col("table_rows").isNotNull() & F.col("rows_found").isNull()
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    right = held + flag(F.col("pages") == F.coalesce("pages_found", F.lit(0))) + flag(F.col("table_rows") == F.col("rows_found"))
    total = asked + F.col("pages").isNotNull().cast("int") + (F.col("table_rows").isNotNull() & F.col("rows_found").isNotNull()).cast("int")
    out = rows.select("case_id", right.alias("passed_checks"), total.alias("total"), no_table.alias("no_table"))
    score = F.when(F.col("total") > 0, F.round(F.col("passed_checks") / F.col("total"), 6)).otherwise(0.0)
    return out.select("case_id", "passed_checks", "total", score.alias("score"), ((F.col("passed_checks") == F.col("total")) & ~F.col("no_table")).alias("passed"))


def apply_verdicts(pending: DataFrame, replies: DataFrame, most: int = 3) -> DataFrame:
    """pending (id, attempts) after replies (id, reply): JUDGED with faithful and relevant where a reply states at least one of
    them; else one attempt more, and FAILED after `most`. Values other than true and false state nothing."""
    said = replies.select("id", json_outer(F.col("reply"), "faithfulness string, relevance string, reason string").alias("r"))
    tri = lambda c: F.when(F.lower(stripped(c)) == "true", True).when(F.lower(stripped(c)) == "false", False)
    rows = pending.select("id", "attempts").join(said, "id", "left").select("id", (F.col("attempts") + 1).alias("attempts"), tri(F.col("r.faithfulness")).alias("faithful"), tri(F.col("r.relevance")).alias("relevant"), F.left("r.reason", F.lit(1024)).alias("reason"))
    judged = F.coalesce("faithful", "relevant").isNotNull()
    status = F.when(judged, "JUDGED").when(F.col("attempts") >= most, "FAILED").otherwise("PENDING")
    return rows.select("id", "attempts", "faithful", "relevant", F.when(judged, F.col("reason")).alias("reason"), status.alias("status"))


def normalise_samples(samples: DataFrame) -> DataFrame:
    """Evaluation samples with every column of the schema: what is missing or null takes its default, texts and lists are empty."""
    has = lambda c, kind: F.col(c) if c in samples.columns else F.lit(None).cast(kind)
    filled = lambda c, default: F.coalesce(has(c, "string"), F.lit(default)).alias(c)
    lists = [F.coalesce(has(c, "array<string>"), F.array().cast("array<string>")).alias(c) for c in ("contexts", "tags")]
    texts = [filled(c, "") for c in ("answer", "reference")]
    rest = [filled(c, d) for c, d in SAMPLE_DEFAULTS.items()]
    return samples.select("id", "question", *lists, *texts, *rest, *(has(c, "string").alias(c) for c in SAMPLE_OPTIONAL))


def list_versions(versions: DataFrame, doc: str, version: str) -> DataFrame:
    """Every version of a document with its place, the newest first."""
    w = Window.partitionBy(doc).orderBy(F.desc(version))
    return versions.select(doc, version, F.row_number().over(w).alias("place"))


def field_lineage(edges: DataFrame, history: DataFrame) -> DataFrame:
    """(kind, doc_id, field_key, payload): the edges that touch a field and the versions it has had; the payload is the row as JSON."""
    key = ["doc_id", "field_key"]
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), *key, F.to_json(F.struct(*sorted(df.columns))).alias("payload"))
    return row(edges, "edge").unionByName(row(history, "version"))


def running_by_tenant(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'RUNNING'").groupBy("tenant").agg(F.count("*").alias("n"))


def stuck_tasks(tasks: DataFrame, asof: Column, queued_before: Column) -> DataFrame:
    """PENDING tasks that are due and were not queued since `queued_before`."""
    due = F.col("next_run_at") <= asof
    idle = F.coalesce(F.col("queued_at") < queued_before, F.lit(True))
    return tasks.where((F.col("status") == "PENDING") & due & idle)
