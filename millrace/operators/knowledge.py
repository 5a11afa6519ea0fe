"""Pages, templates, access to search results, reranking, dashboards, screening reports and artifacts (A6, B, C, F, G, H, I, J, K, L, N, O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_similarity
from ..session import stash


def reconcile_pages(pages: DataFrame, least: float = 0.85, sure: float = 0.8) -> DataFrame:
    """pages (.., text, reading, confidence) with conflict, and chosen: in a conflict the second reading if it is sure, else the text layer."""
    conflict = text_similarity(F.col("text"), F.col("reading")) < least
    chosen = F.when(conflict & (F.col("confidence") >= sure), F.col("reading")).otherwise(F.col("text"))
    return pages.withColumn("conflict", conflict).withColumn("chosen", chosen)


def render_template(rows: DataFrame, templates: DataFrame, names: list[str]) -> DataFrame:
    """rows (code, and the columns in names) with the ACTIVE template of their code, each {name} replaced by the
    column's value (null: empty); rows without a template go. Templates are a small table, one to a code."""
    active = templates.where("status = 'ACTIVE'").select("code", F.col("body").alias("rendered"))
    out = rows.join(active, "code")
    for n in names:
        out = out.withColumn("rendered", F.replace("rendered", F.lit("{" + n + "}"), F.coalesce(F.col(n).cast("string"), F.lit(""))))
    return out


def map_pages(chunks: DataFrame, pages: DataFrame, key_length: int = 20, least: int = 6) -> DataFrame:
    """chunks (doc_id, chunk_id, content) with page_no: the first page (doc_id, page_no, text) of their document that
    holds the first characters of the chunk, white space apart; null for short chunks and where no page does."""
    squash = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    keyed = chunks.select("doc_id", "chunk_id", F.left(squash(F.col("content")), F.lit(key_length)).alias("key")).where(F.length("key") >= least)
    found = keyed.join(pages.select("doc_id", "page_no", squash(F.col("text")).alias("page")), "doc_id").where(F.contains("page", "key"))
    return chunks.join(found.groupBy("doc_id", "chunk_id").agg(F.min("page_no").alias("page_no")), ["doc_id", "chunk_id"], "left")


def delete_docs(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those of deleted documents."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def set_effective_date(docs: DataFrame, existing: str, asked: str) -> DataFrame:
    """docs with effective_date and outcome: a date once set stays; a new one must be a day as yyyy-MM-dd."""
    day = F.when(F.col(asked).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr(f"try_to_date(`{asked}`, 'yyyy-MM-dd')"))
    outcome = F.when(F.col(existing).isNotNull(), "KEPT").when(day.isNotNull(), "SET").when(F.col(asked).isNull(), "NONE").otherwise("INVALID")
    return docs.withColumn("effective_date", F.coalesce(F.col(existing), day)).withColumn("outcome", outcome)


def acl_filter(hits: DataFrame, chunks: DataFrame, meta: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """hits (.., chunk_id) whose chunk exists and is active and whose metadata, if any, is active and meets every condition (null fails)."""
    ok = F.col("meta_active")
    for field, value in conditions.items():
        ok = ok & (F.col(field) == value)
    tagged = meta.select("chunk_id", F.col("active").alias("meta_active"), *conditions, F.lit(True).alias("tagged"))
    live = hits.join(chunks.where("active").select("chunk_id"), "chunk_id").join(tagged, "chunk_id", "left")
    return live.where(F.col("tagged").isNull() | F.coalesce(ok, F.lit(False))).select(*hits.columns)


def accumulate(hits: DataFrame) -> DataFrame:
    """hits (query_id, parent_id, child_index, score, place) of all rounds by parent: first place, best score, and the
    child that has it, the lowest on ties."""
    best = F.max_by("child_index", F.struct("score", -F.col("child_index")))
    return hits.groupBy("query_id", "parent_id").agg(F.min("place").alias("place"), F.max("score").alias("score"), best.alias("child_index"))


def apply_rerank(parents: DataFrame, scores: DataFrame) -> DataFrame:
    """parents (query_id, parent_id, place, score) in the order of external scores (query_id, parent_id, new_score), if a
    query has two candidates or more and each has a score; else as they were."""
    w = Window.partitionBy("query_id")
    rows = parents.join(scores, ["query_id", "parent_id"], "left").withColumn("full", (F.count("*").over(w) >= 2) & (F.count("new_score").over(w) == F.count("*").over(w)))
    order = w.orderBy(F.when(F.col("full"), -F.col("new_score")), "place", "parent_id")
    score = F.when(F.col("full"), F.col("new_score")).otherwise(F.col("score"))
    return rows.select("query_id", "parent_id", F.row_number().over(order).alias("place"), score.alias("score"))


def record_retrieval(sources: DataFrame) -> DataFrame:
    """One RETRIEVED and one CITED event for each source (chunk_id, similarity)."""
    return sources.select("chunk_id", "similarity", F.explode(F.array(F.lit("RETRIEVED"), F.lit("CITED"))).alias("event_type"))


def history_by_user(events: DataFrame, user: str, time: str, key: str, k: int) -> DataFrame:
    """The k newest events of each user."""
    w = Window.partitionBy(user).orderBy(F.desc(time), F.desc(key))
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Descriptions of one key that are folded at once; what is left is folded again, until one is left.
FOLDED = 200


def merged_descriptions(seen: DataFrame, key: list[str], most: int = 2000) -> DataFrame:
    """(key, description): the distinct descriptions of each key of seen (key, description, order) merged in their order: one that the other
    holds goes, others are joined by a semicolon; cut at `most` characters.

    The first FOLDED descriptions of a key are folded, then of the others only those that would still change the text, FOLDED at
    a time: no key is gathered whole. Each makes the text longer until it is full, and a full one changes only for one that holds
    all of it, so a few rounds are enough."""
    said = seen.where("coalesce(description, '') != ''").groupBy(F.struct(*key).alias("k"), "description").agg(F.min("order").cast("long").alias("order"))
    merged = lambda a, x: F.when(F.contains(a, x), a).when(F.contains(x, a), x).otherwise(F.concat(a, F.lit("；"), x))
    step = lambda a, x: F.left(F.when(a == "", x).otherwise(merged(a, x)), F.lit(most))
    rest, texts = stash(said), None
    while not rest.isEmpty():
        ranked = rest.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("order", "description"))).where(F.col("r") <= FOLDED)
        some = ranked.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("r", "description", "order"))).alias("some"))
        both = some.withColumn("text", F.lit("")) if texts is None else texts.drop("last").join(some, "k", "full").withColumn("text", F.coalesce("text", F.lit("")))
        folded = F.aggregate(F.transform(F.coalesce("some", F.array().cast("array<struct<r:int,description:string,order:bigint>>")), lambda x: x["description"]), F.col("text"), step)
        last = F.element_at("some", -1)
        texts = stash(both.select("k", folded.alias("text"), F.struct(last["order"].alias("order"), last["description"].alias("description")).alias("last")))
        later = rest.join(texts, "k").where(F.struct("order", "description") > F.col("last"))
        changes = ~F.contains("text", "description") & ((F.length("text") < most) | (F.contains("description", "text") & (F.left("description", F.lit(most)) != F.col("text"))))
        rest = stash(later.where(changes).select("k", "description", "order"))
    keys = seen.select(F.struct(*key).alias("k")).distinct()
    if texts is None:
        return keys.select("k.*", F.lit("").alias("description"))
    return keys.join(texts, "k", "left").select("k.*", F.coalesce("text", F.lit("")).alias("description"))


def upsert_entities(seen: DataFrame, most: int = 2000) -> DataFrame:
    """One entity for each name and type of seen (name, type, description, order), with its descriptions merged in order."""
    return merged_descriptions(seen.where("name is not null and trim(name) != ''"), ["name", "type"], most)


def list_entities(nodes: DataFrame, page: int, size: int, kind: str | None = None) -> DataFrame:
    """One page, from 0, of 1 to 100 active entities (id, type, created_at, ..), of one type if given, newest first, with how many there are."""
    size = min(max(size, 1), 100)
    live = nodes.where("active") if kind is None else nodes.where(F.col("active") & (F.col("type") == kind))
    total = live.agg(F.count("*").alias("total"))
    return live.orderBy(F.desc("created_at"), F.desc("id")).offset(page * size).limit(size).crossJoin(F.broadcast(total))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: active nodes, active edges, types of active nodes."""
    live = nodes.where("active").agg(F.count("*").alias("entities"), F.countDistinct("type").alias("types"))
    return live.join(edges.where("active").agg(F.count("*").alias("relations")))


def document_graph(nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, kind, id) of active nodes and edges of documents."""
    part = lambda df, kind: df.where("active").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit(kind).alias("kind"), "id")
    return part(nodes, "NODE").unionByName(part(edges, "EDGE")).distinct()


def deactivate_graph(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Graph rows with active false where their document is among docs."""
    gone = docs.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    return rows.join(gone, "doc_id", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def tag_versions(chunks: DataFrame, tagged: DataFrame, domains: DataFrame, artifacts: DataFrame, length: int = 200) -> DataFrame:
    """tag_chunks for chunks that also have version, page_no and active, with these carried on and the artifact that a chunk comes from: of
    artifacts (doc_id, version, type, page_no, artifact_id) the OCR of its page, else the cleaned text of its version."""
    new = chunks.join(tagged.select("chunk_id").distinct(), "chunk_id", "left_anti").join(domains, "doc_id", "left")
    of = lambda kind, name, *key: artifacts.where(F.col("type") == kind).groupBy("doc_id", "version", *key).agg(F.min("artifact_id").alias(name))
    new = new.join(of("PAGE_OCR", "_page", "page_no"), ["doc_id", "version", "page_no"], "left").join(of("CLEANED", "_text"), ["doc_id", "version"], "left")
    return new.select("doc_id", "chunk_id", F.coalesce("domain", F.lit("general")).alias("domain"), F.left("content", F.lit(length)).alias("snippet"), "version", "page_no", "active", F.coalesce("_page", "_text").alias("artifact_id"))


def tag_chunks(chunks: DataFrame, tagged: DataFrame, domains: DataFrame, length: int = 200) -> DataFrame:
    """A metadata row for each chunk (doc_id, chunk_id, content) without one: its document's domain, or general, and a snippet."""
    new = chunks.join(tagged.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return new.join(domains, "doc_id", "left").select("doc_id", "chunk_id", F.coalesce("domain", F.lit("general")).alias("domain"), F.left("content", F.lit(length)).alias("snippet"))


def newest_first(rows: DataFrame, where: Column, time: str, key: str, page: int, size: int) -> DataFrame:
    """One page of the rows that meet a filter, newest first, with their place."""
    w = Window.orderBy(F.desc(time), F.desc(key))
    top = rows.where(where).orderBy(F.desc(time), F.desc(key)).limit((page + 1) * size)
    return top.withColumn("place", F.row_number().over(w)).where(F.col("place") > page * size)


def rule_set_lifecycle(versions: DataFrame) -> DataFrame:
    """versions (code, version, body, published) with checksum, changed (against the version before) and status: the last published one is
    ACTIVE, those published before it ARCHIVED, others DRAFT."""
    by, before = Window.partitionBy("code"), Window.partitionBy("code").orderBy("version")
    last = F.max(F.when(F.col("published"), F.col("version"))).over(by)
    status = F.when(~F.col("published"), "DRAFT").when(F.col("version") == last, "ACTIVE").otherwise("ARCHIVED")
    checked = versions.withColumn("checksum", F.sha2("body", 256))
    changed = ~F.col("checksum").eqNullSafe(F.lag("checksum").over(before))
    return checked.select("code", "version", "checksum", changed.alias("changed"), status.alias("status"))


def assemble_extraction(values: DataFrame, pages: str, least: float = 0.75) -> DataFrame:
    """values (.., value, confidence, page_no, required) with confidence clamped to 0..1 (null: 1), a page beyond the document nulled, and the reasons for review."""
    sure = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))), F.lit(1.0))
    page = F.when(F.col("page_no").between(1, F.col(pages)), F.col("page_no"))
    reasons = F.array_compact(F.array(F.when(sure < least, "LOW_CONFIDENCE"), F.when(F.col("required") & F.col("value").isNull(), "MISSING_REQUIRED")))
    return values.withColumn("confidence", sure).withColumn("page_no", page).withColumn("reasons", F.array_join(reasons, ","))


def artifact_register(pages: DataFrame) -> DataFrame:
    """One artifact for each (doc_id, version, type, page_no) of pages (.., content): digest and size in bytes of its least content."""
    one = pages.groupBy("doc_id", "version", "type", "page_no").agg(F.min("content").alias("content"))
    return one.select("doc_id", "version", "type", "page_no", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def output_to_lineage(results: DataFrame, keys: list[str], outputs: list[str]) -> DataFrame:
    """A RULE field with a RULED edge for each output of a rule run that has a value."""
    rows = results.select(*keys, F.explode(F.create_map(*(x for o in outputs for x in (F.lit(o), F.col(o).cast("string"))))).alias("field", "value"))
    return rows.where("value is not null").withColumn("source", F.lit("RULE")).withColumn("edge", F.lit("RULED"))


def in_window(time: Column, start: str | None, end: str | None) -> Column:
    """Whether a time is in a closed interval with open ends; no time only is where both ends are open."""
    if start is None and end is None:
        return F.lit(True)
    ok = time.isNotNull()
    ok = ok & (time >= F.expr(f"timestamp_ntz'{start}'")) if start else ok
    return ok & (time <= F.expr(f"timestamp_ntz'{end}'")) if end else ok


def dashboard_30d(snapshot: DataFrame, stale: DataFrame, precision: DataFrame) -> DataFrame:
    """One row: the snapshot's counts, stale chunks, and the labelled precision."""
    return snapshot.join(stale.agg(F.count_if("stale").alias("stale"))).join(precision.select("precision", F.col("n").alias("labelled")))


def dashboard_7d(events: DataFrame, asof: str) -> DataFrame:
    """One row: events of the last seven days by kind, and how many chunks they touch."""
    recent = events.where(in_window(F.col("created_at"), None, asof) & (F.col("created_at") > F.expr(f"timestamp_ntz'{asof}' - interval 7 days")))
    kinds = (("RETRIEVED", "retrieved"), ("CITED", "cited"), ("FEEDBACK_USEFUL", "useful"), ("FEEDBACK_USELESS", "useless"))
    return recent.agg(*(F.count_if(F.col("event_type") == k).alias(n) for k, n in kinds), F.countDistinct("chunk_id").alias("chunks"))


def dashboard_week(events: DataFrame, chunks: DataFrame, conflicts: DataFrame, audits: DataFrame, violations: DataFrame, asof: str) -> DataFrame:
    """dashboard_7d's row, and chunks (created_at) older than 180 days, conflicts that are open, and of the last seven days the blocks
    among audits (result, created_at), the violations (violation, created_at) and their kinds, a closed list, in order."""
    now = F.expr(f"timestamp_ntz'{asof}'")
    recent = lambda df: df.where((F.col("created_at") <= now) & (F.col("created_at") > now - F.expr("interval 7 days")))
    parts = [
        chunks.agg(F.count_if(F.col("created_at") < now - F.expr("interval 180 days")).alias("old_chunks")),
        conflicts.agg(F.count_if(F.col("status") == "OPEN").alias("open_conflicts")),
        recent(audits).agg(F.count_if(F.col("result") == "BLOCK").alias("blocks")),
        recent(violations).agg(F.count("*").alias("violations"), F.array_join(F.array_sort(F.collect_set("violation")), ",").alias("kinds")),
    ]
    out = dashboard_7d(events, asof)
    for p in parts:
        out = out.crossJoin(F.broadcast(p))
    return out


def feedback_to_events(feedback: DataFrame) -> DataFrame:
    """feedback (feedback_id, chunk_id, useful, created_at) on chunks as usage events; feedback without a chunk or an opinion gives none."""
    kind = F.when(F.col("useful"), "FEEDBACK_USEFUL").otherwise("FEEDBACK_USELESS")
    rows = feedback.where("chunk_id is not null and useful is not null")
    return rows.select(F.concat(F.lit("f"), F.col("feedback_id").cast("string")).alias("event_id"), "chunk_id", kind.alias("event_type"), "created_at")


def feedback_stats(events: DataFrame) -> DataFrame:
    """(chunk_id, useful, useless) of chunks with feedback."""
    kind = F.col("event_type")
    rows = events.where(kind.isin("FEEDBACK_USEFUL", "FEEDBACK_USELESS")).groupBy("chunk_id")
    return rows.agg(F.count_if(kind == "FEEDBACK_USEFUL").alias("useful"), F.count_if(kind == "FEEDBACK_USELESS").alias("useless"))


def screen_chain(rows: DataFrame, text: str, detectors: list[tuple[str, Column, bool]]) -> DataFrame:
    """rows with audit (detector, result) of each detector that ran, in order, and blocked: the first blocking detector that
    hits stops the chain. detectors: name, condition, whether a hit blocks."""
    stopped, audits = F.lit(False), []
    for name, hit, blocks in detectors:
        hit = F.coalesce(hit, F.lit(False))
        result = F.when(hit, "BLOCK" if blocks else "SANITIZE").otherwise("PASS")
        audits.append(F.when(~stopped, F.struct(F.lit(name).alias("detector"), result.alias("result"))))
        stopped = stopped | hit if blocks else stopped
    return rows.withColumn("audit", F.array_compact(F.array(*audits))).withColumn("blocked", stopped)


def screening_report(audited: DataFrame) -> DataFrame:
    """(detector, result, n) over the audits of a screening chain."""
    return audited.select(F.inline("audit")).groupBy("detector", "result").agg(F.count("*").alias("n"))


def session_messages(rows: DataFrame, session: str, order: str, sources: str, schema: str) -> DataFrame:
    """The rows of each session with their place and typed sources; JSON that doesn't parse gives none."""
    w = Window.partitionBy(session).orderBy(order)
    return rows.withColumn("place", F.row_number().over(w)).withColumn("typed", F.coalesce(F.from_json(sources, schema), F.from_json(F.lit("[]"), schema)))
