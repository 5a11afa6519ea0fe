"""Splitting texts into chunks, stitching tables over pages, ingest and new versions."""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, content_hash
from ..session import dealt, ship, spread, stash
from . import dedup, near_index

#: Where a text may be split, best first. The first seven begin the next piece, the others end the one before;
#: after the last, pieces are cut between characters.
OPENING = ("\n# ", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "\n```")
CLOSING = ("\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", " ")
SEPARATORS = OPENING + CLOSING
#: White space that is stripped and costs nothing; characters of East Asian scripts, one token each.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"
ASIAN = "\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0002fa1f"
#: Sizes and overlaps of parents and children, in tokens.
PARENT, CHILD = (1000, 150), (350, 60)

_run = re.compile(r"[\x00-\x08\x0e-\x1b!-\x7f]+")
_word = re.compile("[0-9A-Za-z]")
_single = re.compile(f"[{ASIAN}]|[^\\x00-\\x7f{BLANK}]")


#: Runs of up to so many characters whose tokens a task remembers, and how many of them.
RUN_LENGTH, RUNS_HELD = 24, 1 << 16


class _Costs(dict):
    """Tokens by run of ASCII characters; words recur, so most are looked up."""

    def __missing__(self, run: str) -> int:
        letters = len(run) if run.isalnum() else len(_word.findall(run))
        n = -(-letters // 4) + len(run) - letters
        if len(run) <= RUN_LENGTH:
            if len(self) >= RUNS_HELD:
                self.clear()
            self[run] = n
        return n


_costs = _Costs()


def tokens(text: str) -> int:
    """Tokens of a text as functions.text.token_estimate counts them; never more than its characters."""
    return _recent(text) if len(text) <= PIECE_LENGTH else _counted(text)


def _counted(text: str) -> int:
    n = sum(map(_costs.__getitem__, _run.findall(text)))
    return n if text.isascii() else n + len(_single.findall(text))


#: Pieces of up to so many characters whose tokens a task remembers: one is packed into a parent and then into a child.
PIECE_LENGTH, PIECES_HELD = 1024, 4096
_recent = lru_cache(PIECES_HELD)(_counted)


def _cut(text: str, size: int) -> Iterator[str]:
    """Pieces of single characters, each as long as fits."""
    start = used = 0
    for i, ch in enumerate(text):
        n = tokens(ch)
        if used + n > size and i > start:
            yield text[start:i]
            start, used = i, 0
        used += n
    yield text[start:]


def _packed(pieces: Iterator[str], size: int, overlap: int) -> Iterator[str]:
    """Pieces joined while they fit; the last ones are carried over into the next chunk while they are below the overlap."""
    held: deque[tuple[str, int]] = deque()
    total = 0
    for piece in pieces:
        n = tokens(piece)
        if held and total + n > size:
            if chunk := "".join(p for p, _ in held).strip(BLANK):
                yield chunk
            while held and (total - held[0][1] >= overlap or total + n > size):
                total -= held.popleft()[1]
        held.append((piece, n))
        total += n
    if chunk := "".join(p for p, _ in held).strip(BLANK):
        yield chunk


def _parts(text: str, sep: str) -> Iterator[str]:
    """The parts of a text around a separator, which stays with the part that it opens or closes."""
    *before, last = text.split(sep)
    if sep in OPENING:
        return filter(None, (p if i == 0 else sep + p for i, p in enumerate((*before, last))))
    return filter(None, (*(p + sep for p in before), last))


def _split(text: str, seps: tuple[str, ...], size: int, overlap: int) -> Iterator[str]:
    here = next((i for i, s in enumerate(seps) if s in text), None)
    if here is None:
        return _packed(_cut(text, size), size, overlap)
    finer = seps[here + 1 :]
    fits = lambda p: [p] if len(p) <= size or tokens(p) <= size else _split(p, finer, size, overlap)
    return _packed((x for p in _parts(text, seps[here]) for x in fits(p)), size, overlap)


def split_text(text: str | None, size: int, overlap: int) -> list[str]:
    """The chunks of one text: split at the best separator that occurs, too long pieces at the next ones, then packed."""
    text = (text or "").strip(BLANK)
    if not text:
        return []
    return [text] if len(text) <= size or tokens(text) <= size else list(_split(text, SEPARATORS, size, overlap))


def split_chunks(docs: DataFrame, size: int = CHILD[0], overlap: int = CHILD[1]) -> DataFrame:
    """(doc_id, idx, content): the chunks of each document (doc_id, text), in order. One pass that holds one document
    at a time, by all cores; an empty or missing text has no chunks."""
    ship(docs.sparkSession)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if chunks := split_text(text, size, overlap):
                    yield pd.DataFrame({"doc_id": [doc] * len(chunks), "idx": range(len(chunks)), "content": chunks})

    kind = dict(docs.dtypes)["doc_id"]
    return spread(docs.select("doc_id", "text").where("doc_id is not null")).mapInPandas(split, f"doc_id {kind}, idx int, content string")


def chunk_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def parent_child_chunks(docs: DataFrame, parent: tuple[int, int] = PARENT, child: tuple[int, int] = CHILD) -> DataFrame:
    """(doc_id, version, parent_index, child_index, parent_id, chunk_id, content, content_hash) of documents (doc_id, version,
    text): parents, and children inside each of them, the parent itself where it fits. Ids are digests of the places, so a
    task that runs again gives the same ones."""
    rows = pieces(spread(docs.select("doc_id", "version", "text").where("doc_id is not null and version is not null")), parent, child)
    return with_ids(rows.where("child_index is not null"))


#: Rows of chunks that are handed on at once.
CHUNKS_AT_ONCE = 512


def pieces(docs: DataFrame, parent: tuple[int, int] = PARENT, child: tuple[int, int] = CHILD) -> DataFrame:
    """Documents (.., text) with parent_index, child_index and content instead of the text: a row for each child, and one with nulls
    for a document that has none. One narrow pass."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, p_index, c_index, content = [], [], [], []
            for i, text in enumerate(batch.column(len(kept))):
                some = [(p, c, x) for p, y in enumerate(split_text(text.as_py(), *parent)) for c, x in enumerate(split_text(y, *child))]
                for p, c, x in some or [(None, None, None)]:
                    at.append(i)
                    p_index.append(p)
                    c_index.append(c)
                    content.append(x)
                if len(at) >= CHUNKS_AT_ONCE or (at and i + 1 == len(batch)):
                    own = batch.select(list(range(len(kept)))).take(pa.array(at, pa.int32())).columns if kept else []
                    yield pa.RecordBatch.from_arrays([*own, pa.array(p_index, pa.int32()), pa.array(c_index, pa.int32()), pa.array(content, pa.string())], [*kept, "parent_index", "child_index", "content"])
                    at, p_index, c_index, content = [], [], [], []

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), "parent_index int, child_index int, content string"])
    return docs.select(*kept, "text").mapInArrow(run, schema)


def with_ids(rows: DataFrame) -> DataFrame:
    place = [F.col(c) for c in ("doc_id", "version", "parent_index")]
    ids = (chunk_id(*place).alias("parent_id"), chunk_id(*place, F.col("child_index")).alias("chunk_id"))
    return rows.select(*place, "child_index", *ids, "content", content_hash(F.col("content")).alias("content_hash"))


#: Cells, about, of the least table of a page: pages are dealt by them, with wide rows.
CELLS_A_PAGE = 4


def stitch_tables(cells: DataFrame, n: int | None = None) -> DataFrame:
    """cells (doc_id, page_no, row, col, text) of one table a page as tables over pages: first_page, rows and columns numbered
    through, width, and ambiguous. Consecutive pages with a table form one run; a later page's first row that equals the first
    page's goes; a run is ambiguous where widths differ or a row went. n: how many cells there are, about; counted if not given."""
    trimmed = F.trim(F.coalesce("text", F.lit("")))
    header = F.array_sort(F.collect_list(F.when(F.col("row") == 0, F.struct("col", trimmed.alias("t")))))
    pages = cells.groupBy("doc_id", "page_no").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), header.alias("header"))
    pages = dealt(pages, (cells.count() if n is None else n) // CELLS_A_PAGE, "doc_id")
    pages = pages.withColumn("run", F.col("page_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")))
    run = Window.partitionBy("doc_id", "run")
    order = run.orderBy("page_no")
    texts = F.transform("header", lambda h: h["t"])
    first = F.first(texts).over(order)
    again = (F.row_number().over(order) > 1) & (F.size(first) > 0) & (texts == first)
    pages = pages.withColumn("again", again.cast("int"))
    before = F.coalesce(F.sum(F.col("height") - F.col("again")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unlike = (F.min("width").over(run) != F.max("width").over(run)) | (F.max("again").over(run) == 1)
    places = pages.select("doc_id", "page_no", F.min("page_no").over(run).alias("first_page"), F.max("width").over(run).alias("width"), (before - F.col("again")).alias("shift"), "again", unlike.alias("ambiguous"))
    kept = cells.join(places, ["doc_id", "page_no"]).where("row > 0 or again = 0")
    return kept.select("doc_id", "first_page", "page_no", (F.col("row") + F.col("shift")).cast("long").alias("row"), "col", "text", "width", "ambiguous")


PLACE = ["doc_id", "version", "parent_index", "child_index"]


def first_copies(chunks: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(content_hash, place) of the chunk (place, content_hash, effective_date) that stays of equal ones: the first to arrive if it
    has no date, else the first of the latest date. seen: chunks of the same columns that were there before all others."""
    rows = chunks.select("content_hash", F.lit(1).alias("late"), "place", "effective_date")
    if seen is not None:
        before = seen.join(chunks.select("content_hash").distinct(), "content_hash", "left_semi")
        rows = rows.unionByName(before.select("content_hash", F.lit(0).alias("late"), "place", "effective_date"))
    back = F.struct(-F.unix_date("effective_date"), "late", "place")
    best = rows.groupBy("content_hash").agg(F.min(F.struct("late", "place", "effective_date")).alias("first"), F.min(F.when(F.col("effective_date").isNotNull(), back)).alias("last"))
    return best.select("content_hash", F.when(F.col("first.effective_date").isNull(), F.col("first.place")).otherwise(F.col("last.place")).alias("place"))


def ingest(docs: DataFrame, active: DataFrame, dates: DataFrame | None = None, near: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, outcomes) of documents (doc_id, version, text). Documents among active (doc_id) are SKIPPED, those empty after
    cleaning REJECTED. Of equal chunks one stays (first_copies, by the documents' dates (doc_id, effective_date), if given), then,
    unless near is false, near duplicates in other documents go by the rule of near_index.arrivals. A document that keeps no
    chunk is MERGED, others are INGESTED; verified says whether all chunks counted as kept are there, each once.

    Texts are stored once, as chunks, and never shuffled but those of pairs; what stays is told by places."""
    chunks, state = new_chunks(docs, active, dates)
    kept = stash(first_copies(chunks).select("place"))
    if near:
        texts, days = as_texts(chunks)
        lost = near_losers(near_index.arrivals(texts, days, own="doc_id", only=kept.select(F.col("place").alias("doc_id"))))
        kept = stash(kept.join(lost, "place", "left_anti"))
    stays = chunks.join(few(kept), "place", "left_semi")
    return stays.drop("place", "effective_date"), outcomes(state, stays.select("doc_id", "version", "chunk_id"))


def few(ids: DataFrame) -> DataFrame:
    """Stored ids, as a broadcast if there are not too many: then what they pick from is not shuffled."""
    return F.broadcast(ids) if ids.limit(dedup.BROADCAST_IDS + 1).count() <= dedup.BROADCAST_IDS else ids


def new_chunks(docs: DataFrame, active: DataFrame, dates: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The chunks of documents that are neither known nor empty, with place and effective_date; and the state of each document:
    doc_id, version, known and empty. Both are read from one stored table, in which a document without chunks has one row."""
    cleaned = docs.select("doc_id", "version", clean_text(F.col("text")).alias("text"))
    known = stash(active.select("doc_id", F.lit(True).alias("known")).distinct())
    told = cleaned.join(few(known), "doc_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    # a document is empty by its cleaned text alone; one without an id or a version has no chunks
    lone = F.col("known") | F.col("doc_id").isNull() | F.col("version").isNull()
    rows = stash(pieces(told.select("doc_id", "version", "known", (F.col("text") == "").alias("empty"), F.when(~lone, F.col("text")).alias("text"))))
    state = rows.where("coalesce(parent_index, 0) = 0 and coalesce(child_index, 0) = 0").select("doc_id", "version", "known", "empty")
    chunks = with_ids(rows.where("child_index is not null")).withColumn("place", F.struct(*PLACE))
    if dates is None:
        return chunks.withColumn("effective_date", F.lit(None).cast("date")), state
    return chunks.join(few(stash(dates.select("doc_id", "effective_date"))), "doc_id", "left"), state


def as_texts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks as texts of the near-duplicate rule, by place, and their dates."""
    return chunks.select(F.col("place").alias("doc_id"), F.col("content").alias("text")), chunks.select(F.col("place").alias("doc_id"), "effective_date")


def near_losers(rows: DataFrame) -> DataFrame:
    return rows.where("loser is not null").select(F.col("loser").alias("place")).distinct()


def outcomes(state: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, version, outcome, chunks, verified) of each document."""
    counts = kept.groupBy("doc_id", "version").agg(F.count("*").alias("kept"), F.countDistinct("chunk_id").alias("ids"))
    outcome = F.when(F.col("known"), "SKIPPED").when(F.col("empty"), "REJECTED").when(F.col("kept").isNull(), "MERGED").otherwise("INGESTED")
    rows = state.join(counts, ["doc_id", "version"], "left")
    return rows.select("doc_id", "version", outcome.alias("outcome"), F.coalesce("kept", F.lit(0)).alias("chunks"), F.coalesce(F.col("kept") == F.col("ids"), F.lit(True)).alias("verified"))


#: Rows of versions, which are narrow, that count as one where they are dealt. So there are fewer than 200 tasks up to some 10 GB: with
#: more, Spark's writer of a shuffle also holds rows in memory.
VERSIONS_AS_ONE = 8


def reparse(versions: DataFrame, asked: DataFrame, n: int | None = None) -> DataFrame:
    """versions (doc_id, version, status) with a new ACTIVE version after the last one of each asked document (doc_id) and its
    parent; their versions that were ACTIVE are SUPERSEDED. n: how many rows both have, about; counted if not given.

    One shuffle and sort of both: what is asked comes first among the rows of a document, then its last version. So no task holds
    a table of documents, and a task sorts as many rows however many there are."""
    kind = dict(versions.dtypes)["version"]
    said = versions.select("doc_id", "version", "status", F.lit(False).alias("asks"))
    ids = asked.where("doc_id is not null").select("doc_id", F.lit(None).cast(kind).alias("version"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("asks"))
    rows = dealt(said.unionByName(ids), (versions.count() + asked.count() if n is None else n) // VERSIONS_AS_ONE, "doc_id")
    w = Window.partitionBy("doc_id").orderBy(F.desc("asks"), F.desc_nulls_last("version"))
    rows = rows.select("*", F.first("asks").over(w).alias("wanted"), F.lag("asks").over(w).alias("opens")).where("not asks")
    status = F.when(F.col("wanted") & (F.col("status") == "ACTIVE"), "SUPERSEDED").otherwise(F.col("status"))
    old = F.struct("doc_id", "version", status.alias("status"), F.lit(None).cast(kind).alias("parent"))
    new = F.struct("doc_id", F.expr("version + 1").alias("version"), F.lit("ACTIVE").alias("status"), F.col("version").alias("parent"))
    return rows.select(F.inline(F.when(F.col("opens"), F.array(old, new)).otherwise(F.array(old))))
