"""Removal of repeated passages by winnowing over line hashes. DataFrame functions only.

A document is the sequence of its lines that hold words. A window is the shortest stretch of lines
from a given line that reaches `min_words` words; the smallest line hash of each window is its
fingerprint, kept with the hash of the whole window, so every repeated run of that many words has
one. Each fingerprint is joined to the first place (by doc_id, then text hash, then line) where it
stands, matches are extended both ways along that alignment while the lines are equal, and runs of
at least `min_words` words are deleted from the later place. The first occurrence always stays.

Runs shorter than `min_words` stay, so common short lines are left alone. Null texts count as empty
and come back null. Rows with the same doc_id and text are one document: none is a repeat of the
other and all get the same result. Null ids sort first. Other columns pass through; columns named
like this module's own (leading underscore) do not disturb it. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

MIN_WORDS = 50
LEAST_ID = -(2**63)


def doc_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.coalesce(doc_id.cast("long"), F.lit(LEAST_ID)), F.xxhash64(F.coalesce(text, F.lit("")))


def worded_lines(docs: DataFrame) -> DataFrame:
    """(_d, _t, line, h, words): lines with words, by their place in the text, once for each document."""
    _d, _t = doc_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(_d.alias("_d"), _t.alias("_t"), F.split("text", "\n").alias("lines")).select("_d", "_t", F.posexplode("lines").alias("line", "s"))
    rows = rows.select("_d", "_t", "line", F.xxhash64(F.trim("s")).alias("h"), F.regexp_count("s", F.lit("[^\\s]+")).alias("words"))
    return rows.where("words > 0")


def placed_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Lines with their rank among worded lines and, where a full window starts, its hash g and the rank of its least line."""
    w = Window.partitionBy("_d", "_t").orderBy("line")
    rows = worded_lines(docs).withColumn("before", F.lag("line").over(w)).where("before is null or before != line")
    rows = rows.withColumn("pos", F.row_number().over(w)).withColumn("ends", F.sum("words").over(w)).withColumn("starts", F.col("ends") - F.col("words"))
    ahead = Window.partitionBy("_d", "_t").orderBy("starts").rangeBetween(0, min_words - 1)
    rows = rows.withColumn("least", F.min(F.struct("h", "pos")).over(ahead)).withColumn("all", F.collect_list("h").over(ahead)).withColumn("reach", F.max("ends").over(ahead))
    full = F.col("reach") - F.col("starts") >= min_words
    return rows.select("_d", "_t", "line", "pos", "h", "words", F.when(full, F.xxhash64("all")).alias("g"), F.when(full, F.col("least.h")).alias("mark"), F.when(full, F.col("least.pos")).alias("mark_pos"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_d, _t, first, last, words): runs of lines to delete, by their places in the text."""
    lines = cut(placed_lines(docs, min_words))
    marks = lines.where("g is not null").select("_d", "_t", "mark", "g", "mark_pos")
    # One row for each fingerprint that occurs twice: the aggregation combines on the map side, so a
    # fingerprint of a third of the documents costs one row a task.
    firsts = marks.groupBy("mark", "g").agg(F.min(F.struct("_d", "_t", "mark_pos")).alias("at"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts.select("mark", "g", F.col("at._d").alias("_d0"), F.col("at._t").alias("_t0"), F.col("at.mark_pos").alias("pos0")))
    pairs = marks.join(firsts, ["mark", "g"]).where("_d != _d0 or _t != _t0 or mark_pos != pos0")
    aligned = cut(pairs.select("_d", "_t", "_d0", "_t0", (F.col("mark_pos") - F.col("pos0")).alias("shift")).distinct())
    own = lines.select("_d", "_t", "line", "pos", "h", "words").join(aligned, ["_d", "_t"]).withColumn("pos0", F.col("pos") - F.col("shift"))
    source = lines.select(F.col("_d").alias("_d0"), F.col("_t").alias("_t0"), F.col("pos").alias("pos0"), "h")
    equal = own.join(source, ["_d0", "_t0", "pos0", "h"])
    along = Window.partitionBy("_d", "_t", "_d0", "_t0", "shift").orderBy("pos")
    runs = equal.withColumn("run", F.col("pos") - F.row_number().over(along)).groupBy("_d", "_t", "_d0", "_t0", "shift", "run")
    return runs.agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum("words").alias("words")).where(F.col("words") >= min_words).select("_d", "_t", "first", "last", "words")


def delete_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs gone from text, and _lines_removed: how many lines of each text went."""
    runs = repeated_runs(docs, min_words).groupBy("_d", "_t").agg(F.collect_set(F.struct("first", "last")).alias("_runs"))
    _d, _t = doc_key(docs["doc_id"], docs["text"])
    keyed = docs.select(*(F.col(f"`{c}`") for c in docs.columns), _d.alias("__d"), _t.alias("__t"))
    runs = runs.select(F.col("_d").alias("__d"), F.col("_t").alias("__t"), F.col("_runs").alias("__runs"))
    joined = keyed.join(runs.hint("shuffle_hash"), ["__d", "__t"], "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda s, i: ~F.exists("__runs", lambda r: (i >= r["first"]) & (i <= r["last"])))
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    gone = F.when(F.col("__runs").isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    return joined.select(*out, gone.alias("_lines_removed"))
