"""Benchmark decontamination by template windows. DataFrame functions only.

Text is canonicalised to a template: numbers, units after numbers, and names (capitalised words
inside a sentence) become typed placeholders, other words lose case and punctuation. Windows of
`width` template words are hashed and joined: all windows of the benchmark that hold at least
`literal` ordinary words, with every `stride`-th window of the documents, by default each one, so
that any width + stride - 1 equal words in a row are found. A hit gives an alignment of document and
item. Along it the words are compared one by one, and so are the slots under the placeholders: a
value of the item must always stand for the same value of the document, else the alignment does not
count. A pair is contaminated if equal words along its alignments are at least `share` of the item's.

A capitalised word that begins a sentence may be a name or not. Windows are hashed in all forms, each
such word as itself or as a name. Two such words, or one and a name, that differ count as equal along
an alignment if that contradicts none of its other values.

Items with fewer than `width` words make one window of their whole template, matched by windows of
that length, if they have at least LEAST_ITEM words. Null or empty texts match
nothing; rows with a null id match nothing and are kept. Repeated rows with one id count once. Empty
tables give no pairs; other columns pass through.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

WIDTH, LITERAL, STRIDE, SHARE = 8, 4, 1, 0.5
LEAST_ITEM = 5
NAME = "\u0001name"
#: Benchmark windows up to this many are broadcast (about 100 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 100_000

#: Units that may follow a number.
UNITS = "mm|cm|dm|m|km|in|inch|inches|ft|feet|foot|yd|yards|mile|miles|mg|g|kg|lb|lbs|oz|ounces|pounds|tons|ml|l|liters|litres|gallons|s|sec|seconds|min|minutes|h|hr|hours|days|weeks|months|years|hz|khz|mhz|ghz|v|w|kw|j|kj|n|pa|k|c|f|°c|°f|mph|kph|kmh|usd|eur|gbp|dollars|euros|pounds|cents|percent|%"


def template_text(text: Column, values: bool = False) -> Column:
    """The text in lower case with placeholders (\\x01 and a kind), each with its value behind it if asked for.
    \\x04 stands before a capitalised word that begins a sentence."""
    text = F.translate(text, "\u0004", " ")
    value = "\u0002$0\u0003" if values else ""
    held = "\\x{2}[^\\x{3}]*\\x{3}" if values else ""
    t = F.regexp_replace(text, r"(?=\d)(?<![\p{L}\p{N}\x{1}])\d[\d.,]*(?![\p{L}\p{N}])", "\u0001num" + value)
    t = F.regexp_replace(t, rf"(\x{{1}}num{held}[.,]?\s{{1,3}})((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", "$1\u0001unit" + value.replace("$0", "$2"))
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}\p{L}*", "\u0001name" + value)
    t = F.regexp_replace(t, r"(?=\p{Lu})(?<![\p{L}\p{N}\x{1}\x{2}])\p{Lu}\p{Ll}\p{L}*", "\u0004$0")
    return F.lower(t)


def words_of(text: Column) -> Column:
    """Template words: runs of letters, digits and placeholders; \\x04 before those that may be names."""
    return F.array_remove(F.split(template_text(text), r"[^\p{L}\p{N}\x{1}\x{4}]+"), "")


def slots_of(text: Column) -> Column:
    """Array of structs (w, slot, name): template words as in words_of, the value under a placeholder or null, and the
    value of what is or may be a name or null."""
    words = F.array_remove(F.split(template_text(text, True), r"(?:[^\p{L}\p{N}\x{1}-\x{4}.,]|[.,](?![\d.,]*\x{3}))+"), "")

    def parts(w: Column) -> Column:
        slot = F.nullif(F.regexp_extract(w, r"\x{2}([^\x{3}]*)\x{3}", 1), F.lit(""))
        bare = F.regexp_replace(w, r"\x{2}[^\x{3}]*\x{3}|\x{4}", "")
        return F.struct(bare.alias("w"), slot.alias("slot"), F.when(bare == NAME, slot).when(F.contains(w, F.lit("\u0004")), bare).alias("name"))

    return F.transform(words, parts)


def windows(rows: DataFrame, key: str, widths: Column, width: int, stride: int = 1) -> DataFrame:
    """(key, n, pos, h, plain): hashes of every stride-th template window of each of the widths (at most `width`), in all forms;
    n template words in the text, plain ordinary words in the window."""
    # explode_outer of one element keeps what is costly from being computed again in filters and projections
    words = rows.select(key, F.explode_outer(F.array(words_of(F.col("text")))).alias("w"))
    # a word in one number: its hash, its kind in the last two bits (0 ordinary, 1 a name or not, 2 a placeholder)
    kind = lambda w: F.when(F.substring(w, 1, 1) == "\u0004", 1).when(F.substring(w, 1, 1) == "\u0001", 2).otherwise(0)
    number = lambda w: F.shiftleft(F.shiftright(F.xxhash64(F.ltrim(w, F.lit("\u0004"))), 2), 2).bitwiseOR(kind(w).cast("long"))
    coded = words.select(key, F.explode_outer(F.array(F.transform("w", number))).alias("c")).select(key, "c", F.size("c").alias("n"))
    sized = coded.where("n > 0").select(key, "c", "n", F.explode(widths).alias("width")).where("width <= n")
    placed = sized.select(key, "c", "n", "width", F.explode_outer(F.sequence(F.lit(1), F.col("n") - F.col("width") + 1, F.lit(stride))).alias("pos"))
    each = placed.select(key, "n", "pos", *(F.when(F.col("width") > j, F.get("c", F.col("pos") + (j - 1))).alias(f"c{j}") for j in range(width)))
    bit = lambda j, kind: F.when(F.col(f"c{j}").bitwiseAND(F.lit(3)) == kind, 1 << j).otherwise(0)
    total = lambda parts: functools.reduce(lambda x, y: x + y, parts)
    each = each.select("*", total(bit(j, 1) for j in range(width)).alias("may"), total(bit(j, 0) for j in range(width)).alias("sure"))
    # the forms are the subsets of the words that may be names
    subsets = F.expr("array(" + ", ".join(f"array({', '.join(str(m) for m in range(may + 1) if m & ~may == 0)})" for may in range(1 << width)) + ")")
    forms = each.select("*", F.explode_outer(F.get(subsets, F.col("may"))).alias("names"))
    name = F.shiftright(F.xxhash64(F.lit(NAME)), 2)
    h = F.xxhash64(*(F.when(F.col("names").bitwiseAND(F.lit(1 << j)) != 0, name).otherwise(F.shiftright(f"c{j}", 2)) for j in range(width)))
    return forms.select(key, "n", "pos", h.alias("h"), F.bit_count(F.col("sure") + F.col("may") - F.col("names")).alias("plain"))


def literal_windows(items: DataFrame, width: int, literal: int) -> DataFrame:
    """Windows of the benchmark with enough ordinary words: equal hashes mean equal words, so the
    windows of documents need no such test."""
    made = windows(items, "item_id", F.array(F.least(F.lit(width), F.col("n"))), width)
    return made.where((F.col("n") >= LEAST_ITEM) & (F.col("plain") >= F.least(F.lit(literal), F.col("n"))))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, literal: int = LITERAL, stride: int = STRIDE, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_words, share): items of the benchmark that documents contain, by equal words."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    marks = cut(literal_windows(items, width, literal).select("item_id", "h", F.col("pos").alias("at"), F.col("n").alias("of")).distinct())
    # limit() only bounds the counting: the size of what may be broadcast is checked, nothing is cut off.
    small = marks.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    widths = [r[0] for r in marks.select(F.least(F.lit(width), F.col("of"))).distinct().collect()] or [width]
    found = windows(texts, "doc_id", F.array(*map(F.lit, widths)), width, stride).join(F.broadcast(marks) if small else marks, "h")
    aligned = cut(found.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift")).distinct())
    # Only documents and items of an alignment are read again, for their words and slots.
    doc_slots = texts.join(aligned.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", slots_of(F.col("text")).alias("d"))
    item_slots = items.join(aligned.select("item_id").distinct(), "item_id", "left_semi").select("item_id", slots_of(F.col("text")).alias("i"))
    both = doc_slots.join(aligned, "doc_id").join(item_slots, "item_id")
    part = F.slice("d", F.greatest(F.lit(1), 1 + F.col("shift")), F.size("i"))
    placed = F.arrays_zip(F.slice("i", F.greatest(F.lit(1), 1 - F.col("shift")), F.size("i")).alias("i"), part.alias("d"))
    same = F.filter(placed, lambda x: x["i"]["w"] == x["d"]["w"])
    slots = F.array_distinct(F.transform(F.filter(same, lambda x: x["i"]["slot"].isNotNull()), lambda x: F.struct(x["i"]["slot"].alias("i"), x["d"]["slot"].alias("d"))))
    consistent = F.size(F.array_distinct(F.transform("slots", lambda x: x["i"]))) == F.size("slots")
    # words that are equal only as names count if nothing gives their value of the item another value of the document
    likely = F.filter(placed, lambda x: (x["i"]["w"] != x["d"]["w"]) & x["i"]["name"].isNotNull() & x["d"]["name"].isNotNull())
    likely = F.transform(likely, lambda x: F.struct(x["i"]["name"].alias("i"), x["d"]["name"].alias("d")))
    agreeing = F.filter("likely", lambda x: ~F.exists(F.concat("slots", "likely"), lambda y: (x["i"] == y["i"]) & (x["d"] != y["d"])))
    counted = both.select("doc_id", "item_id", "shift", F.size("i").alias("of"), F.size(same).alias("n"), slots.alias("slots"), likely.alias("likely")).where(consistent)
    counted = counted.withColumn("n", F.col("n") + F.size(agreeing))
    # a doc_id with several texts counts the best of them along each alignment
    counted = counted.groupBy("doc_id", "item_id", "shift").agg(F.max("n").alias("n"), F.max("of").alias("of"))
    total = counted.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_words"), F.max("of").alias("of"))
    return total.where(F.col("n_words") >= share * F.col("of")).select("doc_id", "item_id", F.col("n_words").cast("long"), F.least(F.lit(1.0), F.col("n_words") / F.col("of")).alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the documents that contain an item of the benchmark."""
    hit = contaminated_pairs(docs, benchmark, **how).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"] == hit["_hit"], "left_anti")
