"""Phrase collocations by top-order marginalisation: only the longest windows are counted, a ROLLUP sums the rest.

Every word begins one window: itself and, in lead columns, the words behind it in its piece, padded with nulls where
the piece ends. The counts of these windows hold those of all shorter phrases: a phrase occurs as often as windows
begin with it, so ROLLUP(w1, w2, ..) sums them from the longest to the single words and the number of words.

A phrase that matters occurs `least` times, and so does each phrase in it. A first pass counts the pairs of words by
their hashes; the windows are padded from the first pair on that is too rare, which makes most of them short and
equal, and a counted window that is too rare is padded by one more before the ROLLUP. Neither changes a count of
`least` or more: the hashes only rule out pairs that are surely rare, and what is counted are the words themselves.

The words of a slice of texts are cut, coded and counted together in Arrow and NumPy; Spark shuffles what is
left, partly summed. Counts grow with the texts and none goes to the driver; tasks get a bit map of bounded size.

Null texts count as empty, a null lang as `und`; texts without words give nothing; repeated rows count again; other
columns are ignored; an empty table gives an empty table. Equal scores go by count, then by the phrase's bytes.
Scores are exact for counts below 10^16.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stash
from .bits import BitMap, bit_map
from .shingles import M1, mixed

SHORTEST, LONGEST, LEAST, SHARE, FIRST = 2, 3, 10, 50, 2000
SCALE = 1_000_000
#: Texts of a slice together have about so many bytes; a longer text is cut where a piece ends.
SLICE_BYTES = 4 << 20
#: Single words stand in many phrases: each is dealt to so many partitions when it is looked up.
SALTS = 8
#: The first phrases of a language are picked in so many parts, then from their winners.
PARTS = 16

#: What ends a piece, and what parts words.
BREAKS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"

LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
IS_BREAK, IS_BLANK = np.zeros(256, bool), np.zeros(256, bool)
IS_BREAK[list(BREAKS.encode())] = True
IS_BLANK[list(BLANKS.encode())] = True


def stretches(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text behind the last, first byte, byte behind the last) of slices; ends: where each text begins, and the last ends."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        begin, end = int(ends[at]), int(ends[to])
        while end - begin > SLICE_BYTES:
            cut, step = begin + SLICE_BYTES, SLICE_BYTES
            while cut < end:
                hits = np.flatnonzero(IS_BREAK[data[cut : min(end, cut + step)]])
                if len(hits):
                    cut += int(hits[0])
                    break
                cut += step
            if cut >= end:
                break
            yield at, to, begin, cut
            begin = cut
        yield at, to, begin, end
        at = to


class Windows:
    """The windows of a slice: dictionary of words, code of each window's words (-1: padded), and each one's text."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, longest: int) -> None:
        """begins: where the slice's texts begin in data."""
        breaks, blank = IS_BREAK[data], IS_BLANK[data]
        inside = ~(breaks | blank)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = begins[(begins > 0) & (begins < len(data))]
        first[edge] |= inside[edge]
        last[edge - 1] |= inside[edge - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOW[data[inside]])])
        coded = words.dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.text = np.searchsorted(begins, starts, "right") - 1
        piece = np.searchsorted(np.flatnonzero(breaks), starts) + self.text
        self.codes = [codes]
        for ahead in range(1, longest):
            lead = np.full(len(codes), -1, np.int64)
            lead[:-ahead] = np.where(piece[ahead:] == piece[:-ahead], codes[ahead:], -1)
            self.codes.append(lead)


def slices_of(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[pa.Array, np.ndarray, Windows]]:
    """For each slice the languages, the language of each of its texts as a code, and its windows. The batch: lang, text."""
    texts = pc.fill_null(batch.column(1), "").cast(pa.large_string()).cast(pa.large_binary())
    coded = pc.fill_null(batch.column(0), "und").dictionary_encode()
    langs, lang = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if not len(texts):
        return
    _, offsets, values = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    for at, to, begin, end in stretches(data, ends):
        if end > begin:
            yield langs, lang[at:to], Windows(data[begin:end], np.maximum(ends[at:to] - begin, 0), longest)


def pair_hashes(w: Windows, langs: pa.Array, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of lang and the first two words of each window, and which windows have two."""
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in w.words.to_pylist()] or [0], np.uint64)
    h_lang = np.array([xxhash.xxh3_64_intdigest(x) for x in langs.to_pylist()], np.uint64)
    one, two = w.codes[:2]
    return mixed(mixed(h[one] * M1 + h_lang[lang[w.text]]) * M1 + h[two]), two >= 0


def frequent_pairs(docs: DataFrame, least: int) -> BitMap:
    """A map that has all pairs of words of a language that occur at least so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, lang, w in slices_of(batch, 2):
                hashes, whole = pair_hashes(w, langs, lang)
                h, n = np.unique(hashes[whole].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    frequent = stash(counted.where(F.col("n") >= least).select("h"))
    return bit_map(frequent, frequent.count())


def unique_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of one of each of the distinct rows, and how many there are of it. Numbers are -1 or more."""
    key = np.zeros(len(columns[0]), np.int64)
    bound = 1
    for c in columns:
        size = int(c.max(initial=0)) + 2
        if bound * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            bound = int(key.max(initial=0)) + 1
        key, bound = key * size + c + 1, bound * size
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return at, n


def window_counts(docs: DataFrame, frequent: BitMap, longest: int) -> DataFrame:
    """(lang, w1 .. , n): counts of windows, padded where the text or a frequent pair ends."""
    names = [f"w{i + 1}" for i in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, lang, w in slices_of(batch, longest):
                hashes, whole = pair_hashes(w, langs, lang)
                go_on = whole & frequent.has(hashes)
                kept, upto = [w.codes[0]], np.ones(len(go_on), bool)
                for ahead in range(1, longest):
                    here = np.zeros(len(go_on), bool)
                    here[: len(go_on) - ahead + 1] = go_on[ahead - 1 :]
                    upto &= here
                    kept.append(np.where(upto, w.codes[ahead], -1))
                at, n = unique_rows([lang[w.text], *kept])
                words = w.words.cast(pa.large_string()).cast(pa.string())
                columns = [words.take(pa.array(c[at], mask=c[at] < 0)) for c in kept]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[w.text][at])).cast(pa.string()), *columns, pa.array(n)], ["lang", *names, "n"])

    made = docs.select("lang", "text").mapInArrow(run, f"lang string, {', '.join(f'{c} string' for c in names)}, n long")
    return made.groupBy("lang", *names).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, f): how often each phrase of up to `longest` words occurs, if at least so often; and without words, how
    many words a language has. lang and text may be of any text type."""
    names = [f"w{i + 1}" for i in range(longest)]
    docs = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    wide = window_counts(docs, frequent_pairs(docs, least), longest)
    # what is too rare cannot matter: the window is padded by one more
    wide = wide.withColumn(names[-1], F.when(F.col("n") >= least, F.col(names[-1]))) if longest > 1 else wide
    rolled = docs.sparkSession.sql(f"SELECT lang, {', '.join(names)}, grouping_id() AS g, sum(n) AS f FROM {{wide}} GROUP BY lang, ROLLUP({', '.join(names)})", wide=wide)
    # of w1 .. all but the last bits of g are there; a row whose last word is padded is no phrase
    words, real = F.array().cast("array<string>"), F.col("g") == 2**longest - 1
    for size in range(1, longest + 1):
        here = F.col("g") == 2 ** (longest - size) - 1
        words = F.when(here, F.array(*names[:size])).otherwise(words)
        real = real | (here & F.col(names[size - 1]).isNotNull() & (F.col("f") >= least))
    return rolled.where(real).select("lang", words.alias("words"), "f")


def joined(words) -> F.Column:
    return F.array_join(words, " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of each phrase of two words or more: its lowest-scoring cut, the first of equals."""
    salt = lambda size, phrase: F.when(size == 1, F.pmod(F.xxhash64(phrase), F.lit(SALTS)).cast("int")).otherwise(0)
    size = F.size("words")
    cuts = counts.where(size >= SHORTEST).select("lang", "words", joined(F.col("words")).alias("phrase"), F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    left, right = F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))
    cuts = cuts.withColumns({"left": joined(left), "right": joined(right), "left_salt": salt(F.size(left), F.col("phrase")), "right_salt": salt(F.size(right), F.col("phrase"))})
    known = counts.where(size >= 1).select("lang", joined(F.col("words")).alias("part"), "f", F.explode(F.sequence(F.lit(0), F.when(size == 1, SALTS - 1).otherwise(0))).alias("salt"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("part").alias(side), F.col("salt").alias(f"{side}_salt"), F.col("f").alias(name)), ["lang", side, f"{side}_salt"])
    exact = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7, 0)) * ({exact('a')} * {exact('a')})) div ({exact('l')} * {exact('r')})")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("words").alias("words"), F.first("a").alias("a"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `first` phrases of each language by score. Phrases that a longer one of at
    least `share` percent of their occurrences holds are left out."""
    ship(docs.sparkSession)
    counts = stash(phrase_counts(docs, longest, least))
    size = F.size("words")
    # a phrase within one that is longer by more is also within one that is longer by a word, which is as frequent
    ends = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    inside = counts.where(size > SHORTEST).select("lang", F.explode(ends).alias("words"), "f").groupBy("lang", joined(F.col("words")).alias("phrase")).agg(F.max("f").alias("longer"))
    found = scored(counts).join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    rows = found.select("lang", "phrase", "a", "l", "r", "score", part)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    total = counts.where(size == 0).select("lang", F.col("f").alias("n"))
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
