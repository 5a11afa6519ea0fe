"""Fill-in-middle transformation of texts, as a pipeline of pyarrow.compute over each batch.

A text is cut into units, blanks and the word behind them; two cut points, drawn from a digest of the
document's id, part the units into prefix, middle and suffix, and the pieces change places under
sentinels (PSM or SPM), or the text stays plain. A batch is never looped over row by row: the units
become list arrays, which are flattened with the index of their row; a unit's ordinal and its row's cut
points give its role; the units of a role are filtered, made lists again and joined.

Units are cut in bytes, where the byte 0xFF, which UTF-8 never has, marks their ends; blanks are ASCII,
so code points stay whole. Everything is 64-bit, so one long text cannot pass an offset.

A null text counts as empty; a null id draws from the digest of the seed alone. Empty texts and texts
that hold a sentinel stay plain, whatever is drawn. Repeated rows give equal results; other columns are
ignored; an empty table gives an empty table. fill_middle() keeps the texts; restored() rebuilds a text
from output and form in built-in functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import arrow_schema

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Blanks and the word behind them; blanks at the end of a text are a unit of their own.
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
END = b"\xff"
#: Bytes of text that are cut at once, or one text if it is longer.
SLICE_BYTES = 4 << 20

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
)


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits, drawn from a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of SLICE_BYTES at most, or of one row."""
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and held + n > SLICE_BYTES:
            yield begin, i
            begin, held = i, 0
        held += n
    if len(sizes) > begin:
        yield begin, len(sizes)


def starts(counts: pa.Array) -> pa.Array:
    """Where lists of so many elements begin, one behind the other, and where the last ends."""
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)])


def transformed(doc_id: pa.Array, text: pa.Array, draws: list[pa.Array], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """The columns of SCHEMA for some rows."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    marked = pc.replace_substring_regex(text.cast(pa.large_binary()), pattern=UNIT, replacement=rb"\1" + END)
    cut = pc.split_pattern(marked, pattern=END)
    # behind the last mark there is one empty unit more
    n = pc.subtract(pc.list_value_length(cut).cast(pa.int64()), 1)
    h1, h2, h3, h4 = (x.to_numpy(zero_copy_only=False) for x in draws)
    points = pc.add(n, 1).to_numpy(zero_copy_only=False)
    first, second = pa.array(np.minimum(h1 % points, h2 % points)), pa.array(np.maximum(h1 % points, h2 % points))
    sentinel = pc.match_substring_regex(text, "|".join((PREFIX, SUFFIX, MIDDLE)))
    plain = pc.or_(pc.or_(pc.equal(n, 0), sentinel), pa.array(h3 % 100 >= fim_percent))

    flat, row = pc.list_flatten(cut), pc.list_parent_indices(cut)
    begins = starts(pc.add(n, 1)).slice(0, len(n))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(begins, row))
    role = pc.add(pc.greater_equal(ordinal, pc.take(first, row)).cast(pa.int64()), pc.greater_equal(ordinal, pc.take(second, row)).cast(pa.int64()))
    counts, pieces = (first, pc.subtract(second, first), pc.add(pc.subtract(n, second), 1)), []
    for which, count in enumerate(counts):
        units = pc.filter(flat, pc.equal(role, which))
        lists = pa.LargeListArray.from_arrays(starts(count), units)
        pieces.append(pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).cast(pa.large_string()))
    prefix, middle, suffix = pieces
    none = pa.scalar("", pa.large_string())
    psm = pc.binary_join_element_wise(pa.scalar(PREFIX, pa.large_string()), prefix, pa.scalar(SUFFIX, pa.large_string()), suffix, pa.scalar(MIDDLE, pa.large_string()), middle, none)
    spm = pc.binary_join_element_wise(pa.scalar(SUFFIX, pa.large_string()), suffix, pa.scalar(PREFIX, pa.large_string()), prefix, pa.scalar(MIDDLE, pa.large_string()), middle, none)
    backward = pa.array(h4 % 100 < spm_percent)
    form = pc.if_else(plain, "plain", pc.if_else(backward, "spm", "psm"))
    output = pc.if_else(plain, text, pc.if_else(backward, spm, psm))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [doc_id, n, form, *chars, output]


def fill_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row: its units, plain, psm or spm, the code points of
    prefix and middle (null if plain), and the whole transformed text."""
    kinds = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for begin, end in slices(sizes):
                part = batch.slice(begin, end - begin)
                made = transformed(part.column(0), part.column(1), part.columns[2:], fim_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([x.cast(k.type) for x, k in zip(made, kinds, strict=True)], schema=kinds)

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.select("doc_id", "text", *drawn(F.col("doc_id"), seed)).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No text with sentinels was taken apart, so there are just three of them."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    a, b, c = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(b, c, a)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """Per document its units and pieces, and digests of the transformed and of the restored text."""
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )
