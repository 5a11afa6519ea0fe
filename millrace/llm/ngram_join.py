"""Exact Jaccard join of documents on word n-grams, as a blocked sparse product.

Documents by n-grams form a sparse incidence matrix. Copies (equal n-gram sets) are one class and
one row of it. For a link at `percent`, two sets of sizes x and y must share
ceil(percent * (x + y) / (100 + percent)) n-grams, so the first x - ceil(percent * x / 100) + 1
n-grams of each set, in one order for all sets that puts frequent n-grams last, must meet: only that
part of the matrix is multiplied. Entries of a column meet on its n-gram; pairs whose sizes or
places in the order rule out enough overlap are discarded, then those whose fingerprints do, and the
overlap of the rest is counted.

Only components are asked for, so the product is taken in blocks of rows: each column is multiplied
with a few of its rows, links merge components, and columns whose rows are all in one component are
done. Columns with no more rows than the block are multiplied out; of the others the rows of the
block leave, and the next block is GROWTH times as large. Every pair of a column is thus compared or
known to be connected, whatever the size of the column.

Passes over the texts hash their n-grams: the first counts, in hashed counters of fixed number, the
n-grams that a task meets more than once; the second finds the columns that two classes share; the
third makes the entries of these; and one for each block makes the sets of the pairs to be compared.
The maps by which a pass picks columns or classes have a fixed size; joins make the choice exact.
N-grams are 64-bit hashes. A text with fewer than `width` words is one n-gram of all its
words; null, empty or blank texts have no n-grams and no links. Repeated rows are copies of each
other; rows with a null id link others but never name a component. Other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship, stash
from .common import arrow_schema
from .components import components
from .shingles import Shingler, lists, set_keys

WIDTH, PERCENT = 5, 80
#: Counters of repeated n-grams, and bits of the map that tells which n-grams are shared: fixed sizes, whatever the input.
COUNTERS, MAP_BITS = 1 << 22, 1 << 25
#: N-grams that a task gathers before it counts the repeated ones.
COUNTED_AT_ONCE = 1 << 22
#: Numbers in one row when a table of fixed size is gathered.
CHUNK = 1 << 12
#: The least and the most 64-bit words of a set's fingerprint; between them it has two to four bits for each n-gram.
LEAST_WORDS, MOST_WORDS = 4, 512
#: Each block has so many times as many rows as the one before, which has one.
GROWTH = 32
#: Tables of up to so many rows (at most 64 bytes each) are broadcast to spare the other side a shuffle; larger ones are joined.
BROADCAST_ROWS = 300_000
#: Classes a task remembers in order to write their entries once.
SEEN_CLASSES = 200_000


def place(grams: np.ndarray, size: int) -> np.ndarray:
    return (grams >> np.uint64(65 - size.bit_length())).astype(np.int64)


def long_columns(*names: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in names])


def sets_of(docs: DataFrame, width: int, schema: T.StructType, start) -> DataFrame:
    """Maps docs in Arrow batches; start() gives, for each task, the function that takes the batch and the
    slices' (sets, sizes) and yields lists of arrays, one for each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, shingler, work = arrow_schema(schema), Shingler(width), start()
        for batch in batches:
            for columns in work(batch, shingler.sets(batch.column(batch.num_columns - 1))):
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)
        for columns in work(None, ()):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    return docs.mapInArrow(run, schema)


def profile(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n) of each document, and in other rows (at, count): the task's counts of repeated n-grams."""

    def start():
        held: list[np.ndarray] = []

        def repeated() -> Iterator[list]:
            grams = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            held.clear()
            same = np.flatnonzero(grams[1:] == grams[:-1])
            at, more = np.unique(place(grams[same], COUNTERS), return_counts=True)
            none = pa.nulls(len(at), pa.int64())
            yield [none, none, none, at, more]

        def work(batch: pa.RecordBatch | None, slices) -> Iterator[list]:
            if batch is None:
                yield from repeated()
                return
            keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for grams, n in slices:
                keys.append(set_keys(grams, n))
                sizes.append(n)
                held.append(grams)
                if sum(map(len, held)) >= COUNTED_AT_ONCE:
                    yield from repeated()
            none = pa.nulls(batch.num_rows, pa.int64())
            yield [batch.column(0), np.concatenate(keys), np.concatenate(sizes), none, none]

        return work

    return sets_of(docs, width, long_columns("doc_id", "key", "n", "at", "count"), start)


def gathered(rows: DataFrame, size: int, kind: type) -> np.ndarray:
    """The table of `size` numbers that rows (at, value) give, the rest 0. Rows are packed by stretches of CHUNK places first."""

    def pack(part: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK, kind)
        out[part["at"].to_numpy() % CHUNK] = part["value"].to_numpy().astype(kind)
        return pa.table({"chunk": part["chunk"].slice(0, 1), "part": pa.array([out.tobytes()], pa.binary())})

    got = rows.withColumn("chunk", F.floor(F.col("at") / CHUNK)).groupBy("chunk").applyInArrow(pack, "chunk long, part binary").toArrow()
    out = np.zeros((size // CHUNK, CHUNK), kind)
    for i, part in zip(got["chunk"].to_pylist(), got["part"], strict=True):
        out[i] = np.frombuffer(part.as_py(), kind)
    return out.ravel()


def bit_map(numbers: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits, in words of 32, with the bit of each of the numbers; false hits are harmless."""
    bit = F.shiftrightunsigned(F.col(numbers.columns[0]), 65 - MAP_BITS.bit_length())
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))
    words = numbers.select(F.shiftright(bit, 5).alias("at"), one.alias("one")).groupBy("at").agg(F.bit_or("one").alias("value"))
    return gathered(words, MAP_BITS // 32, np.uint32)


def levels_of(profiles: DataFrame) -> np.ndarray:
    """For each counter how frequent its n-grams are, on a scale of logarithms."""
    sums = profiles.where("at is not null").groupBy("at").agg(F.sum("count").alias("count"))
    return gathered(sums.select("at", F.least(F.lit(255), (F.log2(F.col("count") + 1) * 8)).cast("int").alias("value")), COUNTERS, np.uint8)


def in_order(grams: np.ndarray, sizes: np.ndarray, levels: np.ndarray) -> Iterator[np.ndarray]:
    """Each set in the order of all n-grams: by level, then by hash."""
    level, at = levels[place(grams, COUNTERS)], 0
    for n in sizes.tolist():
        yield grams[at : at + n][np.argsort(level[at : at + n], kind="stable")]
        at += n


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def new_classes(keys: np.ndarray, sizes: np.ndarray, seen: set) -> list[int]:
    """Places of classes that are not empty and that the task has not met (or not remembered)."""
    out = []
    for i, (key, n) in enumerate(zip(keys.tolist(), sizes.tolist(), strict=True)):
        if n and key not in seen:
            out.append(i)
            if len(seen) < SEEN_CLASSES:
                seen.add(key)
    return out


def shared_columns(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> np.ndarray:
    """A map with the bit of each n-gram that prefixes of two classes have."""

    def start():
        seen: set = set()

        def work(batch: pa.RecordBatch | None, slices) -> Iterator[list]:
            for grams, sizes in slices:
                keys = set_keys(grams, sizes)
                mine, sets = new_classes(keys, sizes, seen), list(in_order(grams, sizes, levels))
                if mine:
                    parts = [sets[i][: prefix_length(len(sets[i]), percent)] for i in mine]
                    yield [np.concatenate(parts).view(np.int64), np.repeat(keys[mine], list(map(len, parts)))]

        return work

    entries = sets_of(docs.select("text"), width, long_columns("gram", "key"), start)
    return bit_map(entries.groupBy("gram").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("gram"))


def marked(numbers: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = place(numbers, MAP_BITS)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def shared_entries(docs: DataFrame, width: int, percent: int, levels: np.ndarray, shared: np.ndarray) -> DataFrame:
    """(gram, key, n, pos): the entries of prefixes in shared columns, by their place in the order; and in other rows
    (key, map) the fingerprint of each class that has such entries."""
    schema = T.StructType([*long_columns("gram", "key", "n", "pos"), T.StructField("map", T.ArrayType(T.LongType(), False))])
    kind = pa.list_(pa.field("element", pa.int64(), False))

    def start():
        seen: set = set()

        def work(batch: pa.RecordBatch | None, slices) -> Iterator[list]:
            for grams, sizes in slices:
                keys = set_keys(grams, sizes)
                mine, sets = new_classes(keys, sizes, seen), list(in_order(grams, sizes, levels))
                if mine:
                    parts = [sets[i][: prefix_length(len(sets[i]), percent)] for i in mine]
                    flat, lengths = np.concatenate(parts), np.array(list(map(len, parts)))
                    hit = np.flatnonzero(marked(flat, shared))
                    row = np.repeat(np.arange(len(mine)), lengths)[hit]
                    pos = hit - (np.cumsum(lengths) - lengths)[row]
                    yield [flat[hit].view(np.int64), keys[mine][row], sizes[mine][row], pos, pa.nulls(len(hit), kind)]
                    met = np.array(mine)[np.unique(row)]
                    none = pa.nulls(len(met), pa.int64())
                    maps = fingerprints(np.concatenate([sets[i] for i in met]), sizes[met]) if len(met) else (np.zeros(0, np.int64),) * 2
                    yield [none, keys[met], none, none, lists(*maps, kind)]

        return work

    return sets_of(docs.select("text"), width, schema, start)


def fingerprints(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets' fingerprints, one behind the other, with a bit for each n-gram; and how many 64-bit words each has, a power of two."""
    words = np.clip(1 << np.ceil(np.log2(sizes / 32)).clip(0).astype(np.int64), LEAST_WORDS, MOST_WORDS)
    bits = np.zeros(64 * words.sum(), np.uint8)
    begins = 64 * (np.cumsum(words) - words)
    bits[np.repeat(begins, sizes) + (grams >> np.uint64(11)).astype(np.int64) % np.repeat(64 * words, sizes)] = 1
    return np.packbits(bits).view(np.int64), words


def whole_sets(docs: DataFrame, width: int, wanted: np.ndarray) -> DataFrame:
    """(key, grams): the sets of the classes whose bit is set, once a task."""
    kind = pa.list_(pa.field("element", pa.int64(), False))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType(), False))])

    def start():
        seen: set = set()

        def work(batch: pa.RecordBatch | None, slices) -> Iterator[list]:
            for grams, sizes in slices:
                keys, bounds = set_keys(grams, sizes), np.concatenate(([0], np.cumsum(sizes)))
                near = np.where(marked(keys.view(np.uint64), wanted), sizes, 0)
                mine = new_classes(keys, near, seen)
                if mine:
                    flat = np.concatenate([grams[bounds[i] : bounds[i + 1]] for i in mine]).view(np.int64)
                    yield [keys[mine], lists(flat, sizes[mine], kind)]

        return work

    return sets_of(docs.select("text"), width, schema, start)


def needed(percent: int, x: Column, y: Column) -> Column:
    """The least overlap of linked sets of sizes x and y."""
    return F.ceil(F.lit(percent) * (x + y) / F.lit(100.0 + percent) - F.lit(1e-9))


def possible(percent: int) -> Column:
    """Whether a pair (n, pos, n2, pos2) can reach the overlap it needs if this column is the first it
    shares. A linked pair passes in its first column, so no pair need be made in a later one."""
    n, m, i, j = F.col("n"), F.col("n2"), F.col("pos"), F.col("pos2")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - i, m - j) >= needed(percent, n, m))


def central(percent: int) -> Column:
    """Whether an entry may pair with a set of its own size or larger. Two entries that may not can never pair."""
    return (F.col("n") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("n")


def first_row(percent: int) -> Column:
    """Of the rows of a group the one with the fewest rarer n-grams: what links with any of them links with it first."""
    row = F.struct("pos", "key", "n", "label")
    return F.min(F.when(central(percent), row)).alias("p")


def product(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n, n2), a < b, that the size-derived bounds leave, of rows and the rows p they meet, in different components."""
    rows = rows.where("key != p.key and label != p.label")
    swap = F.col("key") > F.col("p.key")
    sides = [F.when(swap, F.col(f"p.{c}")).otherwise(F.col(c)).alias(o) for c, o in (("key", "a"), ("n", "n"), ("pos", "pos"))]
    sides += [F.when(swap, F.col(c)).otherwise(F.col(f"p.{c}")).alias(o) for c, o in (("key", "b"), ("n", "n2"), ("pos", "pos2"))]
    return rows.select(*sides).where(possible(percent)).select("a", "b", "n", "n2").distinct()


def folded(x: Column, k: Column) -> Column:
    """The fingerprint x as it is with only k words."""
    parts = F.sequence(F.lit(1), (F.size(x) / k).cast("int") - 1)
    either = F.aggregate(parts, F.slice(x, 1, k), lambda s, i: F.zip_with(s, F.slice(x, i * k + 1, k), lambda v, w: v.bitwiseOR(w)))
    return F.when(F.size(x) > k, either).otherwise(x)


def likely(pairs: DataFrame, n_pairs: int, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap can be large enough by their fingerprints: each bit that only one of two sets has is an n-gram the other lacks."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    maps = maps.join(F.broadcast(keys) if n_pairs <= BROADCAST_ROWS else keys, "key", "left_semi").dropDuplicates(["key"])
    both = maps.select(F.col("key").alias("a"), F.col("map").alias("x")).join(small(pairs, n_pairs), "a").join(maps.select(F.col("key").alias("b"), F.col("map").alias("y")), "b")
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseAND(F.bitwise_not(w)))), F.lit(0), lambda s, v: s + v)
    k = F.least(F.size("x"), F.size("y"))
    both = both.select("a", "b", "n", "n2", folded(F.col("x"), k).alias("x"), folded(F.col("y"), k).alias("y"))
    most = F.least(F.col("n") - only("x", "y"), F.col("n2") - only("y", "x"))
    return both.where(most >= needed(percent, F.col("n"), F.col("n2"))).select("a", "b", "n", "n2")


def linked(pairs: DataFrame, n_pairs: int, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap, counted in full, is large enough. The texts are read again for the
    sets of these classes: to keep all sets would take more room than the texts."""
    wanted = bit_map(pairs.select(F.explode(F.array("a", "b")).alias("key")))
    sets = whole_sets(docs, width, wanted).dropDuplicates(["key"])
    both = sets.select(F.col("key").alias("a"), F.col("grams").alias("x")).join(small(pairs, n_pairs), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")
    return both.where(F.size(F.array_intersect("x", "y")) >= needed(percent, F.col("n"), F.col("n2"))).select("a", "b")


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A materialised table, to be broadcast if its size, counted up to the bound, allows it."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def counted(df: DataFrame, keep=cut, condition: Column | None = None) -> tuple[DataFrame, int]:
    """df, materialised, and how many of its rows meet the condition."""
    seen = Observation()
    one = F.lit(1) if condition is None else F.when(condition, 1)
    out = keep(df.observe(seen, F.count(one).alias("n")))
    return out, seen.get["n"]


def link_components(docs: DataFrame, profiles: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, label) of the classes that have a link; None if there is none."""
    levels = levels_of(profiles)
    made = stash(shared_entries(docs, width, percent, levels, shared_columns(docs, width, percent, levels)))
    maps = made.where("map is not null").select("key", "map")
    entries, labels, block = made.where("gram is not null").drop("map").withColumn("label", F.col("key")), None, 1
    while True:
        if labels is not None:
            found = labels.select(F.col("node").alias("key"), F.col("label").alias("_l"))
            entries = stash(entries.drop("label").join(small(found), "key", "left").withColumn("label", F.coalesce("_l", "key")).drop("_l"))
        # A task writes a class once; copies that other tasks wrote meet here, and change nothing but the number of members.
        columns = entries.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"), first_row(percent))
        columns = columns.where("p is not null and lo < hi").select("gram", (F.col("members") <= block).alias("small"), "p")
        # at first most columns are open; later only a few
        columns = columns if block == 1 else small(cut(columns.drop("p")))
        entries, large = counted(entries.join(columns, "gram"), stash, ~F.col("small"))
        if block == 1:
            rows, left = entries, entries.where(~F.col("small") & (F.col("key") != F.col("p.key"))).drop("small", "p").distinct()
        else:
            # All rows of a small column meet; of another, one for each slot.
            slot = F.when(F.col("small"), F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(block))).alias("slot")
            met = cut(entries.groupBy("gram", slot, "small").agg(first_row(percent)).where("p is not null"))
            rows = entries.join(small(met.select("gram", "p")), "gram")
            used = met.where(~F.col("small")).select("gram", F.col("p.key").alias("key"))
            left = entries.where(~F.col("small")).drop("small").join(used, ["gram", "key"], "left_anti")
        # Pairs that share a few n-grams by chance grow faster than the input: their sets are not fetched.
        pairs, n_pairs = counted(product(rows, percent))
        pairs, n_pairs = counted(likely(pairs, n_pairs, maps, percent)) if n_pairs else (pairs, 0)
        edges, n_edges = counted(linked(pairs, n_pairs, docs, width, percent)) if n_pairs else (None, 0)
        if n_edges:
            labels = components(edges if labels is None else edges.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
        if not large:
            return labels
        # Small columns are done; of the others the rows that all have met leave.
        entries, block = left, block * GROWTH
        if labels is None:
            entries = stash(entries)


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document (doc_id, n_shingles, component_id): the size of its set, and the smallest doc_id it is linked with, directly or not."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    profiles = stash(profile(docs, width))
    labels = link_components(docs, profiles, width, percent)
    each = profiles.where("n is not null").select("doc_id", "key", "n")
    classes = each.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    if labels is not None:
        label = F.coalesce("label", "key")
        classes = classes.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").select("key", label.alias("label"), "least")
        least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
        classes = classes.select("key", "label").join(least, "label").select("key", "component_id")
    else:
        classes = classes.select("key", F.col("least").alias("component_id"))
    found = each.join(cut(classes), "key", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
