"""Near duplicates among embeddings: cells by spherical k-means, blocked cosine products within cells.

Equal vectors are collapsed first and counted with their number. Spherical k-means, fitted on a sample of at
most SAMPLE distinct vectors, gives each vector its home, the cell whose centroid has the highest cosine.
Two linked vectors may have different homes: the planes between the cells then part them, and one of the two
lies within half the angle of the threshold of that plane. So each vector also visits every other cell whose
plane is that near, and a product of the visitors and the residents of each cell meets every linked pair:
nothing is lost to the cells. Where vectors lie in groups few visits are needed; where they are spread evenly
in many dimensions most cells are visited, and the work comes close to that of all pairs.

Residents within half the angle of their centroid, the core of a cell, are all linked with each other. They are
counted, not compared, so a large group of near copies costs no square of its size. Other residents visit their
own cell. Cells are packed into bins of bounded size, and larger ones are dealt to several; the visitors of a bin
are dealt to blocks of bounded size, each of which meets the whole bin. A task returns for each vector the number
of its links and one edge to the least of its group, so no list of all pairs is ever made. The cells that a vector
visits are a bit for each cell, and copies are handed on a few at a time: a task takes as much memory however many
cells, bins and vectors there are. Products are taken in single precision, and what comes near the threshold again
in double precision.

Vectors that are null, empty or zero or hold null or non-finite components link with nothing and stay. Vectors
of different lengths are never linked. Repeated rows are copies, linked with each other. Rows with a null id count
as links but never name a component; a group without any id has a null component and keeps its rows. Labels and
other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stash
from .components import components

THRESHOLD = 0.9
#: Distinct vectors that the cells are fitted on, at most, and how often the centroids move.
SAMPLE, ROUNDS = 16384, 8
#: At most so many cells, whose centroids every task gets.
MOST_CELLS = 4096
#: Rows of a bin and visitors of a block; small tables have at least so many bins, to spread too.
BIN_ROWS, BLOCK_ROWS, LEAST_BINS = 32768, 65536, 24
#: Visitors that are multiplied at once, and how close to the threshold a cosine is summed again, exactly.
AT_ONCE, CLOSE = 1024, 1e-11
#: Copies of rows that are handed on at once, and cosines that are taken at once, at most.
COPIES_AT_ONCE, COSINES_AT_ONCE = 4096, 1 << 23


def normed(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component goes first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray, kind: str | None = "float64") -> np.ndarray:
    """The vectors as rows; of their own kind of number if kind is None."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat if kind is None else flat.astype(kind)).reshape(len(column), -1)


def bit_rows(mask: np.ndarray) -> pa.Array:
    """Each row of a mask as bytes, a bit for each column."""
    bits = np.packbits(mask, axis=1, bitorder="little")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())


def bits_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The bytes of bit_rows, a row for each value; all are of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine from sums without rounding on the way, the same in either order."""
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def fit_cells(sample: np.ndarray, cells: int, least: float, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of up to so many cells by spherical k-means. The first ones are no closer than the threshold, and those
    that come closer are merged: a dense group is not divided among several cells, so that it can be the core of one."""
    chosen = sample[:1]
    for x in sample[1:]:
        if len(chosen) == cells:
            break
        if (chosen @ x).max() < least:
            chosen = np.vstack([chosen, x])
    for _ in range(rounds):
        home = (sample @ chosen.T).argmax(1)
        sums = np.zeros_like(chosen)
        np.add.at(sums, home, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        chosen = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), chosen)
    kept = chosen[:1]
    for x in chosen[1:]:
        if (kept @ x).max() < least:
            kept = np.vstack([kept, x])
    return kept


def assign(v: np.ndarray, centroids: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors of length 1: their home, whether they are in its core, and which other cells they visit, as a mask."""
    half = math.acos(least) / 2
    near = v @ centroids.T
    home = near.argmax(1)
    best = near[np.arange(len(v)), home]
    between = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    visits = best[:, None] - near <= math.sin(half) * between[home] + 1e-9
    visits[np.arange(len(v)), home] = False
    return home, best >= math.cos(half) + 1e-9, visits


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(key, dims, v, m): each vector once, with the number of its rows."""
    found = rows.where("key is not null").groupBy("key").agg(F.first("v").alias("v"), F.count("*").alias("m"))
    return found.select("key", F.size("v").alias("dims"), "v", "m")


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, key): the rows with a key of 128 bits of their vector, null where it takes no part. Zeros have no sign."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    takes_part = F.coalesce((F.size(e) > 0) & ~odd & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(takes_part, F.transform(e, lambda x: x + F.lit(0).cast("float"))).alias("v"))
    part = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col("v"))), 16, "0")
    return rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.concat(part(1), part(2))).alias("key"))


def fitted(distinct: DataFrame, least: float) -> dict[int, np.ndarray]:
    """For each length of vectors its centroids. The sample is a share by digest, the same for the same vectors."""
    out = {}
    for dims, n in ((r.dims, r.n) for r in distinct.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(64).collect()):
        cells = min(MOST_CELLS, max(1, math.isqrt(n) // 2))
        share = min(1.0, 0.9 * SAMPLE / n)
        drawn = distinct.where(F.col("dims") == dims).where(F.conv(F.right("key", F.lit(7)), 16, 10).cast("long") < share * 16**7)
        sample = drawn.select("key", "v").limit(SAMPLE).toArrow().sort_by("key")
        out[dims] = fit_cells(normed(matrix(sample["v"])), cells, least) if len(sample) else np.eye(1, dims)
    return out


def by_length(batch: pa.RecordBatch, rows: int | None = None) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a batch by the length of their vectors, so many at once."""
    table = pa.Table.from_batches([batch])
    for dims in sorted(set(table["dims"].to_pylist())):
        part = table.filter(pc.equal(table["dims"], dims)).combine_chunks()
        for at in range(0, len(part), rows or len(part)):
            yield dims, part.slice(at, rows)


def assigned(distinct: DataFrame, centroids: dict[int, np.ndarray], least: float) -> DataFrame:
    """distinct with home, core, and visits, a bit for each cell it must be compared in as a visitor. Lengths without centroids have one cell each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in by_length(batch, AT_ONCE):
                if dims in centroids:
                    home, core, mask = assign(normed(matrix(part["v"])), centroids[dims], least)
                    mask[np.flatnonzero(~core), home[~core]] = True
                else:
                    home, core, mask = np.zeros(len(part), int), np.zeros(len(part), bool), np.ones((len(part), 1), bool)
                made = part.append_column("home", pa.array(home, pa.int32())).append_column("core", pa.array(core)).append_column("visits", bit_rows(mask))
                yield from made.combine_chunks().to_batches()

    return distinct.mapInArrow(run, f"key string, dims int, v {dict(distinct.dtypes)['v']}, m long, home int, core boolean, visits binary")


def visitors_of(homes: DataFrame) -> DataFrame:
    """(dims, cell, visitors): counted within each task, then added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, part in by_length(batch, COPIES_AT_ONCE):
                n = np.unpackbits(bits_of(part["visits"]), axis=1, bitorder="little").sum(0, dtype=np.int64)
                counts[dims] = counts[dims] + n if dims in counts else n
        for dims, n in counts.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), dims), pa.int32()), pa.array(cell, pa.int32()), pa.array(n[cell])], ["dims", "cell", "visitors"])

    found = homes.select("dims", "visits").mapInArrow(run, "dims int, cell int, visitors long")
    return found.groupBy("dims", "cell").agg(F.sum("visitors").alias("visitors"))


class Plan:
    """Where the cells' residents and visitors meet: for each cell a bin, and how many parts and blocks it has."""

    def __init__(self, cells: list) -> None:
        """cells: rows (dims, cell, residents, visitors)."""
        total = sum(c.residents for c in cells)
        most = min(BIN_ROWS, max(1, -(-total // LEAST_BINS)))
        self.bins: dict[tuple[int, int], int] = {}
        self.parts: list[int] = []
        visitors: list[int] = []
        open_bin: dict[int, list[int]] = {}
        for c in sorted(cells, key=lambda c: (c.dims, c.cell)):
            held = open_bin.get(c.dims)
            if held is None or held[1] + c.residents > most:
                held = open_bin[c.dims] = [len(self.parts), 0]
                self.parts.append(1)
                visitors.append(0)
            self.bins[c.dims, c.cell] = held[0]
            held[1] += c.residents
            self.parts[held[0]] = -(-held[1] // most)
            visitors[held[0]] += c.visitors
        self.blocks = [max(1, -(-n // BLOCK_ROWS)) for n in visitors]


def dealt(rows: DataFrame, plan: Plan) -> DataFrame:
    """A copy of each row for every bin, part and block where it is a resident or a visitor; COPIES_AT_ONCE are handed on together."""
    homes: dict[int, list[tuple[int, int]]] = {}
    for (dims, cell), b in sorted(plan.bins.items()):
        homes.setdefault(dims, []).append((cell, b))
    # for each length its cells and their bins, which are in one order
    cells_of = {dims: np.array(some).T for dims, some in homes.items()}
    parts, blocks = np.array(plan.parts, np.int64), np.array(plan.blocks, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, some in by_length(batch, AT_ONCE):
                cells, bins = cells_of[dims]
                key = np.array([int(k[:15], 16) for k in some["key"].to_pylist()], np.int64)
                own = bins[np.searchsorted(cells, some["home"].to_numpy())]
                known, starts = np.unique(bins, return_index=True)
                mask = np.unpackbits(bits_of(some["visits"]), axis=1, bitorder="little")[:, cells]
                guest, to = np.nonzero(np.logical_or.reduceat(mask, starts, axis=1))
                to = known[to]
                # residents: once for each block of their bin; visitors: once for each part of each bin
                host = np.repeat(np.arange(len(some)), blocks[own])
                block = np.arange(len(host)) - np.repeat(np.cumsum(blocks[own]) - blocks[own], blocks[own])
                times = parts[to]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                guest, to = np.repeat(guest, times), np.repeat(to, times)
                at = np.concatenate((host, guest))
                role = np.arange(len(at)) < len(host)
                place = [np.concatenate(x) for x in ((own[host], to), (key[host] % parts[own[host]], part), (block, key[guest] % blocks[to]))]
                batch_of = some.to_batches()[0]
                for i in range(0, len(at), COPIES_AT_ONCE):
                    here = slice(i, i + COPIES_AT_ONCE)
                    extra = [pa.array(role[here]), *(pa.array(x[here], pa.int32()) for x in place)]
                    yield pa.RecordBatch.from_arrays([*batch_of.take(pa.array(at[here])).columns, *extra], [*batch.schema.names, "resident", "bin", "part", "block"])

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, resident boolean, bin int, part int, block int")


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels, each the least node known to be connected with a node, after the edges between a and b."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (labels[labels] != labels).any():
            labels = labels[labels]


def near_pairs(raw: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows left and right, those of pairs near the threshold or above it, by a mask of such pairs, and their cosines in double precision."""
    some_left, some_right = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    a, b = (normed(raw[rows].astype("float64")) for rows in (left[some_left], right[some_right]))
    if len(a) * len(b) <= 8 * (n := np.count_nonzero(near)):
        cosine = a @ b.T
        i, j = np.nonzero(cosine >= least - CLOSE)
        return left[some_left[i]], right[some_right[j]], cosine[i, j]
    i, j = (index[places] for index, places in zip((np.cumsum(near.any(1)) - 1, np.cumsum(near.any(0)) - 1), np.nonzero(near), strict=True))
    cosine = np.concatenate([np.einsum("ij,ij->i", a[i[at : at + COPIES_AT_ONCE]], b[j[at : at + COPIES_AT_ONCE]]) for at in range(0, n, COPIES_AT_ONCE)])
    kept = cosine >= least - CLOSE
    return left[some_left[i[kept]]], right[some_right[j[kept]]], cosine[kept]


def block_links(table: pa.Table, least: float) -> pa.Table:
    """(key, n, other): for each vector of a block that has links found here their number, and the least vector of its group."""
    resident = table["resident"].to_numpy()
    order = np.lexsort((table["key"].to_numpy(zero_copy_only=False), ~resident))
    table = table.take(pa.array(order)).combine_chunks()
    resident, count = resident[order], int(resident.sum())
    raw, m = matrix(table["v"], None), table["m"].to_numpy()
    home, core, bits = table["home"].to_numpy(), table["core"].to_numpy(), bits_of(table["visits"])
    v = np.empty(raw.shape, np.float32)
    for at in range(0, len(raw), AT_ONCE):
        v[at : at + AT_ONCE] = normed(raw[at : at + AT_ONCE].astype("float64"))
    names, node = np.unique(table["key"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    visits = lambda row, cell: (bits[row, cell >> 3] >> (cell & 7)) & 1 == 1
    # rounding of products in single precision, at most
    slack = (raw.shape[1] + 8) * 2.0**-23
    found, labels, touched = np.zeros(len(table), np.int64), np.arange(len(names)), np.zeros(len(names), bool)
    for c in np.unique(home[:count]):
        right = np.flatnonzero(home[:count] == c)
        left = count + np.flatnonzero(visits(slice(count, None), c))
        columns, step = np.ascontiguousarray(v[right].T), max(1, min(AT_ONCE, COSINES_AT_ONCE // len(right)))
        for at in range(0, len(left), step):
            mine = left[at : at + step]
            near = v[mine] @ columns >= least - slack
            if not near.any():
                continue
            x, y, near = near_pairs(raw, mine, right, near, least)
            linked = node[x] != node[y]
            for k in np.flatnonzero(linked & (near < least + CLOSE)):
                linked[k] = exact_cosine(raw[x[k]].astype("float64"), raw[y[k]].astype("float64")) >= least
            x, y = x[linked], y[linked]
            if not len(x):
                continue
            touched[node[x]] = touched[node[y]] = True
            labels = merge(labels, node[x], node[y])
            # a pair that meets in both its homes counts in the lower cell; two residents outside the core visit each other
            stranger = home[x] != c
            counts = ~stranger | ~visits(y, home[x]) | (c < home[x])
            both = np.where(stranger, counts, core[y])
            np.add.at(found, x[counts], m[y[counts]])
            np.add.at(found, y[both], m[x[both]])
    per_node = np.zeros(len(names), np.int64)
    np.add.at(per_node, node, found)
    hit = np.flatnonzero(touched)
    return pa.table({"key": pa.array(names[hit].tolist(), pa.string()), "n": pa.array(per_node[hit]), "other": pa.array(names[labels[hit]].tolist(), pa.string())})


def near_duplicates(vectors: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): per row the other rows it is linked with directly, the smallest vec_id it is
    linked with, directly or not, and whether it stands for its group. The cosine of linked rows is `least` or more."""
    ship(vectors.sparkSession)
    rows = keyed(vectors)
    distinct = stash(distinct_vectors(rows))
    homes = stash(assigned(distinct, fitted(distinct, least), least))
    core = F.when(F.col("core"), F.col("m"))
    residents = homes.groupBy("dims", F.col("home").alias("cell")).agg(F.count("*").alias("residents"), F.sum(core).alias("core"), F.min(F.when(F.col("core"), F.col("key"))).alias("pivot"))
    # at most MOST_CELLS rows for each length of vectors
    cells = stash(residents.join(visitors_of(homes), ["dims", "cell"], "left").na.fill(0, ["visitors"]).coalesce(1))
    plan = Plan(cells.select("dims", "cell", "residents", "visitors").collect())

    spread = dealt(homes, plan).groupBy("bin", "part", "block")
    links = stash(spread.applyInArrow(lambda part: block_links(part, least), "key string, n long, other string"))
    cored = homes.where("core").select("key", "dims", F.col("home").alias("cell"), "m").join(F.broadcast(cells.select("dims", "cell", F.col("core"), "pivot")), ["dims", "cell"])
    counted = links.select("key", "n").unionByName(cored.select("key", (F.col("core") - F.col("m")).alias("n")))
    counted = counted.groupBy("key").agg(F.sum("n").alias("n"))
    edges = links.select(F.col("key").alias("a"), F.col("other").alias("b")).unionByName(cored.select(F.col("key").alias("a"), F.col("pivot").alias("b"))).where("a != b")
    labels = components(edges).withColumnRenamed("node", "key")

    named = distinct.select("key", "m").join(counted, "key", "left").join(labels, "key", "left")
    groups = named.select("key", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("label", "key").alias("label"))
    ids = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"))
    groups = stash(groups.join(ids, "key"))
    least_id = groups.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = stash(groups.join(least_id, "label").select("key", "n_links", "component_id"))
    found = rows.select("vec_id", "key").join(groups, "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
