"""Sets of hashed word n-grams of the texts in an Arrow column, worked out for many texts at once.

Words are runs without ASCII white space, A-Z in lower case. A word's hash is a sum over its bytes,
each weighted by its place, so that prefix sums give all words of a slice together. A text with
fewer than `width` words is one n-gram of all its words; null, empty or blank texts have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
U32 = np.uint64(32)
#: Texts of a slice together have about so many bytes; a longer text is cut at white space.
SLICE_BYTES = 1 << 20

#: The odd number whose powers weigh places, and its inverse modulo 2^64.
BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U32)) * M2
    return (h ^ (h >> U32)) * M2


def byte_values() -> np.ndarray:
    """A number for each byte, the same for both cases of a letter."""
    low = np.arange(256)
    low[65:91] += 32
    return mixed((low.astype(np.uint64) + np.uint64(1)) * M1)


VALUES = byte_values()


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """The sets of n-gram hashes of many texts."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.up = self.down = np.ones(1, np.uint64)

    def words(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of texts that begin at `begins` in data, and how many each text has."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
        if n > len(self.up):
            self.up, self.down = powers(BASE, n + n // 4), powers(INVERSE, n + n // 4)
        blank = BLANK[data]
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:], last[:-1] = blank[:-1], blank[1:]
        edge = begins[begins < n]
        first[edge] = True
        last[edge[edge > 0] - 1] = True
        starts, ends = np.flatnonzero(first & ~blank), np.flatnonzero(last & ~blank)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[data] * self.up[:n], out=sums[1:])
        counts = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
        return mixed((sums[ends + 1] - sums[starts]) * self.down[starts]), counts

    def pieces(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A long text cut at white space."""
        at = 0
        while at < len(data):
            end, step = at + SLICE_BYTES, SLICE_BYTES
            while end < len(data) and not BLANK[data[end]]:
                gap = np.flatnonzero(BLANK[data[end : end + step]])
                end, step = (end + gap[0] if len(gap) else end + step), step * 2
            yield data[at:end]
            at = end

    def ngrams(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets of texts with these words, sorted, one behind the other; and their sizes."""
        k, n = self.width, len(words)
        ends = np.cumsum(counts)
        sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        out = np.full(max(0, n - k + 1), k, np.uint64)
        for i in range(k if len(out) else 0):
            out = mixed(out * M1 + words[i : n - k + 1 + i])
        if len(out):
            text = np.repeat(np.arange(len(counts)), counts)
            out = out[text[: len(out)] == text[k - 1 :]]
        if (short := np.flatnonzero((counts > 0) & (counts < k))).size:
            whole = []
            for t in short:
                h = np.full(1, counts[t], np.uint64)
                for w in words[ends[t] - counts[t] : ends[t]]:
                    h = mixed(h * M1 + w)
                whole.append(h[0])
            out = np.insert(out, (np.cumsum(sizes) - sizes)[short] - np.arange(len(short)), whole)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[a:b].sort()
        keep = np.ones(len(out), bool)
        keep[1:] = out[1:] != out[:-1]
        keep[bounds[:-1][sizes > 0]] = True
        counted = np.concatenate(([0], np.cumsum(keep)))
        return out[keep], counted[bounds[1:]] - counted[bounds[:-1]]

    def sets(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts their sets, sorted, one behind the other; and their sizes."""
        texts = pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not len(texts):
            return
        _, offsets, values = texts.buffers()
        ends = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
            part, begins = data[ends[at] : ends[to]], ends[at:to] - ends[at]
            if len(part) > SLICE_BYTES:
                words = np.concatenate([self.words(p, np.zeros(1, np.int64))[0] for p in self.pieces(part)])
                counts = np.array([len(words)])
            else:
                words, counts = self.words(part, begins)
            yield self.ngrams(words, counts)
            at = to


def set_keys(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets have equal ones."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(grams ^ M3))))
    return mixed((sums[bounds[1:]] - sums[bounds[:-1]]) ^ (sizes.astype(np.uint64) * M1)).view(np.int64)


def lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(kind)
