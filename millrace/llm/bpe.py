"""BPE encoding with a queue of merge ranks over a linked symbol list; decoding from vocabulary strings.

Follows a tokenizer file with a normaliser, a split expression, byte-level symbols and a word-end
suffix. Text is cut at special tokens and white space; of each chunk that a worker has not met
lately, the pre-tokens are merged here. Chunks of Latin, Greek and Cyrillic are normalised and split by
Python; others by the file's normaliser and splitter, since classes depend on a Unicode version.
Nulls count as empty texts and encode to no ids; long texts are encoded whole. Repeated rows each
get their own result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache
from hashlib import sha256

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, map_rows

#: White space of the normaliser's expression, and control characters that Python alone splits at.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ODD_SPACE = regex.compile("[\\x1c-\\x1f]")
CHUNKS = regex.compile(f"[^{SPACE}]+")
#: Below this code point letters, numbers and cases are alike in all Unicode versions concerned.
SETTLED = "\u0530"
#: Distinct chunks and pre-tokens that a worker remembers in each of two generations.
CHUNKS_KEPT, PRETOKENS_KEPT = 350_000, 250_000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Bpe:
    """A tokenizer read from a file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        m = t["model"]
        ids, end = m["vocab"], m["end_of_word_suffix"] or ""
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
        #: The rank of each pair of ids that merges, by one number for the pair; and what each rank makes.
        self.ranks = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in t["added_tokens"]}
        self.strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        symbols = byte_symbols()
        self.inner, self.last = [ids[s] for s in symbols], [ids[s + end] for s in symbols]
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        self.split = regex.compile(next(x for x in t["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"])
        self.stop = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        own = Tokenizer.from_file(path)
        self.normalizer, self.splitter = own.normalizer, own.pre_tokenizer
        self.merged = Memo(self.merge, PRETOKENS_KEPT)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token. The queue holds rank and position in one number; an entry whose
        symbols have changed meanwhile is stale and skipped."""
        parts = [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]]
        n, get, made, push, pop = len(parts), self.ranks.get, self.made, heapq.heappush, heapq.heappop
        if n == 1:
            return tuple(parts)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        queue = [r << shift | i for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = pop(queue)
            i, rank = entry & mask, entry >> shift
            j = after[i]
            if j >= n or get(parts[i] << 32 | parts[j]) != rank:
                continue
            parts[i] = now = made[rank]
            parts[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(now << 32 | parts[k])) is not None:
                    push(queue, r << shift | i)
            if (h := before[i]) >= 0 and (r := get(parts[h] << 32 | now)) is not None:
                push(queue, r << shift | h)
        return tuple([p for p in parts if p >= 0])

    def pretokens(self, chunk: str) -> list[bytes]:
        if chunk.isascii() or max(chunk) < SETTLED and "Σ" not in chunk and unicodedata.is_normalized("NFC", chunk):
            return [w.encode() for w in self.split.findall(chunk.lower())]
        parts = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in parts if w]

    def chunk(self, chunk: str) -> list[int]:
        """The ids of text without white space and special tokens."""
        return [i for w in self.pretokens(chunk) for i in self.merged[w]]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of ids, joined by the blank that this file's decoder puts between them."""
        return " ".join(map(self.strings.__getitem__, ids))

    def segments(self, text: str) -> list[str]:
        """text cut at special tokens, which are at the odd places."""
        if not any(map(text.__contains__, self.special)):
            return [text]
        out, at = [], 0
        for m in self.stop.finditer(text):
            out += [text[at : m.start()], m[0]]
            at = m.end()
        return [*out, text[at:]]

    def chunks(self, text: str) -> list[str]:
        return CHUNKS.findall(text) if ODD_SPACE.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.segments(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                for c in self.chunks(part):
                    out += self.chunk(c)
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=1)
def memo(path: str, kept: int) -> Memo:
    """Of each chunk its ids and its decoded strings as text, a blank behind each; kept by a worker from task to task."""
    bpe = loaded(path)
    bpe.merged = Memo(bpe.merge, kept * PRETOKENS_KEPT // CHUNKS_KEPT)
    names, strings = {i: f"{i} " for i in bpe.strings}, {i: f"{s} " for i, s in bpe.strings.items()}

    def make(c: str) -> tuple[str, str]:
        ids = bpe.chunk(c)
        return "".join(map(names.__getitem__, ids)), "".join(map(strings.__getitem__, ids))

    return Memo(make, kept)


def encode_digests(docs: DataFrame, path: str | None = None, kept: int = CHUNKS_KEPT) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the text decoded from them. `kept` chunks (some 500 bytes each, with
    their pre-tokens) are remembered by a worker in each of two generations; fewer take longer and change nothing."""
    path = path or default_path()

    def start():
        bpe, known = loaded(path), memo(path, kept)

        def work(keys: list, texts: list) -> dict:
            counts, ids, decoded = [], [], []
            for text in texts:
                got: list = []
                for k, part in enumerate(bpe.segments(text or "")):
                    got += [(f"{bpe.special[part]} ", f"{part} ")] if k % 2 else map(known.__getitem__, bpe.chunks(part))
                a = "".join([x[0] for x in got])
                counts.append(a.count(" "))
                ids.append(sha256(a[:-1].encode()).hexdigest())
                decoded.append(sha256("".join([x[1] for x in got])[:-1].encode()).hexdigest())
            return {"doc_id": keys, "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), SCHEMA, start)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document its ids, as array<int>."""
    path = path or default_path()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def start():
        bpe = loaded(path)
        return lambda keys, texts: {"doc_id": keys, "ids": [bpe.encode(t or "") for t in texts]}

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, start)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per row (doc_id, ids) the decoded text; null ids decode to the empty text."""
    path = path or default_path()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def start():
        bpe = loaded(path)
        return lambda keys, rows: {"doc_id": keys, "text": [bpe.decode(r or []) for r in rows]}

    return map_rows(encoded.select(F.col("doc_id").cast("long"), "ids"), schema, start)
