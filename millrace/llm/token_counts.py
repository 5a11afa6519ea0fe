"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a run without white space, led by the vocabulary's word mark. Its tokens are the
segmentation of highest score, where the score of a piece follows Zipf's law over the vocabulary's
own order (-ln(rank + 2)), since the file has merge ranks and no unigram scores, and a character in
no piece counts one token for each of its UTF-8 bytes at BYTE_SCORE. Of equal scores the one with
fewer tokens counts.

The distinct pre-tokens that a worker meets go into a trie; the forward score at a node is that of
its prefix, computed once for all words that begin so, and each word's count is stored where it
ends. A node also has the places of the vocabulary's own trie at which pieces that began inside the
prefix still go on, so that a new character only takes each of these one step further. The trie is
emptied when it has NODES nodes; of a word longer than SHARED characters only the beginning is kept
in it, the rest is computed on the way. Nulls count as empty texts, which have no tokens. Repeated
rows each get their own result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, map_rows

MARK = "▁"
BYTE_SCORE = -20.0
NODES, SHARED = 250_000, 48
#: Distinct words that a worker remembers in each of two generations.
WORDS_KEPT = 250_000
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_pretokens", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, float]:
    """Score of each piece that can stand in a text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    return {p: -math.log(rank + 2) for rank, p in enumerate(names)}


def vocabulary_trie(scores: dict[str, float]) -> dict:
    """By character the pair of the score, if a piece ends there, and the dict that goes on, if one does."""
    root: dict = {}
    for piece, score in scores.items():
        node = root
        for c in piece[:-1]:
            p, rest = node.get(c, (None, None))
            if rest is None:
                rest = {}
                node[c] = (p, rest)
            node = rest
        node[piece[-1]] = (score, node.get(piece[-1], (None, None))[1])
    return root


class Node:
    """A prefix: its best score, minus the tokens of that, the pieces that go on, and longer prefixes."""

    __slots__ = ("score", "fewer", "open", "children", "count")

    def __init__(self, score: float, fewer: int, open_: list) -> None:
        self.score, self.fewer, self.open = score, fewer, open_
        self.children: dict[str, Node] | None = None
        self.count = -1


class WordTrie:
    """The trie of the words met lately, each led by MARK."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.vocabulary = vocabulary_trie(scores)
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.root = self.after(Node(0.0, 0, []), MARK)

    def after(self, node: Node, c: str) -> Node:
        """The prefix of node and one more character."""
        k = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        score, fewer, go_on = node.score + BYTE_SCORE * k, node.fewer - k, []
        for at, s, n in (*node.open, (self.vocabulary, node.score, node.fewer)):
            if c in at:
                p, rest = at[c]
                if rest is not None:
                    go_on.append((rest, s, n))
                if p is not None:
                    p += s
                    if p > score or p == score and n - 1 > fewer:
                        score, fewer = p, n - 1
        return Node(score, fewer, go_on)

    def count(self, word: str) -> int:
        """Tokens of a word; nodes it shares with earlier words are not computed again."""
        if self.size > NODES:
            self.clear()
        node = self.root
        for i, c in enumerate(word):
            if i >= SHARED:
                node = self.after(node, c)
                continue
            if node.children is None:
                node.children = {}
            if c in node.children:
                node = node.children[c]
            else:
                node.children[c] = node = self.after(node, c)
                self.size += 1
        node.count = -node.fewer
        return node.count


def count_words(words: list[str], scores: dict[str, float]) -> dict[str, int]:
    """Tokens of each distinct word."""
    trie = WordTrie(scores)
    return {w: trie.count(w) for w in words}


@lru_cache(maxsize=1)
def counter(path: str) -> Memo:
    """The counts of words met lately, kept by a worker from task to task."""
    return Memo(WordTrie(pieces(path)).count, WORDS_KEPT)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number of its pre-tokens and tokens."""
    path = path or default_path()

    def start():
        known = counter(path)

        def work(ids: list, texts: list) -> dict:
            split = [(t or "").split() for t in texts]
            return {"doc_id": ids, "n_pretokens": list(map(len, split)), "n_tokens": [sum(map(known.__getitem__, w)) for w in split]}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), SCHEMA, start)
