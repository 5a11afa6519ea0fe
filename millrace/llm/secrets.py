"""Secret scan: keyword prefilter, anchored expressions near its hits, checksum validation.

Nulls count as empty texts; an empty text has no spans. Long texts are scanned whole. Repeated
rows each get their own result, extra columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: The base kinds in order, and the kinds that the checksum step adds.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("github", "npm", "card")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
GITHUB_HEADS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD_WORDS = ("card", "visa", "mastercard", "amex")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
CARD_REACH = 40
#: A number of 19 digits with a separator between any two, and the character behind it.
CARD_LENGTH = 38
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def crc_tail(body: str) -> str:
    """The six base-62 digits of body's CRC-32 that such tokens end in."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def build_prefilter() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("github", GITHUB_HEADS), ("npm", ("npm_",)), ("card", CARD_WORDS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def folded(text: str) -> str:
    """text with letters in lower case and every position kept."""
    low = text.lower()
    return low if len(low) == len(text) else re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of 24 or more hex digits. Such a run covers a position that is a multiple of 24:
    only around those does the anchored expression look."""
    out, end = [], 0
    for i, c in enumerate(text[MIN_HEX - 1 :: MIN_HEX]):
        at = (i + 1) * MIN_HEX - 1
        if at < end or c not in "0123456789abcdef":
            continue
        begin = at
        while begin > end and text[begin - 1] in "0123456789abcdef":
            begin -= 1
        end = HEX.match(text, begin).end()
        if end - begin >= MIN_HEX:
            out.append((begin, end))
    return out


def scan(text: str, prefilter: ahocorasick.Automaton) -> tuple[list, list]:
    """The base spans and the added spans of a text, each (start, order of its kind, kind, end)."""
    near: dict[str, list[int]] = {}
    for last, (kind, n) in prefilter.iter(folded(text)):
        near.setdefault(kind, []).append(last + 1 - n)
    base, added = [], []
    for order, (kind, what, group, least) in enumerate((("assign", ASSIGN, 1, MIN_ASSIGN), ("access", ACCESS, 0, MIN_ACCESS))):
        done = 0
        for at in sorted(near.get(kind, ())):
            if at >= done and (m := what.match(text, at)):
                done = m.end()
                if len(m[group]) >= least:
                    base.append((at, order, kind, done))
    base += [(s, 2, "hex", e) for s, e in hex_runs(text)]
    for order, (kind, what) in enumerate((("github", GITHUB), ("npm", NPM)), 3):
        added += [(at, order, kind, m.end()) for at in near.get(kind, ()) if (m := what.match(text, at)) and crc_tail(m[1]) == m[2]]
    cards = set()
    for at in near.get("card", ()):
        for m in CARD.finditer(text, at, min(len(text), at + CARD_REACH + CARD_LENGTH)):
            if m.start() <= at + CARD_REACH and luhn(re.sub("[ -]", "", m[0])):
                cards.add((m.start(), 5, "card", m.end()))
    return sorted(base), sorted(added + list(cards))


def listed(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with counts of the base kinds, the digest of the base spans and all spans.

    Spans are code points, end exclusive, ordered by start and then by kind as listed.
    """

    def start():
        prefilter = build_prefilter()

        def work(ids: list, texts: list) -> dict:
            out: dict[str, list] = {f.name: [] for f in SCHEMA}
            out["doc_id"] = ids
            for text in texts:
                base, added = scan(text or "", prefilter)
                kinds = [x[2] for x in base]
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(kinds.count(k))
                out["base_sha256"].append(sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(sorted(base + added)))
            return out

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), SCHEMA, start)
