"""Text expressions (B, D2, F1, H1, N2, N3): built-in functions on columns, no Python in tasks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the cleaner, of the output mask and of the three screens, in their order.
PAGE_NUMBER = r"^\s*[-–——]?\s*(\d{1,4}|第\s*\d+\s*页|Page\s*\d+)\s*[-–——]?\s*$"
RULE_LINE = r"^\s*[-=_*·—―]{3,}\s*$"
OUTPUT_PII = (r"1[3-9]\d{9}", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"\d{17}[0-9Xx]", r"\d{16,19}", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")
INJECTION = (
    r"(?i)ignore\s+(previous|prior|above|all)\s+instructions",
    r"(?i)disregard\s+(previous|prior|above|all)",
    r"(?i)you\s+are\s+(now|a|an)\s+(dan|developer|admin)",
    r"(?i)system\s*prompt",
    r"(?i)reveal\s+(your|the)\s+(system|initial)\s+prompt",
    r"(?i)jailbreak",
    r"(?i)act\s+as\s+(if|a)\s+(you|different)",
    r"(?i)override\s+(safety|content|filter)",
    r"(?i)忘记|忽略|无视.*(之前|上面|所有).*(指令|提示|规则)",
)
PROTECTED = (r"(?i)copyright\s+\(c\)\s+\d{4}", r"(?i)all\s+rights\s+reserved", r"(?i)licensed\s+under\s+(MIT|Apache|GPL)", r"(?i)DO\s+NOT\s+DISTRIBUTE", r"(?i)CONFIDENTIAL")
LEAK = (
    r"(?i)you\s+are\s+a\s+(helpful|knowledge|wiki)\s+assistant",
    r"(?i)your\s+(task|role|mission)\s+is\s+to",
    r"(?i)system\s*:\s*you\s+are",
    r"(?i)<system>",
    r"(?i)\[INST\]",
    r"(?i)guardrail.*instruction",
    r"(?i)rule\s+of\s+two",
)
#: violation type -> (patterns, risk)
SCREENS = {"PROMPT_INJECTION": (INJECTION, 0.9), "SYSTEM_PROMPT_LEAK": (LEAK, 0.85), "PROTECTED_MATERIAL": (PROTECTED, 0.7)}

FREQUENT_LINE_LENGTH = 50
#: White space, visible ASCII, other visible characters, and controls as the reference's platform has them.
SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
ASCII_MARK = r"[\x{0}-\x{8}\x{E}-\x{1B}\x{21}-\x{7F}]"
WIDE_MARK = r"[^\x{0}-\x{7F}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}]"
BAD_MARK = r"[\x{1}-\x{8}\x{E}-\x{1B}\x{7F}-\x{9F}\x{FFFD}]"
#: What is masked before text leaves, in the order in which kinds take their characters.
ID_CARD, PHONE, BANK_CARD = r"(?<![0-9Xx])(\d{6})\d{8}(\d{3}[0-9Xx])(?![0-9Xx])", r"(?<![0-9])(1[3-9]\d)\d{4}(\d{4})(?![0-9])", r"(?<![0-9])(\d{4})\d{8,11}(\d{4})(?![0-9])"
LOCAL, DOMAIN = "A-Za-z0-9._%+-", r"([A-Za-z0-9.-]+\.[A-Za-z]{2,})"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, not again for each element of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(text: Column) -> Column:
    """Line ends unified, zero-width characters dropped, each line stripped; page-number and rule lines and
    short lines that occur three times or more dropped; blanks and empty lines squeezed; null gives the empty text."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "[\\x{200B}-\\x{200D}\\x{FEFF}]", "")
    strip = lambda c: F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    short = lambda lines: F.array_sort(F.filter(lines, lambda s: (F.length(s) > 0) & (F.length(s) < FREQUENT_LINE_LENGTH)))
    often = lambda sorted_: F.array_distinct(F.filter(sorted_, lambda s, i: s == F.get(sorted_, i + 2)))
    kept = lambda lines, dropped: F.filter(lines, lambda s: ~s.rlike(PAGE_NUMBER) & ~s.rlike(RULE_LINE) & ~F.array_contains(dropped, s))
    stripped = F.transform(F.split(t, "\n"), strip)
    body = once(stripped, lambda lines: once(short(lines), lambda ordered: once(often(ordered), lambda dropped: F.array_join(kept(lines, dropped), "\n"))))
    squeezed = F.regexp_replace(body, "[ \t\\x{A0}]{2,}", " ")
    return strip(F.regexp_replace(squeezed, "\n{3,}", "\n\n"))


def content_hash(text: Column) -> Column:
    """The digest of a text without white space and case; null counts as the empty text."""
    return F.sha2(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")), 256)


def token_estimate(text: Column) -> Column:
    """Of each run of visible ASCII characters a quarter of its letters and digits, rounded up, and one for
    each other mark; one for each other character that is no white space."""
    text = F.coalesce(text, F.lit(""))
    alnum = lambda w: F.length(F.regexp_replace(w, "[^A-Za-z0-9]", ""))
    runs = F.aggregate(F.regexp_extract_all(text, F.lit(f"{ASCII_MARK}+"), 0), F.lit(0), lambda n, w: n + F.ceil(alnum(w) / 4).cast("int"))
    return runs + F.regexp_count(text, F.lit(f"(?![A-Za-z0-9]){ASCII_MARK}")) + F.regexp_count(text, F.lit(WIDE_MARK))


def bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def text_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, without case, punctuation and repeated blanks; 1 for two empty texts."""
    x, y = bare(F.coalesce(a, F.lit(""))), bare(F.coalesce(b, F.lit("")))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def looks_garbled(text: Column) -> Column:
    """Of 10 or more visible characters (in UTF-16) a tenth is U+FFFD or a control, or a quarter is NUL; null is not garbled."""
    text = F.coalesce(text, F.lit(""))
    n = F.regexp_count(text, F.lit(NOT_SPACE)) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    bad = F.regexp_count(text, F.lit(BAD_MARK))
    nul = F.regexp_count(text, F.lit(r"\x{0}"))
    return (n >= 10) & ((bad >= 0.1 * n) | (nul >= 0.25 * n))


def one_line(text: Column, n: int) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"[\r\n]+", " ")), F.lit(n))


def question_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def words_of(text: Column) -> Column:
    """Lower-case words of two or more ASCII letters, digits and underscores, and pairs of CJK characters."""
    low = F.lower(text)
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), 0), F.regexp_extract_all(low, F.lit(r"(?=([\x{4E00}-\x{9FFF}]{2}))"), 1))


def word_count(text: Column) -> Column:
    """How many words_of a text has."""
    low = F.lower(text)
    return F.regexp_count(low, F.lit("[a-z0-9_]{2,}")) + F.regexp_count(low, F.lit(r"(?=[\x{4E00}-\x{9FFF}]{2})"))


def shingles(text: Column) -> Column:
    return F.array_distinct(words_of(text))


def query_terms(text: Column, most: int = 12) -> Column:
    """The distinct words of a question, then pairs of CJK characters while there are fewer than `most` terms; a single character is its own term."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]{2,}"), 0), F.lower))
    pairs = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?=([\x{4E00}-\x{9FFF}]{2}))"), 1))
    return F.when(F.length(t) == 1, F.array(t)).otherwise(F.concat(words, F.slice(pairs, F.lit(1), F.greatest(F.lit(0), most - F.size(words)))))


def mask_pii(text: Column) -> Column:
    """ID cards, phones, bank cards and e-mail addresses masked in that order; none takes characters of one before it.
    Three private characters (U+E000 to U+E002, dropped from the text) guard what is masked against the next kind."""
    guard = "\ue000"
    t = F.regexp_replace(text, guard, "")
    for pattern, stars in ((ID_CARD, 8), (PHONE, 4), (BANK_CARD, 8)):
        t = F.regexp_replace(t, f"(?<!{guard}){pattern}", f"$1{'*' * stars}$2{guard}")
    # an address that holds something masked stays as it is, and takes its characters: another sign stands for its @ meanwhile
    at, end, part, host = "\ue001", "\ue002", f"[*{guard}{LOCAL}]*", f"[*{guard}A-Za-z0-9.-]*"
    t = F.regexp_replace(t, f"[{at}{end}]", "")
    t = F.regexp_replace(t, f"({part}{guard}{part})@({host}\\.[A-Za-z]{{2,}})", f"$1{at}$2{end}")
    t = F.regexp_replace(t, f"({part})@({host}{guard}{host}\\.[A-Za-z]{{2,}})", f"$1{at}$2{end}")
    begin = f"(?:(?<![{guard}{LOCAL}])|\\G)"
    t = F.regexp_replace(t, f"{begin}(?:([{LOCAL}]{{2}})(?=[{LOCAL}]))?[{LOCAL}]+@{DOMAIN}", "$1***@$2")
    return F.translate(F.regexp_replace(t, f"[{guard}{end}]", ""), at, "@")


def classify(text: Column, labels: dict[str, list[str]], default: str) -> Column:
    """The label most of whose keywords occur; the first of equals; the default for none."""
    low = F.lower(text)
    scores = [F.struct(sum((F.contains(low, F.lit(k.lower())).cast("int") for k in ks), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("label")) for i, (name, ks) in enumerate(labels.items())]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.when(best["n"] > 0, best["label"]).otherwise(default)


def redact_output(text: Column, mark: str = "[REDACTED]") -> Column:
    for p in OUTPUT_PII:
        replaced = F.regexp_replace(text, p, mark)
        # without an @ the e-mail pattern would only be tried, from every character on
        text = F.when(F.contains(text, F.lit("@")), replaced).otherwise(text) if "@" in p else replaced
    return text


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """The place of the first pattern of a list that a text matches, from 1; null for none."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(patterns, 1)))


def screens(products: tuple[str, ...] = ()) -> dict[str, tuple[tuple[str, ...], float]]:
    """SCREENS, and prompts of the named products as leaks."""
    patterns, risk = SCREENS["SYSTEM_PROMPT_LEAK"]
    named = tuple(f"(?i){re.escape(p)}.*prompt" for p in products)
    return SCREENS | {"SYSTEM_PROMPT_LEAK": (patterns + named, risk)}


def violations(text: Column, products: tuple[str, ...] = ()) -> Column:
    """Array of structs (violation, pattern, risk): of each screen that a text fails, the place of the first pattern it matches."""
    known = screens(products).items()
    found = [F.struct(F.lit(name).alias("violation"), first_match(text, patterns).alias("pattern"), F.lit(risk).alias("risk")) for name, (patterns, risk) in known]
    return F.filter(F.array(*found), lambda x: x["pattern"].isNotNull())


def bucket(feature: str, key: Column) -> Column:
    """The bucket of 100 that a key falls into: the first four bytes of a digest without the sign."""
    k = F.when(F.trim(F.coalesce(key, F.lit(""))) == "", "anonymous").otherwise(key)
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(feature + ":"), k), 256), 1, 8), 16, 10).cast("long")
    return head.bitwiseAND(F.lit(0x7FFFFFFF)) % 100
