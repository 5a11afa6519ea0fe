"""Values in replies of models (A6): the first JSON object or array inside a text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, spread

CLOSING = {"{": "}", "[": "]"}


def balanced(text: str, opening: str) -> Iterator[str]:
    """The blocks of a text from an opening mark to the one that closes it, by where they begin; marks in strings do not count.

    One walk settles all marks that it meets outside of strings; a mark that it met inside one begins a walk of its own."""
    closing = CLOSING[opening]
    mark = re.compile(r'["\\' + re.escape(opening + closing) + "]")
    ends: dict[int, int | None] = {}
    begin = text.find(opening)
    while begin >= 0:
        if begin not in ends:
            held, quoted, at = [], False, begin
            while m := mark.search(text, at):
                at, c = m.end(), m[0]
                if quoted:
                    quoted, at = c != '"', at + (c == "\\")
                elif c == '"':
                    quoted = True
                elif c == opening:
                    held.append(m.start())
                    ends.setdefault(m.start(), None)
                elif c == closing and held:
                    ends[held.pop()] = at
                    if not held:
                        break
        if ends[begin] is not None:
            yield text[begin : ends[begin]]
        begin = text.find(opening, begin + 1)


def first_value(text: str | None, opening: str) -> str | None:
    """The first block that is JSON; null where there is none."""
    for block in balanced(text or "", opening):
        try:
            json.loads(block)
        except (ValueError, RecursionError):
            continue
        return block
    return None


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: first_value(x, "{"), na_action="ignore")


@F.pandas_udf(T.StringType())
def first_array(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: first_value(x, "["), na_action="ignore")


def json_block(text: Column, opening: str = "{") -> Column:
    """The first JSON object of a text, or array, as text. Where all from the first opening mark to the last closing one is one
    value, that is found by built-in functions; only other texts with a mark are walked through in Python, in Arrow batches."""
    if session := SparkSession.getActiveSession():
        ship(session)
    first = F.locate(opening, text)
    last = F.length(text) - F.locate(CLOSING[opening], F.reverse(text)) + 1
    whole = F.when((first > 0) & (last > first), F.substring(text, first, last - first + 1))
    plain = F.try_parse_json(whole).isNotNull()
    walk = first_object if opening == "{" else first_array
    return F.coalesce(F.when(plain, whole), walk(F.when((first > 0) & ~F.coalesce(plain, F.lit(False)), text)))


def json_outer(text: Column, schema: str) -> Column:
    """The first JSON object of a text, typed, or the first array if the schema is one; null where there is none."""
    return F.from_json(json_block(text, "[" if schema.lower().startswith("array") else "{"), schema)


def with_json(df: DataFrame, text: Column, schema: str, name: str) -> DataFrame:
    """df with json_outer of a text as a column, worked out once for each row, by all cores. Spark copies the expression of a plain
    column into every filter and field that uses it; what a generator gives it does not."""
    return spread(df).select("*", F.explode(F.array(json_outer(text, schema))).alias(name))
