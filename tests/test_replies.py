"""JSON inside the replies of models."""

import json
import random

from pyspark.sql import functions as F

from millrace.functions.replies import balanced, first_value, json_outer

CASES = [
    ("Sure: {\"k\": 1} and {\"k\": 2}", 1), ("```json\n{\"k\": 3}\n```", 3), ("{\"t\": \"a } b { \\\" \", \"k\": 4} done }", 4), ("{not json} then {\"k\": 5}", 5),
    ("{ open and {\"k\": 6}", 6), ("no object", None), (None, None), ("", None), ("}{", None), ("say \"{\" then {\"k\": 7}", 7), ("{\"k\": 8", None), ("{\"a\": {\"k\": 1}, \"k\": 9}", 9),
]


def test_first_object(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = df.select("i", json_outer(F.col("t"), "k int")["k"].alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [k for _, k in CASES]


def test_first_array(spark):
    texts = ["list: [1, 2] or [3]", "[a] [4]", "[[5], [6, 7]]", "none", "{\"x\": [8]}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", json_outer(F.col("t"), "array<string>").alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [["1", "2"], ["4"], ["[5]", "[6,7]"], None, ["8"]]


def plain_block(text, begin):
    depth, quoted, escaped = 0, False, False
    for i in range(begin, len(text)):
        c = text[i]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[begin : i + 1]
    return None


def test_blocks_equal_a_walk_from_each_mark():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice('{}"\\a:1,') for _ in range(rng.randrange(24)))
        want = [b for i, c in enumerate(text) if c == "{" and (b := plain_block(text, i))]
        assert list(balanced(text, "{")) == want, text


def test_long_texts_are_walked_once():
    assert first_value("{" * 300_000, "{") is None
    value = json.dumps({"k": ["x" * 50] * 20_000})
    assert first_value("{" * 100 + value + "}", "{") == value
