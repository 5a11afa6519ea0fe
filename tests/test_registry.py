"""Every registered query of the library against its SQL twin on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float | Decimal):
        return None if v != v else round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    r = duck.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(r.description)}
    assert sorted(at) == cols
    assert got == sorted(repr([plain(row[at[c]]) for c in cols]) for row in r.fetchall())


def test_flagship_gives_rows(spark):
    assert registry.flagship(spark, SF).count() > 0
