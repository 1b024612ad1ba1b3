"""The driver contract: every query against its SQL twin, and the shape of the plans."""

import os
import re
from decimal import Decimal

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 9)
    return tuple(map(value, v)) if isinstance(v, list) else v


def table(columns, rows):
    cols = sorted(columns)
    return cols, sorted((tuple(value(r[columns.index(c)]) for c in cols) for r in rows), key=repr)


# The training-data queries have tests of their own, beside their subpackage.
BASE = entry._base().QUERIES


@pytest.mark.parametrize("name", sorted(BASE))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # No pairs without a key, whatever the data; Python only reads TOML.
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert name.startswith("manifest") or not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas", plan)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in entry.oracle_sql():
        cur = duck.execute(entry.oracle_sql()[name])
        assert got == table([d[0] for d in cur.description], cur.fetchall())


def test_sql_covers_the_queries():
    rows_only = set(BASE) - set(entry.oracle_sql())
    assert rows_only == {"attribution_run"}
