"""Every registered query of the core library against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quarry.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(found):
    one = lambda v: "" if v is None else repr(float(v)) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(one(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, oracle, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = oracle.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows(df.select(*columns).collect()) == rows(tuple(r[i] for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
