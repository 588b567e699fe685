"""Every query of the core against its SQL twin on the smallest dataset."""

import decimal
import glob
import os

import duckdb
import pytest

from kinolith.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_a_twin_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
