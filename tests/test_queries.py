"""Every registered query against its DuckDB counterpart on the smallest test tables."""

import math
import os

import duckdb
import pytest

from vitrine import registry

SF = os.environ.get("VITRINE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("<NA>", "NaT"):
        return "NULL"
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "tolist"):
        value = value.tolist()
    return str(value)


def canonical(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_duckdb(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    wanted = duck.sql(registry.oracle_sql()[name]).df()
    assert canonical(found) == canonical(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).columns


def test_limited_queries_are_not_empty(spark):
    assert registry.queries()["catalog_listing_price_asc"](spark, SF).count() == 12
