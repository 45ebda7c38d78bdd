"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from brinegrid.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    cell = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else v
    return columns, sorted(map(repr, (tuple(cell(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equal_to_sql(spark, duck, name):
    assert rows(plans.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(plans.SQL[name]).df())
