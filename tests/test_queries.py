"""Every query with SQL of its own gives that SQL's rows, at the smallest scale."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from foliospark.plans import queries as plans  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows(names, values):
    def plain(v):
        return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) + 0.0 if isinstance(v, float) else v

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([plain(r[k]) for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA)
    want = db.execute(plans.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
