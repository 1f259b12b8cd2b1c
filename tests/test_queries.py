"""Every query of the core with a statement beside it gives the same rows; the others run."""

import glob
import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

from loomtext.plans.catalog import CATALOG  # noqa: E402

FOLDER = os.environ.get("LOOMTEXT_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list):
        return tuple(map(plain, v))
    return repr(v) if isinstance(v, float) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in table.select(names).to_pylist())


def result(spark, name):
    """The rows of a query whose plan joins nothing without an equal key."""
    df = CATALOG.queries[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    return df.toArrow()


@pytest.mark.parametrize("name", sorted(CATALOG.sql))
def test_same_rows(spark, duck, name):
    got = rows(result(spark, name))
    assert got == rows(duck.sql(CATALOG.sql[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(CATALOG.queries.keys() - CATALOG.sql.keys()))
def test_runs(spark, name):
    result(spark, name)


def test_every_query_says_what_it_is():
    assert all(q.__doc__ for q in CATALOG.queries.values())
