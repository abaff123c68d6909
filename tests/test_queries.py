"""Every registered query of the toolkit against its SQL over the smallest tables, and none of them empty."""

import math

import duckdb
import pytest

from spanforge.plans import catalog, oracles, toolkit, toolkit_sql  # noqa: F401

SF = "/root/testdata/sf0.001"
SQL = {**oracles.oracle_sql(), **toolkit_sql.oracle_sql()}
#: Queries whose rows need more documents than the smallest tables hold.
MAY_BE_EMPTY = {"unique_captures", "leaked_spans_anti", "blind_spots", "spans_phone", "spans_id16", "spans_ip", "spans_secret", "duplicate_text_hash"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "events documents benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    r = con.execute(SQL[name])
    at = [c[0] for c in r.description]
    assert sorted(at) == cols
    want = sorted((tuple(plain(x[at.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert got == want and (got or name in MAY_BE_EMPTY)


def test_queries_without_sql_run(spark):
    for name in set(catalog.queries()) - set(SQL):
        assert catalog.queries()[name](spark, SF).count() > 0
