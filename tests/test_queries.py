"""Every query against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from lumaplan.plans.queries import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    clean = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(clean, key=lambda r: [(v is None, 0 if v is None else v) for v in r])


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = plain(tuple(r[c] for c in columns) for r in got.collect())
    assert rows
    if name in SQL:
        want = con.execute(SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert rows == plain(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["frame_index", "y", "x", "v", "pred", "diff"]
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("n", [1, 1234, 2000])
def test_unfinished_last_frame_of_events(spark, tmp_path, n):
    where = f"{tmp_path}/events.parquet"
    duckdb.sql(f"copy (select i as event_id, cast(i * 7 % 601 as double) / 8 as value from generate_series(0, {n - 1}) as g(i)) to '{where}' (format parquet)")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{where}'")
    want = c.execute(SQL["round_trip_events"])
    columns = [d[0] for d in want.description]
    got = QUERIES["round_trip_events"](spark, str(tmp_path)).select(*columns).collect()
    assert plain(map(tuple, got)) == plain(want.fetchall()) and len(got) == -(-n // 1000) and all(r["n"] == 1000 for r in got)
