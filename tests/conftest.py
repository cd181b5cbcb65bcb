import glob
import os

import pytest

from tagloom.plans.base import counting
from tagloom.runtime import purge, session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="4", shuffle=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    purge(s)
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    """Rows as comparable tuples; floats to six places."""
    one = lambda x: round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


def check_against_sql(spark, duck, query, sql, sf=SF):
    got = query(spark, sf)
    cols = sorted(got.columns)
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({counting(sql)})").fetchall()
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want)
