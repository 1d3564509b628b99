"""Every registered query with a SQL twin gives the twin's rows, bit for bit."""

import glob
import math
import os

import duckdb
import pytest

from registered import ORACLES, QUERIES
from registered.registry import COVERS

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def scale(name):
    """The smallest tables have fewer weighted units than the survey sample asks for, an error."""
    return os.environ.get("TEST_SF_DIR", LARGER if "sampled AS" in ORACLES[name] else SMALL)


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    folder = scale(name)
    df = QUERIES[name](spark, folder)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    answer = duck(folder).execute(ORACLES[name])
    assert mine == table([d[0] for d in answer.description], answer.fetchall())


def test_every_query_is_covered_by_sql_or_is_a_model():
    without = {n for n in QUERIES if n not in ORACLES}
    assert all(any(c.startswith(("ML", "T8", "X")) for c in COVERS[n]) for n in without)
