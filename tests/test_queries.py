"""Every core query runs at the smallest scale and agrees with its SQL."""

import os

import duckdb
import pytest

from heddle.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return connection


def plain(row):
    return tuple(f"{x:.9g}" if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF)
    rows = sorted((plain(r) for r in found.select(*sorted(found.columns)).collect()), key=repr)
    if name in ORACLE_SQL:
        columns = ", ".join(f'"{c}"' for c in sorted(found.columns))
        assert rows == sorted((plain(r) for r in db.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()), key=repr)
    else:
        assert rows
