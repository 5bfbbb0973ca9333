"""Every query against its SQL, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from octetloom.plans import format_queries  # noqa: F401
from octetloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    yield con
    con.close()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return bytes(x) if isinstance(x, bytearray) else x


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = sorted(([tuple(map(plain, r)) for r in result.fetchall()]), key=repr)
    got = sorted(([tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]), key=repr)
    assert got == wanted


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
