"""Every query with an oracle gives the same rows as DuckDB; the others give rows."""

import os

import duckdb
import pytest

from aerostrata.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if x != x else repr(round(x, 9) + 0.0)
        return str(x) if hasattr(x, "isoformat") else repr(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    listed = ", ".join(f'"{c}"' for c in cols)
    theirs = duck.sql(f"SELECT {listed} FROM ({ORACLES[name]})").fetchall()
    assert mine, "no rows"
    assert plain(mine) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DIR).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert os.path.isdir(__spark_entry__.SMOKE_DIR)
    assert __spark_entry__.entry(spark).count() > 0
