"""Registered queries with an oracle give the same rows as DuckDB."""

import duckdb
import pytest

from aerostrata.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    theirs = sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()))
    assert mine and mine == theirs


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
