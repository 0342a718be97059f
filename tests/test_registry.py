"""A few registered queries against their SQL; tools/check_queries.py runs them all."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = Path("/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert entry.QUERIES.keys() == entry.oracles().keys()
    assert entry.QUERIES.keys() <= entry.queries().keys() >= entry.oracle_sql().keys()


@pytest.mark.skipif(not TABLES.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", ["diff_b", "diff_raw_repeated", "gen_manifest", "strategy_matrix"])
def test_query_and_sql_agree(spark, name):
    db = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = entry.queries()[name](spark, str(TABLES))
    columns = ", ".join(df.columns)
    want = db.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)
