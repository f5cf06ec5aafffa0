"""Queries of this subpackage against their SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from pointweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df, result = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    got = sorted(str([r[n] for n in order]) for r in df.collect())
    assert got == sorted(str([r[names.index(n)] for n in order]) for r in result.fetchall()) and got
