"""The opN queries against their DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from pagewright.llm.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    found = QUERIES[name](spark, str(SF))
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    rows = lambda r, at: tuple(plain(r[at(c)]) for c in sorted(names))
    expected = sorted((rows(r, names.index) for r in cursor.fetchall()), key=repr)
    assert sorted((rows(r, lambda c: c) for r in found.collect()), key=repr) == expected and expected
