"""The queries with SQL counterparts, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from schemagauge.llm.oracles import ORACLES
from schemagauge.llm.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    duck = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    given = [d[0] for d in result.description]
    assert sorted(given) == columns
    order = [given.index(c) for c in columns]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected
