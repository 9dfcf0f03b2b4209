from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lodestone.plans import evidence_queries, funnel_queries, more_queries, packet_queries, queries, reach_queries, stream_queries

assert more_queries.query is evidence_queries.query is packet_queries.query is stream_queries.query is funnel_queries.query is reach_queries.query is queries.query
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def database():
    found = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        found.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, database, name):
    found = queries.QUERIES[name](spark, str(FOLDER))
    want = database.execute(queries.ORACLE[name])
    columns = sorted(found.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    rows = [tuple(str(r[names.index(c)]) for c in columns) for r in want.fetchall()]
    assert sorted(tuple(str(r[c]) for c in columns) for r in found.collect()) == sorted(rows)
