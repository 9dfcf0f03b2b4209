from __future__ import annotations

import duckdb
import pytest

from lodestone.llm import queries
from tests.llm.documents import rows, table
from tests.llm.test_warc import SCHEMA as PAGES
from tests.llm.test_warc import pages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with awkward texts; keys are present and unique, as the SQL joins by them."""
    path = tmp_path_factory.mktemp("tables")
    unique = list({r[0]: r for r in rows() if r[0] is not None}.values())
    table(spark, unique).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list({p[0]: p for p in pages() if p[0] is not None}.values()), PAGES).write.parquet(f"{path}/pages.parquet")
    chat = [(c, t, ("user", "assistant", "system", None)[(c * t) % 4 if c > 3 else t % 2], None if t == 5 else f"turn {t} \"é\"\n\\{c}") for c in range(8) for t in range(12) if (c + t) % 7]
    spark.createDataFrame([r for r in chat if r[3] is not None], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    keys = sorted(r[0] for r in unique)
    spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in keys[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(k, None if k == 3 else f"{(unique[k][1] or '')[:90]} EVERYWHERE é{k}") for k in range(0, 60, 3)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, folder, name):
    database = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        database.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = queries.QUERIES[name](spark, str(folder))
    want = database.execute(queries.ORACLE[name])
    columns, names = sorted(found.columns), [d[0] for d in want.description]
    assert columns == sorted(names)
    expected = [tuple(str(r[names.index(c)]) for c in columns) for r in want.fetchall()]
    assert sorted(tuple(str(r[c]) for c in columns) for r in found.collect()) == sorted(expected)
