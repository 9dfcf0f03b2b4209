from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.llm.sharding import ShardStore
from tests.llm.documents import table


def test_appends_compact_and_keep_every_row(spark, tmp_path):
    docs = table(spark)
    store = ShardStore(spark, f"file://{tmp_path}", target=60_000, fanout=3, smallest=1_000)
    parts = [docs.where(F.coalesce(F.pmod(F.hash("doc_id"), F.lit(6)), F.lit(0)) == k).coalesce(1) for k in range(6)]
    for k, part in enumerate(parts):
        assert store.append(part) == k + 1
    before = store.manifest().count()
    last = store.compact()
    assert last > 6 and store.manifest().count() < before
    assert store.manifest().agg(F.sum("rows")).first()[0] == docs.count()
    key = lambda frame: sorted(map(str, frame.select(*docs.columns).collect()))
    assert key(store.read()) == key(docs)
    assert key(store.read(3)) == key(parts[0].union(parts[1]).union(parts[2]))  # older versions stay readable
    assert store.vacuum() > 0
    assert key(store.read()) == key(docs)
    tiers = store.manifest().where(F.col("bytes") < 30_000).groupBy("tier").count()
    assert tiers.where("count >= 3").count() == 0


def test_a_version_is_committed_once(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}")
    store.append(table(spark))
    taken = store.manifest()
    with pytest.raises(RuntimeError):
        store.commit(taken, 1)
    assert store.version() == 1 and store.manifest().count() == taken.count()


def test_an_empty_store(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}")
    assert store.version() == 0 and store.manifest().count() == 0 and store.compact() == 0
    with pytest.raises(ValueError):
        store.read()
    store.append(table(spark).where("false"))
    assert store.version() == 1 and store.manifest().count() == 0
    assert store.read().count() == 0 and store.read().columns == [*table(spark).columns, "_shard"]
