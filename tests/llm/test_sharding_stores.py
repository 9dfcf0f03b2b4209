from __future__ import annotations

import math
import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import queries
from lodestone.llm.sharding import ShardStore, runs
from tests.llm.documents import rows, table


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=40), st.integers(1, 200))
def test_runs_keep_the_order_and_come_near_the_target(sizes, target):
    shards = [(f"s{k}", n) for k, n in enumerate(sizes)]
    cut = runs(shards, target)
    assert [x for run in cut for x in run] == [name for name, _ in shards]
    size = dict(shards)
    for run in cut:
        assert len(run) == 1 or sum(map(size.get, run)) <= target + size[run[-1]] / 2
    for run, after in zip(cut, cut[1:], strict=False):
        assert sum(map(size.get, run)) + size[after[0]] / 2 > target


def test_columns_that_come_later_survive_compaction_and_vacuum(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}", fanout=2)
    one = spark.createDataFrame([(k, "x") for k in range(5)], "a long, x string").coalesce(1)
    two = spark.createDataFrame([("b", 7), (None, 8)], "b string, a long").coalesce(1)
    for part in (one, two, one, two):
        store.append(part)
    want = Counter([(k, "x", None) for k in range(5)] * 2 + [(7, None, "b"), (8, None, None)] * 2)
    assert Counter((r.a, r.x, r.b) for r in store.read().collect()) == want
    store.compact()
    assert store.manifest().count() == 1 and store.vacuum() == 4
    assert store.read().columns == ["a", "x", "b", "_shard"]
    assert Counter((r.a, r.x, r.b) for r in store.read().collect()) == want
    assert store.schema(1).names == ["a", "x"]


def test_a_column_of_another_type_is_refused(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}")
    store.append(spark.range(3))
    with pytest.raises(ValueError, match="id was bigint and comes as string"):
        store.append(spark.range(3).select(F.col("id").cast("string")))
    assert store.version() == 1 and not os.listdir(tmp_path / "writing")


@pytest.mark.parametrize(("name", "why"), [("_shard", "needs this name"), ("_metadata", "needs this name"), ("ID", "by case alone")])
def test_names_that_clash_are_refused(spark, tmp_path, name, why):
    store = ShardStore(spark, f"file://{tmp_path}")
    store.append(spark.range(3))
    with pytest.raises(ValueError, match=why):
        store.append(spark.range(3).toDF(name))
    assert store.version() == 1 and store.read().count() == 3


def test_vacuum_leaves_what_a_running_append_has_written(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}")
    other = ShardStore(spark, f"file://{tmp_path}")
    store.append(spark.range(3))
    plain = store._written

    def meanwhile(frame, folder, added):
        found = plain(frame, folder, added)
        assert other.vacuum() == 0
        other.append(spark.range(10, 12))  # takes the version that this append wanted
        return found

    store._written = meanwhile
    assert store.append(spark.range(100, 104)) == 3
    assert sorted(r.id for r in other.read().collect()) == [0, 1, 2, 10, 11, 100, 101, 102, 103]
    # The registration of a lost driver holds for a time, then no more.
    os.makedirs(tmp_path / "data" / "lost-0")
    (tmp_path / "data" / "lost-0" / "part-0.parquet").write_bytes(b"x")
    (tmp_path / "writing" / "lost").write_bytes(b"")
    assert other.vacuum() == 0 and other.vacuum(abandoned=-5) == 1


def replayed(store, last):
    """Holds every version against a plain model of tiers: what each commit took away and added."""
    size = lambda m: {r.shard: r.bytes for r in m.collect()}
    tier = lambda n: max(0, math.ceil(math.log(n / store.smallest) / math.log(store.fanout) - 1e-12))
    before = {}
    for version in range(1, last + 1):
        table_ = store.manifest(version)
        now = size(table_)
        assert all(r.tier == tier(r.bytes) for r in table_.collect())
        assert {r.shard for r in table_.where(F.col("added") == version).collect()} == set(now) - set(before)
        gone = set(before) - set(now)
        if gone:
            groups = {}
            for name, n in before.items():
                if n < store.target // 2:
                    groups.setdefault(tier(n), []).append((name, n))
            ready = [groups[t] for t in sorted(groups) if len(groups[t]) >= store.fanout]
            assert gone == {name for name, _ in ready[0]}
            added = {r.shard: r.added for r in store.manifest(version - 1).collect()}
            order = sorted(ready[0], key=lambda s: (added[s[0]], s[0]))
            assert len(set(now) - set(before)) == len(runs(order, store.target))
        before = now
    groups = Counter(tier(n) for n in before.values() if n < store.target // 2)
    assert all(n < store.fanout for n in groups.values())


def test_tiers_and_commits_follow_a_plain_model(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}", target=60_000, fanout=2, smallest=3_000)
    docs = table(spark, rows(n=200)).withColumn("slot", F.pmod(F.xxhash64("text", "doc_id"), F.lit(64)))
    bounds = [0, 1, 2, 3, 4, 8, 12, 20, 30, 46, 64]  # arrivals of many sizes
    for low, high in zip(bounds, bounds[1:], strict=False):
        store.append(docs.where((F.col("slot") >= low) & (F.col("slot") < high)).coalesce(1))
    last = store.compact()
    assert last > 11 and store.manifest().count() > 1  # merges of several tiers, and several files
    replayed(store, last)
    assert store.read().count() == docs.count()
    assert store.manifest().agg(F.sum("rows")).first()[0] == docs.count()


def test_the_query_names_shards_alike_in_reruns(spark, tmp_path):
    table(spark, [r for r in rows() if r[0] is not None]).write.parquet(f"{tmp_path}/documents.parquet")
    one, two = (Counter(map(tuple, queries.op4_sharding(spark, str(tmp_path)).collect())) for _ in range(2))
    assert one == two and sum(one.values()) == spark.read.parquet(f"{tmp_path}/documents.parquet").count()
