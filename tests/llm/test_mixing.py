from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing
from tests.llm.documents import SCHEMA, table


def plain_targets(sizes, weights=(5, 2, 1), limit=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = total - sum(limit * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: limit * sizes[s] if s in full else free * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > limit * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_share_the_excess(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 50, None: 700}, {"a": 1, "b": 2, "c": 900, "d": 0}, {"z": 4}, {None: 0}):
        frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        found = {r.source: r.target for r in mixing.targets(frame).collect()}
        want = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert found == pytest.approx(want)


def test_many_sources_take_the_weights_in_turn(spark):
    names = [f"s{k:03d}" for k in range(200)] + ["\uffff", "\U0001f600", None]
    frame = spark.createDataFrame([(x, 7) for x in names], "source string, source_size long")
    for parts in (1, 3, 50):
        found = {r.source: r.target for r in mixing.targets(frame.repartition(parts)).collect()}
        assert found == pytest.approx(plain_targets(dict.fromkeys(names, 7)))


def test_copies_follow_the_rate(spark):
    docs = table(spark)
    found = mixing.mixed(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    target = plain_targets(sizes)
    assert len(found) == docs.count()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        rate = target[r.source] / sizes[r.source]
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 3
    assert sorted(map(str, found)) == sorted(map(str, mixing.mixed(docs).collect()))


def test_draws_are_uniform(spark):
    draws = spark.range(4000).select(mixing.uniform(F.col("id"), 20).alias("u")).toPandas()["u"]
    assert 0 <= draws.min() and draws.max() < 1
    assert draws.mean() == pytest.approx(0.5, abs=0.02) and (draws < 0.25).mean() == pytest.approx(0.25, abs=0.03)


def test_the_mix_repeats_documents(spark):
    docs = table(spark).withColumns({c: F.lit(1) for c in ("a.b", "of", "rate", "doc", "from", "id", "times", "_rate", "_of")})
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns
    found = Counter(r.doc_id for r in mix.collect())
    want = Counter()
    for r in mixing.mixed(docs).collect():
        want[r.doc_id] += r.copies
    assert found == +want


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0
