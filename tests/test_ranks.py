from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.operators import ranks

SCHEMA = "g string, x double, key long"


def rows(n: int = 300):
    """Most rows in one group, ties, nulls and repeats of the value."""
    rng = random.Random(4)
    return [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, -3.0]), k) for k in rng.sample(range(n), n)]


def last(x):
    return (x is None, 0 if x is None else x)


def test_numbers_equal_a_sort(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    want = {r[2]: k for k, r in enumerate(sorted(rows(), key=lambda r: (last(r[1]), r[2])), 1)}
    for parts in (1, 7):
        found = ranks.numbered(frame.repartition(parts), [F.col("x").asc_nulls_last(), "key"], "n")
        assert found.columns == ["g", "x", "key", "n"] and dict(found.dtypes)["n"] == "bigint"
        assert {r.key: r.n for r in found.collect()} == want


def test_numbers_within_groups(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    want = {}
    for g in ("hot", "a", "b", None):
        group = sorted((r for r in rows() if r[0] == g), key=lambda r: (last(r[1]), -r[2]))
        want |= {r[2]: k for k, r in enumerate(group, 1)}
    found = ranks.numbered_within(frame, ["g"], [F.col("x").asc_nulls_last(), F.col("key").desc()], "n")
    assert found.columns == ["g", "x", "key", "n"]
    assert {r.key: r.n for r in found.collect()} == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ranks.numbered(empty, ["key"], "n").count() == 0
    assert ranks.numbered_within(empty, ["g"], ["key"], "n").count() == 0
