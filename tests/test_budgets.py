from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.operators import budgets, ranks


def fold(rows, limit, most):
    used, n = defaultdict(Decimal), Counter()
    for group, k, size in sorted(rows, key=lambda r: r[1]):
        fits = size is not None and used[group] + size <= limit and (most is None or n[group] < most)
        used[group] += size if fits else 0
        n[group] += fits
        yield group, k, fits


@pytest.mark.parametrize(("most", "rounds"), [(None, 0), (None, 2), (7, 1), (40, 2), (None, 5)])
def test_greedy_equals_a_plain_fold(spark, monkeypatch, most, rounds):
    monkeypatch.setattr(budgets, "FEW", 0)
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b", None]), k, rng.choice([None, Decimal(rng.randint(0, 900)), Decimal(rng.randint(0, 5)) / 7, Decimal(k % 50)])) for k in range(900)]
    rows = [(g, k, None if x is None else x.quantize(Decimal("0.000000000001"))) for g, k, x in rows]
    frame = spark.createDataFrame(rows, "g string, k int, x decimal(25,12)").repartition(4)
    found = budgets.greedy(frame, ["g"], ["k"], F.col("x"), Decimal(1500), most, rounds=rounds).collect()
    assert Counter((r.g, r.k, r.fits) for r in found) == Counter(fold(rows, 1500, most))


def test_one_group_without_columns_and_no_rows(spark):
    frame = spark.createDataFrame([(k, Decimal(k % 9)) for k in range(200)], "k int, x decimal(25,12)")
    found = {r.k: r.fits for r in budgets.greedy(frame, [], ["k"], F.col("x"), 100, 30).collect()}
    assert found == {k: fits for _, k, fits in fold([(0, k, Decimal(k % 9)) for k in range(200)], 100, 30)}
    assert budgets.greedy(frame.where("false"), [], ["k"], F.col("x"), 100).count() == 0


def test_running_sums_equal_a_plain_form(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", None]), rng.randint(0, 10_000), rng.randint(-3, 9)) for _ in range(500)]
    rows = list({(g, k): (g, k, v) for g, k, v in rows}.values())
    want, so_far = set(), Counter()
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        so_far[g] += v
        want.add((g, k, so_far[g]))
    found = ranks.running(spark.createDataFrame(rows, "g string, k int, v int").repartition(5), ["g"], ["k"], {"total": F.col("v")})
    assert {(r.g, r.k, r.total) for r in found.collect()} == want and found.columns == ["g", "k", "v", "total"]
