from __future__ import annotations

import random

import pytest

from lodestone.operators import discovery


def plain(rows, max_items, max_chars, overhead):
    out, now = {}, object()
    for g, k, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if g != now:
            now, number, items, used = g, 1, 0, overhead
        if items and (items >= max_items or used + (n or 0) > max_chars):
            number, items, used = number + 1, 0, overhead
        items, used = items + 1, used + (n or 0)
        out[k] = number
    return out


@pytest.mark.parametrize(("stretch", "items", "chars"), [(5, 4, 60), (7, 7, 1000), (16, 3, 20), (1 << 14, 16, 100)])
def test_batches_equal_a_fold(spark, monkeypatch, stretch, items, chars):
    monkeypatch.setattr(discovery, "STRETCH", stretch)
    rng = random.Random(stretch)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, 0, 5, 9, 30, 200])) for k in range(300)]
    rows += [("one", 1000, 7), ("exact", 2000 + stretch, 1)] + [("full", 3000 + k, 1) for k in range(2 * stretch)][:400]
    found = discovery.review_batches(spark.createDataFrame(rows, "g string, k long, n long").repartition(3), "g", ["k"], "n", items, chars, 3)
    assert found.columns == ["g", "k", "n", "batch"]
    assert {r.k: r.batch for r in found.collect()} == plain(rows, items, chars, 3)


def test_no_tasks(spark):
    assert discovery.review_batches(spark.createDataFrame([], "g string, k long, n long"), "g", ["k"], "n").count() == 0
