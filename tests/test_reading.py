from __future__ import annotations

import random
from collections import Counter

import pytest

from lodestone.operators import reading

SCHEMA = "run string, evidence_id long, industry_ids array<string>, task_family_ids array<string>, source string, evidence_role string, quality int, position_ long"


def plain(rows, k):
    """One row after the other, by what has been shown."""
    group = {**dict.fromkeys(reading.BEHAVIOUR, "behavior"), "official_pricing": "commercial", "alternative": "challenge", "counter_evidence": "challenge"}
    left = [(r[1], tuple(sorted(set(r[2] or ()))) or ("unclassified",), tuple(sorted(set(r[3] or ()))) or ("unknown",), r[4] or "unknown", r[5] or "discovery", r[6]) for r in rows]
    seen, out = [Counter() for _ in range(5)], []
    while left and len(out) < k:
        rank = lambda r: (r[5] >= 2, min(seen[0][x] for x in r[1]), seen[1][group.get(r[4], "unknown")], min(seen[2][x] for x in r[2]), seen[3][r[3]], seen[4][r[4]], r[5], r[0])
        best = min(left, key=rank)
        left.remove(best)
        out.append(best[0])
        for c, values in zip(seen, (best[1], [group.get(best[4], "unknown")], best[2], [best[3]], [best[4]]), strict=True):
            c.update(values)
    return out


@pytest.mark.parametrize("k", [1, 12, 40])
def test_order_equals_a_plain_model(spark, k):
    rng = random.Random(k)
    some = lambda n: [f"i{rng.randrange(6)}" for _ in range(rng.randrange(n))] or None
    rows = [
        (rng.choice(["r1", "r2", None]), key, some(4), some(3), rng.choice(["a", "b", "", None]), rng.choice(["payment", "official_pricing", "alternative", "workflow_pain", None]), rng.randrange(4), 0)
        for key in rng.sample(range(10_000), 500)
    ]
    found = reading.fair_order(spark.createDataFrame(rows, SCHEMA).repartition(4), k, ["run"]).orderBy("position").collect()
    for run in ("r1", "r2", None):
        assert [r.evidence_id for r in found if r.run == run] == plain([r for r in rows if r[0] == run], k)
    whole = reading.fair_order(spark.createDataFrame(rows, SCHEMA), k).orderBy("position").collect()
    assert [r.evidence_id for r in whole] == plain(rows, k) and [r.position for r in whole] == list(range(1, k + 1))


def test_fewer_rows_than_places_and_none(spark):
    one = spark.createDataFrame([("r", 1, None, None, None, None, 3, 0)], SCHEMA)
    assert [(r.evidence_id, r.position) for r in reading.fair_order(one, 30).collect()] == [(1, 1)]
    assert reading.fair_order(one.limit(0), 30, ["run"]).count() == 0
