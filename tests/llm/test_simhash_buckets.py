from __future__ import annotations

import itertools

import numpy as np
import pytest

from lodestone.llm import simhash
from tests.llm.test_simhash import groups


@pytest.mark.parametrize("parts", [2, 3])
def test_huge_buckets_are_cut_and_lose_no_link(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "BUCKET", 6)
    monkeypatch.setattr(simhash, "HUGE", 30)
    rng = np.random.default_rng(7)
    prints = set()
    for k in range(3):  # many prints that share a segment, some of them near each other
        shift, width, _ = simhash.segments(4, parts)[k % parts]
        shared = int(rng.integers(0, 1 << width)) << shift
        for _ in range(60):
            base = int(rng.integers(0, 1 << 63)) & ~(((1 << width) - 1) << shift) | shared
            prints.add(base)
            for _ in range(2):
                flips = [f for f in rng.choice(64, rng.integers(1, 6), replace=False)]
                prints.add(base ^ sum(1 << int(f) for f in flips))
    center = int(rng.integers(0, 1 << 62))  # and a dense ball, which stays dense however it is cut
    prints |= {center ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 60, 3), 2)}
    prints = sorted(p - (1 << 64) if p >= 1 << 63 else p for p in prints)
    mask = (1 << 64) - 1
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & mask).bit_count() <= 4]
    links = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), parts=parts).collect()]
    want, found = groups(near, prints), groups(links, prints)
    assert all((want[a] == want[b]) == (found[a] == found[b]) for a, b in itertools.combinations(prints, 2))
    assert len({want[p] for p in prints}) > 20
