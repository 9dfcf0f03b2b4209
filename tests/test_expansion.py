from __future__ import annotations

import random
import time
from itertools import product

import pytest
from pyspark.sql import functions as F

from lodestone.operators import funnel

SCHEMA = "benchmark_id string, pos long, " + ", ".join(f"{a} array<string>" for a in funnel.AXES)


def plain(rows, limit, scans):
    """Turn by turn, one combination of each benchmark."""
    lists = [(r[0], r[1], list(product(*[list(dict.fromkeys(v)) or [None] for v in r[2:]]))) for r in sorted(rows, key=lambda r: r[1])]
    out, turn = [], 0
    while len(out) < scans and any(turn < len(c) for _, _, c in lists):
        out += [(b, *c[turn]) for b, _, c in lists if turn < len(c)]
        turn += 1
    return [(k, *x) for k, x in enumerate(out[:scans], 1)][:limit]


@pytest.mark.parametrize(("n", "limit", "scans"), [(7, 1000, 40), (7, 25, 5000), (60, 100, 50), (3, 10_000, 200), (1, 5, 5)])
def test_expansion_equals_turns(spark, n, limit, scans):
    rng = random.Random(n)
    rows = [(f"BENCH-{k}", k, *[[f"{a}{x}" for x in range(rng.randrange(0, 4))] for a in range(6)]) for k in rng.sample(range(500), n)]
    found = funnel.expanded(spark.createDataFrame(rows, SCHEMA).repartition(3), limit, scans).orderBy("scan").collect()
    names = [a.removesuffix("s") for a in funnel.AXES]
    assert [(r.scan, r.benchmark_id, *[r[x] for x in names]) for r in found] == plain(rows, limit, scans)


def test_many_benchmarks_make_no_more_rows(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("BENCH-"), "id").alias("benchmark_id"), F.col("id").alias("pos"), *[F.array(*[F.lit(f"{a}{k}") for k in range(6)]).alias(a) for a in funnel.AXES])
    began = time.time()
    assert funnel.expanded(rows).count() == 200 and time.time() - began < 60
