from __future__ import annotations

import random

from lodestone.operators import graphs

ROWS = "record long, key string"


def plain(rows):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, k in rows:
        if r is not None:
            root(("r", r))
            if k is not None:
                parent[root(("r", r))] = root(("k", k))
    found = {}
    for r in {r for r, _ in rows if r is not None}:
        found.setdefault(root(("r", r)), []).append(r)
    return {r: min(g) for g in found.values() for r in g}


def test_groups_equal_union_find(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(400), f"k{rng.randrange(420)}") for _ in range(380)]
    rows += [(1000 + k, f"c{k + d}") for k in range(300) for d in (0, 1)]  # a long chain, in order
    rows += [(2000 + k, "hub") for k in range(500)] + [(2003, "k7"), (None, "k1"), (None, None), (5000, None), (5001, None), (5001, "alone")] + rows[:20]
    found = graphs.groups(spark.createDataFrame(rows, ROWS).repartition(5))
    got = found.collect()
    assert len(got) == len({r.record for r in got}) and {r.record: r.group for r in got} == plain(rows)


def test_groups_of_names_and_none(spark):
    rows = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "who string, what string")
    assert sorted(map(tuple, graphs.groups(rows, "who", "what").collect())) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert graphs.groups(rows.limit(0), "who", "what").count() == 0


def test_independent_sources(spark):
    schema = "evidence_id long, url string, original_url string, original_publisher string, retracted boolean, status string"
    rows = [
        (1, "https://a.com/x?utm_source=q", None, None, None, None), (2, "https://www.a.com/y", None, None, False, "active"), (3, "https://b.com/1", "https://c.com/2", "ＡＣＭＥ", None, None),
        (4, "https://d.com/1", None, "acme", None, None), (5, "https://e.com/1", "https://c.com/2", "other", None, None), (6, "https://e.com/9", None, None, True, None), (7, "ftp://f", None, None, None, None),
        (8, "https://g.com", None, None, None, "retracted"), (9, "https://h.com/1", "https://a.com/x", "nine", None, None), (10, "https://e.com/1", None, "ten", None, None),
    ]
    found = {r.evidence_id: r.source_group for r in graphs.independent_sources(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: 1, 2: 1, 9: 1, 3: 3, 4: 3, 5: 3, 10: 3}
