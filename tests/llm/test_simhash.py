from __future__ import annotations

import itertools

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.components import connected_components
from tests.llm.documents import SCHEMA, table


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB \n\té", max_size=60))
def test_fingerprint_equals_the_plain_form(text):
    assert simhash.simhash64(text) == plain(text)


def test_segments_cover_every_pair_within_the_radius():
    for radius, parts in itertools.product(range(6), range(1, 6)):
        plan = simhash.segments(radius, parts)
        assert sum(w for _, w, _ in plan) == 64
        for split in itertools.product(range(radius + 1), repeat=parts):
            if sum(split) <= radius:
                assert any(d <= r for d, (_, _, r) in zip(split, plan, strict=True))


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))]
    chain = [(k * 7919 % 1000 + 100, (k + 1) * 7919 % 1000 + 100) for k in range(60)]
    frame = spark.createDataFrame([*edges, *chain, (None, 3)], "a long, b long")
    found = {r.node: r.root for r in connected_components(frame).collect()}
    nodes = {n for e in edges + chain if e[0] != e[1] for n in e}
    want = groups(edges + chain, nodes | {n for e in edges for n in e})
    assert set(found) == nodes
    assert {(want[a] == want[b]) == (found[a] == found[b]) for a, b in itertools.combinations(sorted(nodes), 2)} == {True}


def test_links_of_dense_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 20)
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 50)}
    for base in list(prints)[:3]:
        for _ in range(60):
            flips = rng.choice(63, rng.integers(1, 6), replace=False)
            prints.add(base ^ int(sum(1 << int(f) for f in flips)))
    prints = sorted(prints)
    mask = (1 << 64) - 1
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & mask).bit_count() <= 4]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    two = groups([tuple(r) for r in simhash.near_links(frame.limit(40), parts=2).collect()], prints)
    some = [r.fp for r in frame.limit(40).collect()]
    plain_some = groups([(a, b) for a, b in near if a in some and b in some], prints)
    assert all((two[a] == two[b]) == (plain_some[a] == plain_some[b]) for a, b in itertools.combinations(some, 2))
    links = [tuple(r) for r in simhash.near_links(frame).collect()]
    want, found = groups(near, prints), groups(links, prints)
    assert all((want[a] == want[b]) == (found[a] == found[b]) for a, b in itertools.combinations(prints, 2))


def test_near_duplicates_equal_brute_force(spark):
    docs = table(spark)
    data = docs.collect()
    prints = {r.text: plain(r.text) for r in data}
    distinct = sorted(set(prints.values()))
    group = groups([(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 4], distinct)
    least = {}
    for r in data:
        g = group[prints[r.text]]
        least[g] = min(x for x in (least.get(g), r.doc_id) if x is not None) if least.get(g) is not None or r.doc_id is not None else None
    want = sorted(((r.doc_id is None, r.doc_id or 0), f"{prints[r.text]:016x}", least[group[prints[r.text]]]) for r in data)
    found = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in found) == want


def test_one_row_of_each_group_stays(spark):
    docs = table(spark)
    groups_ = simhash.near_duplicates(docs).select("component_id").distinct().count()
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == groups_
    assert kept.where(F.col("doc_id").isNull()).count() <= 1


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0
