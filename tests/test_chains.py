"""Revision chains of hot, null and single-row keys, against a plain model."""

import random

from lodestone.operators import state


def chain(rows):
    """By key in order: what differs from the row before it, with version and what it supersedes."""
    found, before, last, version = [], {}, {}, {}
    for key, at, revision, content in sorted(rows, key=lambda r: r[1]):
        if before.get(key) != content:
            version[key] = version.get(key, 0) + 1
            found.append((key, revision, version[key], last.get(key)))
            last[key] = revision
        before[key] = content
    return sorted(found, key=str)


def test_chain_of_a_hot_key_and_of_null(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b", f"k{n}"]), n, f"R{n}", rng.choice("xy")) for n in range(300)]
    frame = spark.createDataFrame(rows, "id string, at int, revision_id string, content string").repartition(5)
    found = state.revision_chain(frame, "id", ["at"], "content").select("id", "revision_id", "version", "supersedes").collect()
    assert sorted((tuple(r) for r in found), key=str) == chain(rows)


def test_chain_of_nothing(spark):
    assert state.revision_chain(spark.createDataFrame([], "id string, at int, revision_id string, content string"), "id", ["at"], "content").count() == 0
