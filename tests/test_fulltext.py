from __future__ import annotations

import random
from collections import Counter

import pytest

from lodestone.operators import retrieval
from lodestone.sources.fulltext import BUCKETS, FullTextIndex

ROWS = "evidence_id long, revision_id string, body string"


def corpus(n=300):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["the"] * 30
    rows = [(k % 120, f"r{k}", " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(n)]
    return [*rows, (500, "r", None), (501, "r", "Über-größe THE the w1 w2")]


def made(spark, path, parts):
    index = FullTextIndex(spark, str(path), ["evidence_id", "revision_id"])
    for p in parts:
        index.add(spark.createDataFrame(p, ROWS), "body")
    return index


def ranked(found):
    return {(r.evidence_id, r.revision_id): round(r.score, 9) for r in found.collect()}


def test_additions_and_merges_equal_one_build_and_the_unstored_search(spark, tmp_path):
    rows = corpus()
    whole = made(spark, tmp_path / "a", [rows])
    parts = made(spark, tmp_path / "b", [rows[:100], rows[50:220] + rows[:3], rows[200:], rows])
    assert [s["texts"] for s in parts.segments()] == [100, 120, 82, 0] and parts.version() == 4
    docs = spark.createDataFrame(rows, ROWS).withColumnRenamed("revision_id", "key")
    for terms in (["the", "w1"], ["w3"], ["the", "w5", "w7"], ["größe"], ["nowhere", "the"]):
        index, n, mean = retrieval.looked_up(docs, "key", "body", terms)
        want = {r.key: round(r.score, 9) for r in retrieval.bm25(index, "key", terms, n, mean).collect() if r.key != "r"}
        assert {k[1]: v for k, v in ranked(whole.search(terms)).items() if k[1] != "r"} == want
        assert ranked(parts.search(terms)) == ranked(whole.search(terms))
    before = ranked(parts.search(["the", "w1"]))
    assert parts.merge(2) == 5 and len(parts.segments()) == 2 and parts.merge(2) == 5
    assert ranked(parts.search(["the", "w1"])) == before == ranked(parts.search(["the", "w1"], version=3))
    assert parts.vacuum() == 3 and ranked(parts.search(["the", "w1"])) == before


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = made(spark, tmp_path, [corpus()])
    found = index.postings(["w3"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,w3)]" in plan
    found.collect()
    metrics = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics())
    assert metrics["numPartitions"].value() == 1 < len(Counter(r.bucket for r in index._union(index.segments(), "postings").collect())) <= BUCKETS


def test_what_holds_as_of_a_day_is_a_filter_when_read(spark, tmp_path):
    rows = [(1, "old", "red fox"), (1, "new", "red hen"), (2, "only", "red fox")]
    index = made(spark, tmp_path, [rows])
    assert set(ranked(index.search(["fox"]))) == {(1, "old"), (2, "only")}
    now = spark.createDataFrame([(1, "new"), (2, "only"), (2, "only")], "evidence_id long, revision_id string")
    assert set(ranked(index.search(["fox"], now))) == {(2, "only")} and set(ranked(index.search(["red"], now))) == {(1, "new"), (2, "only")}


def test_edges(spark, tmp_path):
    index = FullTextIndex(spark, str(tmp_path / "x"), ["evidence_id", "revision_id"])
    with pytest.raises(LookupError):
        index.search(["a"])
    with pytest.raises(ValueError, match="no key"):
        index.add(spark.createDataFrame([(None, "r", "a")], ROWS), "body")
    index.add(spark.createDataFrame([], ROWS), "body")
    index.add(spark.createDataFrame([(1, "r", None), (2, "r", "long " * 50_000)], ROWS), "body")
    assert set(ranked(index.search(["long"]))) == {(2, "r")} and ranked(index.search(["short"])) == {}
    late = FullTextIndex(spark, str(tmp_path / "x"), ["evidence_id", "revision_id"])
    with pytest.raises(RuntimeError, match="there already"):
        late._commit([], 2)
    assert late.version() == 2


def test_a_merge_with_empty_segments_rewrites_nothing(spark, tmp_path):
    index = FullTextIndex(spark, f"file://{tmp_path}/index", ["k"])
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "k int, t string")
    for _ in range(2):
        index.add(docs, "t")
    first = [s["name"] for s in index.segments() if s["texts"]]
    index.merge(1)
    assert [s["name"] for s in index.segments()] == first
    assert sorted(r.k for r in index.search(["b"]).collect()) == [1, 2]
