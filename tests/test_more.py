from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from lodestone.operators import claims, discovery, publish, state
from lodestone.sources import comments

TREE = {
    "data": {"comments": [
        {"cid": "1", "text": "top", "user": {"nickname": "a"}, "create_time": 1752451200, "reply_comment": [{"cid": "2", "content": {"text": "reply"}, "author": {"id": "9", "text": "not a comment"}}]},
        {"comment_id": "3", "body": "says", "parent_id": "t1_1"}, {"text": "no sign"}, {"id": "post", "text": "the post itself"}, {"text": "anonymous", "created_at": "2026-01-01"},
    ], "has_more": 1, "cursor": 20, "total": 44}
}


def test_nested_comments(spark):
    frame = spark.createDataFrame([("tiktok", "tiktok:post", json.dumps(TREE)), ("x", "p", "bad"), ("x", "p", None)], "source string, post_id string, response string")
    found = {r.source_item_id: r for r in comments.extracted(frame).collect()}
    assert set(found) >= {"1", "2", "3"} and len(found) == 4
    assert (found["2"].parent_comment_id, found["3"].parent_comment_id, found["1"].parent_comment_id) == ("1", "1", None)
    assert found["2"].pointer == "/data/comments/0/reply_comment/0" and found["1"].author == "a" and found["1"].published_at == datetime(2025, 7, 14)


def test_paging(spark):
    nested = json.dumps({"data": {"data": {"hasMore": False, "nextCursor": "z"}}, "total": -1})
    frame = spark.createDataFrame([(json.dumps(TREE),), (nested,), ("bad",)], "v string").select(comments.paging(F.col("v")).alias("p"))
    assert [tuple(r.p) for r in frame.collect()] == [("20", True, 44), ("z", False, None), (None, None, None)]
    pages = spark.createDataFrame(
        [("a", 1, "f1", "c", True, ["1", "2"]), ("a", 2, "f2", "d", True, ["2", "3"]), ("b", 1, "f1", None, False, ["1"]), ("c", 1, "f1", "x", True, ["1"]), ("c", 2, "f1", "x", True, ["1"]), ("d", 1, "f1", "x", True, ["1"]), ("d", 2, "f2", "y", True, ["1"])],
        "post_id string, page int, fingerprint string, cursor string, has_more boolean, comment_ids array<string>",
    )
    found = {r.post_id: (r.comments, r.state, r.next_cursor) for r in comments.page_state(pages).collect()}
    assert found == {"a": (3, "continue", "d"), "b": (1, "complete", None), "c": (1, "repeated_request", None), "d": (1, "no_new_comments", None)}


def test_comment_candidates(spark):
    rows = [("1", "xiaohongshu", "u", {"note_id": "n", "note_type": "Video"}), ("2", "xiaohongshu", "u", {"note_id": "n"}), ("3", "zhihu", "u", {"answer_id": "a"}), ("4", "zhihu", "u", {"article_id": "a"}), ("5", "tiktok", "u", {"aweme_id": "t"}), ("6", "tiktok", "u", {})]
    found = {r.selected_item_id: (r.content_type, r.identifiers) for r in comments.candidates(spark.createDataFrame(rows, "id string, source string, url string, identifiers map<string,string>")).collect()}
    assert found == {"1": ("video_note", {"note_id": "n"}), "3": ("answer", {"answer_id": "a"}), "5": (None, {"aweme_id": "t"})}


def test_experiments_and_signals(spark):
    d = date(2026, 7, 1)
    rows = [("x", d, d, "running", None, 1), ("x", date(2026, 7, 3), d, "completed", "sold 3", 1), ("y", d, d, "completed", " ", 1), ("z", date(2026, 8, 1), d, "completed", "o", 1)]
    frame = spark.createDataFrame(rows, "experiment_id string, as_of date, observed_at date, status string, outcome string, traceable_evidence int")
    assert {r.experiment_id: r.usable_for_priority for r in state.experiments(frame, F.lit(date(2026, 7, 14))).collect()} == {"x": True, "y": False}
    signals = spark.createDataFrame([("r", 1, "e1", None, ["f"]), ("r", 2, "e2", "v2", ["new"]), ("r", 3, "e2", "v1", ["new"]), ("r", 4, "e2", "v2", ["old"]), ("r", 5, "e3", "v1", ["f"])], "record_id string, signal_no int, evidence_id string, evidence_revision_id string, facts array<string>")
    revisions = spark.createDataFrame([("r", "e1", "v1", 1, False, ["f"]), ("r", "e2", "v2", 2, False, ["new", "x"]), ("r", "e3", "v1", 1, True, ["f"])], "record_id string, evidence_id string, revision_id string, version int, retracted boolean, facts array<string>")
    assert sorted(r.signal_no for r in state.supported_signals(signals, revisions).collect()) == [1, 2]


def test_packets_and_indexes(spark):
    items = spark.createDataFrame([("e", "r", "t" * 300, "same", "same", "own", "raw")], "evidence_id string, revision_id string, title string, original_text string, text string, fact string, raw_file string")
    row = claims.compact(items).first()
    assert len(row.title) == 200 and row.text is None and row.fact == "own" and "raw_file" not in row
    frame = spark.createDataFrame([(None, 0, 0), ("why", 2, 2), ("why", 2, 1)], "r string, n int, l int").select(claims.basis(F.col("r"), F.col("n"), F.col("l")).alias("b"))
    assert [tuple(r.b) for r in frame.collect()] == [("missing", ["rationale", "evidence_refs"]), ("located", []), ("invalid", [])]
    evidence = spark.createDataFrame([("a", "r", "active", "relevant"), ("b", "r", "needs_review", "relevant"), ("c", "r", "active", "not_reviewed"), ("d", "r", "active", "relevant")], "evidence_id string, revision_id string, derivation_status string, semantic_status string")
    found = {r.evidence_id: r.review_reason for r in claims.evidence_index(evidence, evidence.where("evidence_id = 'a'")).collect()}
    assert found == {"a": None, "b": "derivation_review", "c": "semantic_review", "d": "not_in_packet"}


def test_contracts(spark):
    frame = spark.createDataFrame([('{"id":1,"x":2}',), ('{"id":1,"title":"t","note":""}',), ("[]",)], "v string")
    assert [r[0] for r in frame.select(publish.contract_problems(F.col("v"), ["id", "title"], ["note"])).collect()] == [["no title", "unknown x"], [], ["no object"]]
    items = spark.createDataFrame([("i", [("e", "r1"), ("e", "r2")], ["a", "b"])], "item_id string, refs array<struct<id:string,revision_id:string>>, industry_ids array<string>")
    evidence = spark.createDataFrame([("e", "r1", "text")], "id string, revision_id string, body string")
    assert [r.revision_id for r in publish.dangling(items, evidence).collect()] == ["r2"]
    assert [r.body for r in publish.with_evidence(items, evidence).collect()] == ["text"]
    assert publish.in_scope(items, ["b", "c"]).first().industry_ids == ["b"] and publish.in_scope(items, ["z"]).count() == 0
    a, b = spark.createDataFrame([(1, 2), (3, 4)], "k int, n int"), spark.createDataFrame([(1, 2), (3, 5)], "k int, n int")
    assert sorted((r.k, r.n, r.side) for r in publish.report_differences(a, b).collect()) == [(3, 4, "stated"), (3, 5, "computed")]


def test_verified_candidates_and_fallbacks(spark):
    found = discovery.merged_candidates(spark.createDataFrame([("https://x.com/a/status/5", "p", "q"), ("https://h.org/a", "p", "q")], "url string, provider string, query string"))
    evidence = spark.createDataFrame([("e1", "r", "https://twitter.com/b/status/5", "the words", "words", "opened_page", None), ("e2", "r", "https://h.org/a", "text", "absent", "opened_page", None), ("e3", "r", "https://h.org/a", "text", "text", "search", None)], "evidence_id string, revision_id string, url string, original_text string, supporting_quote string, method string, retracted boolean")
    assert {r.key: r.verified for r in discovery.verified_candidates(found, evidence).collect()} == {"x:5": True, "https://h.org/a": False}
    requests = spark.createDataFrame([("r1", "a", "g", "s", "k")], "id string, source string, query_group string, query_scope string, keyword string")
    alternatives = spark.createDataFrame([("r2", "b", "g", "s", "k"), ("r3", "b", "g", "other", "k"), ("r4", "a", "g", "s", "k")], requests.schema)
    assert [r.fallback_id for r in discovery.fallbacks(requests, alternatives).collect()] == ["r2"]
