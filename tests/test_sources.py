from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import functions as F

import __spark_entry__
from lodestone.plans import catalog
from lodestone.sources import readers, social
from lodestone.streaming import ingest

RESPONSES = "source string, request_id string, query_group string, observed_at date, response string"
DAY = date(2026, 7, 14)


def response(source, body):
    return (source, f"req-{source}", "g", DAY, body if isinstance(body, str) or body is None else json.dumps(body))


BODIES = {
    "tiktok": {"search_item_list": [{"aweme_info": {"aweme_id": "1", "desc": "d", "create_time": 1752451200, "author": {"unique_id": "u"}, "statistics": {"digg_count": "1,234"}, "share_url": "https://t/1"}}, {"other": 1}]},
    "douyin": {"business_data": [{"data": {"aweme_info": {"aweme_id": "2", "desc": "中文"}}}]},
    "instagram": {"data": {"items": [{"id": "3", "code": "abc", "caption": {"text": "cap <b>x</b>"}, "taken_at": "2025-07-14"}]}},
    "linkedin": {"data": [{"id": "4", "title": "post", "url": "https://l/4", "activity": {"likes": 3}}]},
    "threads": {"searchResults": {"edges": [{"node": {"id": "5", "text": "t", "user": {"username": "me"}}}, {"thread_items": [{"post": {"pk": "6", "caption": {"text": "c"}}}]}]}},
    "twitter": {"timeline": [{"tweet_id": "7", "screen_name": "me", "text": "hi", "lang": "en", "favorites": 2}]},
    "youtube": {"videos": [{"video_id": "8", "title": "v", "published_time": "2 days ago"}]},
    "reddit": {"search": {"dynamic": {"components": {"main": {"edges": [{"node": {"id": "t3_9", "title": "r", "permalink": "/r/x/9", "score": 5}}, {"presentation": {"type": "empty_state"}}]}}}}},
    "xiaohongshu": {"data": {"items": [{"note": {"id": "10", "title": "笔记", "liked_count": "12"}}]}},
    "bilibili": {"result": [{"bvid": "BV1", "title": "b", "play": 7}]},
    "zhihu": {"data": [{"object": {"id": "11", "title": "z", "voteup_count": 1}}, {"query_list": []}]},
    "wechat_search": {"items": [{"docID": "12", "title": "w", "doc_url": "https://w/12"}]},
    "hackernews": {"hits": [{"objectID": "13", "title": "Show &amp; tell", "created_at": "2026-07-01T00:00:00Z", "points": 4}]},
    "github": {"items": [{"id": 14, "html_url": "https://github.com/a/b/issues/1", "title": "bug", "body": "text", "user": {"login": "me"}}]},
}


def test_every_source_is_normalised(spark):
    frame = spark.createDataFrame([response(s, b) for s, b in BODIES.items()], RESPONSES)
    found = {r.id: r for r in social.normalised(frame).collect()}
    assert set(found) == {f"{s}:{k}" for s, k in zip(["tiktok", "douyin", "instagram", "linkedin", "threads", "threads", "twitter", "youtube", "reddit", "xiaohongshu", "bilibili", "zhihu", "wechat_search", "hackernews", "github"], ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "BV1", "11", "12", "13", "14"], strict=True)}
    assert found["tiktok:1"].engagement == {"likes": 1234.0} and found["tiktok:1"].published_at == datetime(2025, 7, 14)
    assert found["douyin:2"].language == "zh" and found["instagram:3"].original_text == "cap x" and found["instagram:3"].url == "https://www.instagram.com/p/abc/"
    assert found["youtube:8"].published_at is None and tuple(map(str, found["youtube:8"].published_at_interval)) == ("2026-07-11", "2026-07-12")
    assert found["reddit:9"].url == "https://www.reddit.com/r/x/9" and found["hackernews:13"].title == "Show & tell"
    assert found["threads:6"].original_text == "c" and found["threads:6"].url is None and "no address" in found["threads:6"].warnings
    assert found["twitter:7"].url == "https://x.com/me/status/7" and found["github:14"].author == "me"


def test_parse_states(spark):
    frame = spark.createDataFrame(
        [response("tiktok", BODIES["tiktok"]), response("twitter", {"timeline": []}), response("youtube", {"unknown": 1}), response("bilibili", "not json"), response("zhihu", BODIES["zhihu"]), response("linkedin", BODIES["linkedin"]), response("github", None)], RESPONSES
    )
    found = {r.source: (r.parse_status, r.raw_items, r.parsed_items) for r in social.parse_status(frame).collect()}
    assert found == {"tiktok": ("partial_parse", 2, 1), "twitter": ("empty_result", 0, 0), "youtube": ("unrecognized_response", None, 0), "bilibili": ("unrecognized_response", None, 0), "zhihu": ("parsed", 1, 1), "linkedin": ("parsed", 1, 1), "github": ("unrecognized_response", None, 0)}


def test_comment_trees(spark):
    tree = {"children": [{"id": 1, "text": "top", "author": "a", "children": [{"id": 2, "text": "reply", "children": [{"id": 3, "text": "deep"}]}, {"id": 4, "text": "gone", "dead": True, "children": [{"id": 5, "text": "stays"}]}]}, {"id": 6, "text": ""}]}
    found = {r.id: (r.parent_id, r.depth) for r in social.comment_tree(spark, spark.createDataFrame([("p", json.dumps(tree)), ("q", "bad")], "payload_id string, response string"), depth=4).collect()}
    assert found == {"1": (None, 1), "2": ("1", 2), "3": ("2", 3), "5": ("4", 3)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nbroken\n{"id": 2}\n')
    found = sorted((r.line_no, r.problem) for r in readers.lines(spark, str(tmp_path / "a.jsonl")).collect())
    assert found == [(1, None), (3, "not JSON"), (4, None)]
    (tmp_path / "b.json").write_text(json.dumps({"run_id": "RUN-1", "evidence": [{"id": "x"}, {"id": "y", "run_id": "RUN-2"}]}))
    (tmp_path / "c.json").write_text("x" * 100)
    docs = readers.documents(spark, f"{tmp_path}/*.json", most_bytes=99)
    assert sorted((r.bytes, r.problem) for r in docs.collect())[1] == (100, "too large")
    rows = sorted((r.record_no, r.run_id, r.run_conflict) for r in readers.records(docs.where("problem is null")).collect())
    assert rows == [(0, "RUN-1", False), (1, "RUN-2", True)]
    both = readers.records(spark.createDataFrame([("1", '[{"a":1},{"a":2}]'), ("2", '{"a":3}'), ("3", "bad")], "k string, text string"))
    assert sorted((r.k, r.record) for r in both.collect()) == [("1", '{"a":1}'), ("1", '{"a":2}'), ("2", '{"a":3}')]


def test_page_import(spark):
    schema = "row_no int, source string, url string, original_url string, title string, original_text string, supporting_quote string, evidence_role string, method string, published_at string"
    rows = [(1, "web", "https://h/a", None, "t", "the quote here", "quote", "official_pricing", "opened_page", None), (2, "web", "https://h/a", None, "t", "the quote here", "quote", "official_pricing", "opened_page", "2026-01-01"), (3, "web", "https://h/b", None, "t", "text", "quote", "other", "search", None)]
    found = {r.row_no: (r.problems, r.duplicate) for r in readers.imported_pages(spark.createDataFrame(rows, schema), ["official_pricing"]).collect()}
    assert found == {1: ([], False), 2: ([], True), 3: (["unknown role", "quote not in text", "not opened"], False)}


def test_bundles(spark, tmp_path):
    items = spark.createDataFrame([("1", "t", "secret"), ("2", "u", "x")], "id string, title string, body string")
    readers.public_bundle(items, str(tmp_path), ["id", "title"])
    assert spark.read.json(f"{tmp_path}/index").columns == ["id", "title"] and spark.read.json(f"{tmp_path}/full").count() == 2
    assert spark.read.json(f"{tmp_path}/items/_part=2").first().title == "u"


def test_catalogue_and_rotation(spark):
    sources = catalog.registry(spark)
    assert sources.count() == 27
    assert {r.source for r in catalog.routed(sources, F.lit("en-US")).collect()} & {"douyin", "hackernews"} == {"hackernews"}
    states = {r.source: r.configuration_status for r in catalog.diagnosed(sources, F.lit(False)).collect()}
    assert states["web"] == "manual_import_only" and states["tiktok"] == "missing_required_config" and states["github"] == "configuration_ready"
    days = spark.createDataFrame([(date(2026, 7, 14),), (date(2026, 7, 15),)], "d date")
    found = [r[0] for r in days.orderBy("d").select(catalog.source_of_day(F.col("d"), ["a", "b", "c"])).collect()]
    assert found == ["abc"[date(2026, 7, 14).toordinal() % 3], "abc"[date(2026, 7, 15).toordinal() % 3]]
    tasks = spark.createDataFrame([("t", "entry", 0, "e0"), ("t", "subtrack", 0, "s0"), ("t", "subtrack", 1, "s1"), ("t", "entry", 1, "e1"), ("t", "subtrack", 2, "s2")], "topic string, list string, n int, task_id string")
    assert [r.task_id for r in catalog.interleaved(tasks, "topic").orderBy("slot").collect()] == ["e0", "s0", "e1", "s1", "s2"]
    products = spark.createDataFrame([("App", "do x", ["App"], ["twitter", "douyin"])], "name string, task string, aliases array<string>, sources array<string>")
    angles = spark.createDataFrame([("use", "体验", "review", "user"), ("price", "价格", "pricing", "official")], "angle string, zh string, en string, role string")
    intents = sorted((r.source, r.search_query) for r in catalog.product_intents(products, angles).collect())
    assert intents == [("douyin", "App 价格"), ("douyin", "App 体验"), ("twitter", "App pricing"), ("twitter", "App review")]


def test_streams_take_each_event_once_and_hold_back_the_future(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long"
    rows = [(k, datetime(2026, 7, 1 + k % 5), k % 3) for k in range(20)]
    events = spark.createDataFrame(rows, schema)
    events.write.parquet(f"{tmp_path}/in/1")
    events.union(spark.createDataFrame([(99, datetime(2030, 1, 1), 0)], schema)).write.parquet(f"{tmp_path}/in/2")
    late = lambda b: b.where("ts > timestamp '2027-01-01'")
    query = ingest.ingest(ingest.observations(spark, f"{tmp_path}/in/*", schema, 1), f"{tmp_path}/log", f"{tmp_path}/q", f"{tmp_path}/c", late)
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/log").collect()) == list(range(20))
    assert [r.event_id for r in spark.read.parquet(f"{tmp_path}/q").collect()] == [99]


def test_days_close_with_the_watermark(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long"
    spark.createDataFrame([(k, datetime(2026, 7, 1 + k), 0) for k in range(5)], schema).write.parquet(f"{tmp_path}/in")
    stream = ingest.daily(ingest.once(ingest.observations(spark, f"{tmp_path}/in", schema), "event_id"), "ts", "user_id")
    query = stream.writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    found = sorted(str(r.day) for r in spark.table("days").collect())
    assert found and found == [f"2026-07-0{k + 1}" for k in range(len(found))]


def test_entry_and_queries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
