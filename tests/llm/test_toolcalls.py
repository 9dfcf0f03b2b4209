from __future__ import annotations

import json

from lodestone.llm import toolcalls

MESSAGES = "conv string, turn long, kind string, id string, tool string, arguments string, after string, content string, status string"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "flag": {"on": ("boolean", True), "of": ("array", False)}}


def chat(conv, *rows):
    return [(conv, k, *r, "clash") for k, r in enumerate(rows)]


def run(spark, rows):
    found = toolcalls.linked(spark.createDataFrame(rows, MESSAGES), SCHEMAS).collect()
    return {(r.conv, r.turn): r for r in found}, found


def test_linking_order_and_status(spark):
    rows = chat(
        "x",
        ("message", None, None, None, None, "hello"),
        ("result", "c2", None, None, None, "early"),
        ("call", "c2", "add", '{"b": 2.5, "a": 1}', "c1", None),
        ("call", "c1", "flag", '{"on": true, "of": [1, 2]}', None, None),
        ("result", "nobody", None, None, None, "lost"),
        ("call", "c1", "flag", '{"on": false}', None, None),
        ("call", "c3", "add", '{"a": "one", "z": 1}', "c2", None),
        ("call", None, "add", None, None, None),
        ("call", "l1", "flag", '{"on": true}', "l2", None),
        ("call", "l2", "flag", '{"on": true}', "l1", None),
    ) + chat(None, ("call", "c1", "flag", '{"on": true}', "gone", None), ("result", "c1", None, None, None, None))
    by, _ = run(spark, rows)
    status = [by["x", k].status for k in range(10)]
    assert status == ["message", "linked", "answered", "unanswered", "orphan", "repeated", "invalid", "invalid", "unanswered", "unanswered"]
    assert [by["x", k].step for k in range(10)] == [None, 3, 2, 0, None, None, 4, None, None, None]
    assert by[None, 0].status == "answered" and by[None, 1].step == 1
    bad = json.loads(by["x", 6].json)
    assert bad["problems"] == ["a is no integer", "no b", "unknown z"]
    assert json.loads(by["x", 2].json)["arguments"] == '{"a":1,"b":2.5}'  # canonical
    for r in by.values():
        assert list(json.loads(r.json)) == sorted(json.loads(r.json))


def test_problems(spark):
    cases = {
        ("add", '{"a":1,"b":2}'): [], ("add", "[1]"): ["not an object"], ("add", "{"): ["not JSON"], ("add", None): ["not JSON"],
        ("add", '{"a":null,"b":1,"note":5}'): ["no a", "note is no string"], ("flag", '{"on":"yes"}'): ["on is no boolean"],
        ("other", "{}"): ["unknown tool"], (None, "{}"): ["unknown tool"], ("flag", '{"on":true,"of":{}}'): ["of is no array"],
    }
    frame = spark.createDataFrame(list(cases), "tool string, arguments string")
    found = frame.select("tool", "arguments", toolcalls.problems(frame.tool, frame.arguments, SCHEMAS).alias("p")).collect()
    assert {(r.tool, r.arguments): r.p for r in found} == cases


def test_long_chains_take_few_rounds(spark):
    n = 70
    rows = [("c", f"k{k}", f"k{k - 1}" if k else None) for k in range(n)]
    found = toolcalls.depths(spark.createDataFrame(rows, "conv string, id string, after string")).collect()
    assert {r.id: r.depth for r in found} == {f"k{k}": k for k in range(n)}


def test_plain_chats(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", None), (1, 3, "system", "s"), (2, 0, "assistant", "x"), (None, None, None, None)],
        "conv_id long, turn long, role string, text string",
    )
    found = toolcalls.linked(toolcalls.chat_messages(turns), toolcalls.REPLY).collect()
    status = {(r.conv, r.turn): r.status for r in found}
    assert status == {(1, 0): "answered", (1, 1): "linked", (1, 2): "invalid", (1, 3): "message", (2, 0): "orphan", (None, None): "message"}


def test_no_messages(spark):
    assert toolcalls.linked(spark.createDataFrame([], MESSAGES), SCHEMAS).count() == 0
