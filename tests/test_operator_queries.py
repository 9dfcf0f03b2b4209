"""Registers the operator queries before ``test_oracles`` is collected, which holds each against its SQL."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import publish
from lodestone.plans import operator_queries, queries

NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == operator_queries.__name__]


def test_each_has_its_sql():
    assert len(NAMES) > 45 and set(NAMES) <= set(queries.ORACLE)


DEEP = {
    "type": "object", "required": ["items"],
    "properties": {"items": {"type": "array", "maxItems": 2, "items": {"anyOf": [{"$ref": "#/$defs/leaf"}, {"type": "null"}]}}, "at": {"type": "string", "format": "date-time"}, "n": {"type": ["integer", "null"]}},
    "$defs": {"leaf": {"type": "object", "additionalProperties": False, "required": ["a"], "properties": {"a": {"type": "object", "properties": {"b": {"type": "boolean"}}}}}},
}
CASES = [
    ({"items": []}, [], []), ({}, ["$.items: required"], ["$.items: required"]), ([], ["$: wrong type"], ["$: wrong type"]),
    ({"items": [{"a": {"b": True}}, None]}, [], []), ({"items": [1]}, ["$.items[0]: fits anyOf wrongly"], ["$.items[0]: fits anyOf wrongly"]),
    ({"items": [{"a": {"b": 1}}]}, ["$.items[0]: fits anyOf wrongly"], ["$.items[0]: fits anyOf wrongly"]), ({"items": [{"a": {}, "x": 1}]}, ["$.items[0]: fits anyOf wrongly"], []),
    ({"items": [], "at": "2026-07-14T10:00:00Z", "n": None}, [], []), ({"items": [], "at": "2026-07-14", "n": 1.5}, ["$.at: format", "$.n: wrong type"], ["$.at: format", "$.n: wrong type"]),
]


@pytest.mark.parametrize("consumer", [False, True])
def test_nested_schemas(spark, consumer):
    frame = spark.createDataFrame([(k, json.dumps(c[0])) for k, c in enumerate(CASES)] + [(99, "{")], "k int, d string")
    found = {r.k: r.p for r in frame.select("k", publish.schema_problems(F.col("d"), DEEP, consumer).alias("p")).collect()}
    assert found == {k: c[2 if consumer else 1] for k, c in enumerate(CASES)} | {99: ["$: no JSON"]}
