from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from lodestone.llm import toolcalls

EQUAL = [
    ("100", ["100.0", "1e2", "1E+2", "1.00e2", "10.0e1"]), ("0", ["0.0", "-0", "-0.0", "0e9"]), ("-1.5", ["-1.50", "-15e-1"]),
    ("0.0001", ["1e-4", "0.00010"]), ("0.0000001", ["1e-7", "1.0E-7", "0.1e-6"]), ("1e-200", ["1.0E-200", "0.1e-199"]), ("100000000000000000000", ["1e20", "1.0E20"]),
    ("10000000000000000000000", ["1e22", "1E+22"]), ("12345678901234567890123456789.5", ["12345678901234567890123456789.50"]), ("1e+200", ["1e200", "10.0E199"]),
]


def canon(spark, texts):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.c for r in frame.orderBy("k").select(toolcalls.canonical(F.col("t")).alias("c")).collect()]


def test_equal_numbers_have_one_spelling(spark):
    texts = [f'{{"x":[{n},{{"y":{n}}}]}}' for want, others in EQUAL for n in [want, *others]]
    wants = [f'{{"x":[{want},{{"y":{want}}}]}}' for want, others in EQUAL for _ in [want, *others]]
    assert canon(spark, texts) == wants


def test_strings_that_look_like_numbers_stay(spark):
    value = {"a": '1.0,"b":2.50', "b\\": "\\", 'c"1.0': "[1.0]", "z": [1.5, True, None, "\n\t\u0001 é", {"q": "\\\""}], "long": "x\"\\" * 20_000}
    found = canon(spark, [json.dumps(value), json.dumps(value, indent=2), "1e400", '{"a":-1e999}', "no", None, '"1e400"'])
    assert found[0] == found[1] and json.loads(found[0]) == value
    assert list(json.loads(found[0])) == sorted(value)
    assert found[2:] == [None, None, None, None, '"1e400"']


def value(rng, depth=3):
    kind = rng.randrange(8 if depth else 6)
    if kind < 6:
        text = "".join(rng.choices('a1.0e"\\:,[]{} \n\u00e9\u4e2d', k=rng.randrange(8)))
        number = rng.choice([rng.uniform(-1, 1), rng.uniform(-1e9, 1e9), rng.random() * 10.0 ** rng.randrange(-300, 300), float(rng.randrange(-99, 99))])
        return [None, True, False, rng.randrange(-(10**18), 10**18), number, text][kind]
    if kind == 6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choices('ab"\\.1', k=rng.randrange(5))): value(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_canonical_text_has_the_same_value_and_is_its_own_form(spark):
    rng = random.Random(11)
    values = [value(rng) for _ in range(1500)]
    once = canon(spark, [json.dumps(v) for v in values])
    long = lambda x: int(x) if len(x) < 20 else float(x)
    assert [json.loads(t, parse_int=long) for t in once] == values
    assert canon(spark, once) == once


NESTED = {
    "book": {
        "seat": ("string", True, {"enum": ["aisle", "window"]}), "bags": ("integer", False, {"minimum": 0, "maximum": 3}),
        "who": ("object", True, {"fields": {"name": ("string", True), "age": ("number", False, {"minimum": 0.5})}}),
        "legs": ("array", False, {"items": ("object", True, {"fields": {"to": ("string", True), "days": ("array", False, {"items": ("integer", True)})}})}),
        "class": ("number", False, {"enum": [1, 2.5]}), "dot.ted": ("boolean", False),
    }
}
CASES = {
    '{"seat":"aisle","who":{"name":"A"}}': [],
    '{"seat":"aisle","who":{"name":"A","age":1},"bags":3,"legs":[{"to":"X","days":[1,2]},{"to":"Y"}],"class":1.0,"dot.ted":true}': [],
    '{"seat":"floor","who":{}}': ['seat is none of "aisle", "window"', "no who.name"],
    '{"seat":"aisle","who":{"name":1,"age":0,"x":1},"bags":4}': ["bags is above 3", "who.age is below 0.5", "who.name is no string", "unknown who.x"],
    '{"seat":"aisle","who":[],"bags":-1,"class":2}': ["bags is below 0", "class is none of 1, 2.5", "who is no object"],
    '{"seat":"aisle","who":{"name":"A"},"legs":[{"to":"X","days":[1,"2","3"]},{"days":5},7,null]}': ["legs[].days[] is no integer", "legs[].days is no array", "no legs[].to", "legs[] is no object", "no legs[]"],
    '{"seat":"aisle","who":{"name":"A"},"dot.ted":1,"bags":1e400}': ["a number is out of range"],
}


def test_nested_schemas(spark):
    frame = spark.createDataFrame([("book", t) for t in CASES], "tool string, arguments string")
    found = frame.select("arguments", toolcalls.problems(frame.tool, frame.arguments, NESTED).alias("p")).collect()
    assert {r.arguments: sorted(r.p) for r in found} == {t: sorted(p) for t, p in CASES.items()}


def test_parallel_calls_share_a_step_and_no_python_runs(spark):
    rows = [("c", 0, "call", "a", "book", "{}", None, None), ("c", 1, "call", "b", "book", "{}", None, None), ("c", 2, "call", "z", "book", "{}", "a", None), ("c", 3, "result", "b", None, None, None, "x")]
    found = toolcalls.linked(spark.createDataFrame(rows, "conv string, turn long, kind string, id string, tool string, arguments string, after string, content string"), NESTED)
    assert {r.turn: r.step for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 1}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
