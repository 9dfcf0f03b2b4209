"""Tool calls in chats: linking, ordering, checking and canonical JSON, in DataFrame operations."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

#: Per tool, its fields as (type, required) or (type, required, rules); see ``problems``.
Schema = dict[str, dict[str, tuple]]
#: How VARIANT calls what JSON schemas name (fixed values).
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def depths(calls: DataFrame) -> DataFrame:
    """``calls(conv, id, after)`` to ``(conv, id, depth)``: calls that must come before.

    Pointer doubling: each round doubles how far a call sees, so a chain of n calls takes
    log2(n) joins. A call whose chain runs into a cycle gets a null depth; an ``after`` that
    names no call counts as none.
    """
    known = calls.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    state = materialise(
        calls.join(known, (F.col("conv").eqNullSafe(F.col("c"))) & (F.col("after") == F.col("i")), "left").select(
            "conv", "id", F.col("i").alias("up"), F.when(F.col("i").isNull(), 0).otherwise(1).cast("long").alias("depth")
        ),
        "depths",
    )
    longest = calls.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(longest)) + 1):
        if state.where("up is not null").isEmpty():
            break
        other = state.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = materialise(
            state.join(other, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("i")), "left").select(
                "conv", "id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            ),
            "depths",
        )
    return state.select("conv", "id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _outside_strings(text: Column, change) -> Column:
    """JSON ``text`` with ``change`` applied to every token that isn't in a string.

    Escaped backslashes and quotes are put aside as control characters, which JSON can't hold
    as such, so every quote left begins or ends a string; the work is linear in the text.
    """
    aside = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    tokens = lambda x: F.split(x, r"(?<=[\[\]{},:])|(?=[\[\]{},:])")
    parts = F.transform(F.split(aside, '"'), lambda x, i: F.when(i % 2 == 1, x).otherwise(F.array_join(F.transform(tokens(x), change), "")))
    return F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def _number(token: Column) -> Column:
    """A number's one spelling: plain digits where 38 are enough, an exponent beyond; other tokens as they are."""
    mantissa = F.regexp_extract(token, r"^-?([0-9.]+)", 1)
    exponent = F.coalesce(F.regexp_extract(token, r"[eE]\+?(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    given = F.regexp_replace(mantissa, r"\.", "")
    digits = F.regexp_replace(given, "^0+", "")
    point = F.length(whole) + exponent - (F.length(given) - F.length(digits))
    digits = F.regexp_replace(digits, "0+$", "")
    n = F.length(digits)
    short = F.greatest(point, F.lit(0)) + F.greatest(n - point, F.lit(0)) <= 38  # what VARIANT keeps exact
    plain = (
        F.when(n == 0, F.lit("0"))
        .when(short & (n <= point), F.rpad(digits, point, F.lit("0")))
        .when(short & (point > 0), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        .when(short, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(
            F.concat(
                F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""),
                F.lit("e"), F.when(point > 0, "+").otherwise(""), (point - 1).cast("string"),
            )
        )
    )
    return F.when(token.rlike("^-?[0-9]"), F.concat(F.when(token.startswith("-") & (n > 0), "-").otherwise(""), plain)).otherwise(token)


def canonical(text: Column) -> Column:
    """Canonical JSON: sorted keys, no spaces, one spelling of equal numbers; null for what is no JSON.

    Numbers given by up to 38 digits without an exponent are exact, others are doubles; those
    beyond a double's range have no canonical form and give null.
    """
    return F.when(~_overflows(text), _outside_strings(F.to_json(F.try_parse_json(text)), _number))


def _overflows(text: Column) -> Column:
    """Whether a number in JSON ``text`` is beyond the range of doubles."""
    told = _outside_strings(text, lambda x: F.when(x.rlike("^-?[0-9]") & (F.abs(x.try_cast("double")) == float("inf")), "\x03").otherwise(x))
    return F.coalesce(told.contains("\x03"), F.lit(False))


def _field_problems(got: Column, name: str, kind: str, required: bool, rules: dict) -> Column:
    """Array of what is wrong with a value, a VARIANT that is null where there is none."""
    shape = F.schema_of_variant(got)
    missing = got.isNull() | (shape == "VOID")
    found = []
    if "enum" in rules:
        allowed = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in rules["enum"]]
        found.append(F.when(~canonical(F.to_json(got)).isin(allowed), F.array(F.lit(f"{name} is none of {', '.join(allowed)}"))))
    number = F.try_variant_get(got, "$", "double")
    if "minimum" in rules:
        found.append(F.when(number < rules["minimum"], F.array(F.lit(f"{name} is below {rules['minimum']}"))))
    if "maximum" in rules:
        found.append(F.when(number > rules["maximum"], F.array(F.lit(f"{name} is above {rules['maximum']}"))))
    if "items" in rules:
        each = F.transform(F.try_variant_get(got, "$", "array<variant>"), lambda x: _field_problems(x, f"{name}[]", *_spec(rules["items"])))
        found.append(F.array_distinct(F.flatten(each)))
    if "fields" in rules:
        found.append(_object_problems(got, rules["fields"], f"{name}."))
    none = F.array().cast("array<string>")
    inner = F.concat(none, *[F.coalesce(x, none) for x in found])
    absent = F.array(F.lit(f"no {name}")) if required else none
    return F.when(missing, absent).when(~shape.rlike(f"^({KINDS[kind]})$"), F.array(F.lit(f"{name} is no {kind}"))).otherwise(inner)


def _spec(spec: tuple) -> tuple[str, bool, dict]:
    return spec[0], spec[1], spec[2] if len(spec) > 2 else {}


def _object_problems(value: Column, fields: dict[str, tuple], prefix: str = "") -> Column:
    """Problems of an object's fields in the order of their names, then its unknown fields."""
    if any("'" in f for f in fields):
        raise ValueError("names of fields can't hold an apostrophe")
    known = [_field_problems(F.try_variant_get(value, f"$['{f}']", "variant"), f"{prefix}{f}", *_spec(fields[f])) for f in sorted(fields)]
    names = F.array(*[F.lit(f) for f in sorted(fields)]).cast("array<string>")
    extra = F.transform(F.array_except(F.json_object_keys(F.to_json(value)), names), lambda k: F.concat(F.lit(f"unknown {prefix}"), k))
    return F.concat(*known, F.array_sort(extra))


def problems(tool: Column, arguments: Column, schemas: Schema) -> Column:
    """Array of what is wrong with JSON ``arguments``: empty if they fit the tool's schema.

    ``schemas`` gives each tool's fields as (type, required), with the types string, integer,
    number, boolean, array and object, or as (type, required, rules): enum (the allowed
    values), minimum, maximum, items (of an array, given like a field) and fields (of an object,
    given like a tool's), to any depth. Fields that a schema doesn't name are problems.
    """
    value = F.try_parse_json(arguments)
    checks = (
        F.when(value.isNull(), F.array(F.lit("not JSON")))
        .when(_overflows(arguments), F.array(F.lit("a number is out of range")))
        .when(~F.schema_of_variant(value).startswith("OBJECT"), F.array(F.lit("not an object")))
    )
    for name in sorted(schemas):
        checks = checks.when(tool == name, _object_problems(value, schemas[name]))
    return F.coalesce(checks.otherwise(F.array(F.lit("unknown tool"))), F.array(F.lit("unknown tool")))


def linked(messages: DataFrame, schemas: Schema) -> DataFrame:
    """Calls and results of all chats, linked, ordered and checked.

    ``messages``: conv, turn, kind (call, result or message), id (of the call made or answered),
    tool, arguments (JSON), after (id of a call that must come before), content. Returns each
    row's conv, turn, kind, id, ``step`` (topological order within the chat: calls by depth, each
    result after its call; calls that don't depend on each other share a step, null for plain
    messages and in cycles), ``status`` and ``json`` (whose ``arguments`` are ``canonical`` JSON as
    a string, or the text itself where they have no such form).

    Status: message; call: answered, unanswered, or repeated (an id that an earlier turn
    used; it links to nothing); result: linked, orphan; and invalid for a call that is answered
    or not but whose arguments don't fit. Calls and results meet in a hash join by chat and id, so a
    huge chat spreads over tasks. Null ids link to nothing. Repeated rows are repeated calls.
    """
    rows = messages.select("conv", "turn", "kind", "id", "tool", "arguments", "after", "content", F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "messages")
    calls = rows.where("kind = 'call' and id is not null")
    first = calls.groupBy("conv", "id").agg(F.min_by(F.struct("row", "after"), F.struct("turn", "row")).alias("at"))
    first = materialise(first.select("conv", "id", F.col("at.row").alias("call_row"), F.col("at.after").alias("after")), "calls")
    depth = depths(first.select("conv", "id", "after"))
    answers = rows.where("kind = 'result' and id is not null").groupBy("conv", "id").agg(F.count("*").alias("answers"))
    key = lambda x, y: x["conv"].eqNullSafe(y["conv"]) & (x["id"] == y["id"])
    link = (
        first.join(depth, key(first, depth), "left")
        .select(first["conv"], first["id"], "call_row", "depth")
        .alias("f")
        .join(answers.alias("a"), F.col("f.conv").eqNullSafe(F.col("a.conv")) & (F.col("f.id") == F.col("a.id")), "left")
        .select(F.col("f.conv").alias("c"), F.col("f.id").alias("i"), "call_row", "depth", "answers")
    )
    link = materialise(link, "links")
    joined = rows.join(link.hint("shuffle_hash"), rows.conv.eqNullSafe(link.c) & (rows.id == link.i), "left")
    wrong = F.when(F.col("kind") == "call", problems(F.col("tool"), F.col("arguments"), schemas))
    own = F.col("row") == F.col("call_row")
    status = (
        F.when(F.col("kind") == "result", F.when(F.col("call_row").isNull(), "orphan").otherwise("linked"))
        .when(F.col("kind") != "call", "message")
        .when(F.col("id").isNotNull() & ~own, "repeated")
        .when(F.size("problems") > 0, "invalid")
        .when(F.col("answers") > 0, "answered")
        .otherwise("unanswered")
    )
    step = F.when(
        ((F.col("kind") == "call") & own) | (F.col("kind") == "result"),
        2 * F.col("depth") + (F.col("kind") == "result").cast("long"),
    )
    body = F.struct(
        F.when(F.col("kind") == "call", F.coalesce(canonical(F.col("arguments")), F.col("arguments"))).alias("arguments"),
        F.when(F.col("kind") != "call", F.col("content")).alias("content"),
        F.col("id"),
        F.col("kind"),
        F.when(F.size("problems") > 0, F.col("problems")).alias("problems"),
        F.col("tool"),
    )
    return (
        joined.withColumn("problems", wrong)
        .withColumn("status", F.coalesce(status, F.lit("message")))
        .select("conv", "turn", "kind", "id", step.alias("step"), "status", F.to_json(body).alias("json"))
    )


def chat_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain chats as calls: each user turn calls ``reply``, the next turn is the result.

    A call depends on the call two turns before it, if there is one; other roles are messages.
    """
    c, t = F.col(conv).cast("string"), F.col(turn).cast("long")
    call, result = F.col(role) == "user", F.col(role) == "assistant"
    name = lambda n: F.concat_ws("-", F.lit("call"), c, n.cast("string"))
    arguments = F.to_json(F.struct(F.col(text).alias("prompt"), t.alias("turn")), {"ignoreNullFields": "false"})
    return turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.when(call, "call").when(result, "result").otherwise("message").alias("kind"),
        F.when(t.isNull(), F.lit(None)).when(call, name(t)).when(result, name(t - 1)).alias("id"),
        F.when(call, "reply").alias("tool"),
        F.when(call, arguments).alias("arguments"),
        F.when(call & t.isNotNull(), name(t - 2)).alias("after"),
        F.col(text).alias("content"),
    )


#: The tool that plain chats call.
REPLY: Schema = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
