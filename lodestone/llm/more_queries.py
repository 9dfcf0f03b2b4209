"""Queries beside those of the operators: chats whose calls break rules, and licences that directories hand down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import license_scan, toolcalls

#: What the calls of ``tool_call_faults`` must look like.
SEARCH: toolcalls.Schema = {"search": {"kind": ("string", True, {"enum": ["question", "statement"]}), "length": ("integer", True, {"maximum": 240}), "prompt": ("string", True)}}
#: How licences are called in the texts of ``license_inheritance``.
CALLED = "MIT License|Apache License|CC BY-NC|CC BY|CC0|GNU|BSD|Mozilla"


def tool_call_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats in which calls repeat ids, break their schema or stay unanswered, and answers answer nothing.

    A user's turn calls ``search`` by an id of its length in sixties, after the call of the length
    below; an assistant's turn answers the id of its length in 250s, whichever that is. Texts that
    are too long, end without a full stop or have several lines break the schema. Missing texts have no id.
    """
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text, n = F.col("text"), F.length("text")
    call, result = F.col("role") == "user", F.col("role") == "assistant"
    bucket = F.when(call, F.floor(n / 60)).when(result, F.floor(n / 250))
    name = lambda b: F.concat(F.lit("q"), F.col("conv_id").cast("string"), F.lit("-"), b.cast("string"))
    kind = F.when(text.endswith("."), "statement").otherwise(F.when(text.isNotNull(), "fragment"))
    lines = F.when(text.contains("\n"), F.size(F.split(text, "\n")))
    messages = chats.select(
        F.col("conv_id").alias("conv"), "turn", F.when(call, "call").when(result, "result").otherwise("message").alias("kind"), name(bucket).alias("id"), F.when(call, "search").alias("tool"),
        F.when(call, F.to_json(F.struct(kind.alias("kind"), n.alias("length"), lines.alias("lines"), text.alias("prompt")))).alias("arguments"), F.when(call, name(bucket - 1)).alias("after"), text.alias("content"),
    )
    said = F.from_json(F.get_json_object("json", "$.problems"), "array<string>")
    return toolcalls.linked(messages, SEARCH).select(F.col("conv").alias("conv_id"), "turn", "kind", "id", "step", "status", F.array_join(said, "; ").alias("problems"))


def license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files of a tree inherit, given their own licences: documents by source, language and hundreds of ids.

    A text's licence is the first that it calls by name; those that speak of one are licence files at a
    depth by their length, and the longest of a directory speaks for it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), f"({CALLED})", 1), F.lit(""))
    folders = F.transform(F.array(F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 100).cast("string")), lambda x: F.coalesce(x, F.lit("none")))
    n = F.length("text")
    depth = F.when(own.isNotNull(), n % 3 + 1).otherwise(3).cast("int")
    name = F.when(own.isNotNull(), F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    files = docs.select("doc_id", F.concat_ws("/", F.slice(folders, 1, depth), name).alias("path"), own.alias("license"), F.coalesce(n, F.lit(0)).cast("double").alias("score"))
    return license_scan.inherit(files).select("doc_id", "license", "inherited", "inherited_from", "effective")


QUERIES = {f.__name__: f for f in (tool_call_faults, license_inheritance)}

ORACLE = {
    "tool_call_faults": r"""
WITH m AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE WHEN conv_id IS NULL THEN NULL WHEN role = 'user' THEN length(text) // 60 WHEN role = 'assistant' THEN length(text) // 250 END AS b,
    CASE WHEN role = 'user' THEN nullif(concat_ws('; ', CASE WHEN text IS NULL THEN 'no kind' WHEN NOT ends_with(text, '.') THEN 'kind is none of "question", "statement"' END,
      CASE WHEN text IS NULL THEN 'no length' WHEN length(text) > 240 THEN 'length is above 240' END, CASE WHEN text IS NULL THEN 'no prompt' END, CASE WHEN contains(text, chr(10)) THEN 'unknown lines' END), '') END AS problems
  FROM conversations),
f AS (SELECT conv_id, b, min(turn) AS begun FROM m WHERE kind = 'call' AND b IS NOT NULL GROUP BY ALL),
i AS (SELECT *, b - row_number() OVER (PARTITION BY conv_id ORDER BY b) AS run FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY b) - 1 AS depth FROM i),
a AS (SELECT conv_id, b, count(*) AS answers FROM m WHERE kind = 'result' AND b IS NOT NULL GROUP BY ALL)
SELECT conv_id, turn, kind, 'q' || conv_id || '-' || b AS id, CASE WHEN kind = 'result' OR kind = 'call' AND turn = begun THEN 2 * depth + (kind = 'result')::BIGINT END AS step,
  CASE WHEN kind = 'message' THEN kind WHEN kind = 'result' THEN CASE WHEN begun IS NULL THEN 'orphan' ELSE 'linked' END WHEN b IS NOT NULL AND turn <> begun THEN 'repeated'
    WHEN problems IS NOT NULL THEN 'invalid' WHEN answers > 0 THEN 'answered' ELSE 'unanswered' END AS status, problems
FROM m LEFT JOIN d USING (conv_id, b) LEFT JOIN a USING (conv_id, b)
""",
    "license_inheritance": f"""
WITH o AS (
  SELECT doc_id, [coalesce(source, 'none'), coalesce(lang, 'none'), (doc_id // 100)::VARCHAR] AS folders, nullif(regexp_extract(coalesce(text, ''), '({CALLED})', 1), '') AS license, coalesce(length(text), 0) AS n FROM documents),
f AS (
  SELECT *, CASE WHEN license IS NULL THEN 3 ELSE n % 3 + 1 END AS depth, array_to_string(folders[1:(CASE WHEN license IS NULL THEN 3 ELSE n % 3 + 1 END)], '/') AS dir FROM o),
k AS (SELECT dir AS up, arg_min(license, (-n, doc_id::VARCHAR)) AS speaks FROM f WHERE license IS NOT NULL GROUP BY dir),
t AS (SELECT DISTINCT dir, depth, folders[1:depth] AS parts FROM f),
e AS (SELECT dir, parts, unnest(range(1, depth + 1)) AS far FROM t),
x AS (SELECT dir, arg_max(speaks, far) AS inherited, arg_max(up, far) AS inherited_from FROM e JOIN k ON up = array_to_string(parts[1:far], '/') GROUP BY dir)
SELECT doc_id, license, inherited, inherited_from, coalesce(license, inherited) AS effective FROM f LEFT JOIN x USING (dir)
""",
}
