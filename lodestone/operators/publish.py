"""The public catalogue: what may be shown, how fresh it is, and how runs change it."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.times import freshness

#: Record states by the reason that withholds them, in order of precedence.
REASONS = ("demo", "retracted", "not_reviewed", "review_outdated", "no_public_evidence")


def withheld_reason(row: dict[str, Column]) -> Column:
    """The first rule that keeps an item private; null if it may be shown."""
    return (
        F.when(F.coalesce(row["is_demo"], F.lit(False)), "demo")
        .when(F.coalesce(row["retracted"], F.lit(False)), "retracted")
        .when(row["review_hash"].isNull(), "not_reviewed")
        .when(row["review_hash"] != row["content_hash"], "review_outdated")
        .when(F.coalesce(row["public_refs"], F.lit(0)) == 0, "no_public_evidence")
    )


def item_freshness(items: DataFrame, evidence: DataFrame, as_of: date, days: int = 30, soon: int = 7) -> DataFrame:
    """``items`` (item_id, refs array<struct<id,revision_id>>) with freshness over all their evidence.

    ``evidence``: id, revision_id, source_day, semantic_day. One reference without a day makes
    an item unknown; days after ``as_of`` don't count as days.
    """
    seen = lambda c: F.when(F.col(c) <= F.lit(as_of), F.col(c))
    days_of = evidence.select("id", "revision_id", seen("source_day").alias("s"), seen("semantic_day").alias("m"))
    refs = items.select("item_id", F.explode_outer("refs").alias("r")).select("item_id", "r.*")
    joined = refs.join(days_of, ["id", "revision_id"], "left").groupBy("item_id").agg(
        F.when(F.count("s") == F.count("*"), F.min("s")).alias("s"), F.when(F.count("m") == F.count("*"), F.min("m")).alias("m")
    )
    return items.join(joined.select("item_id", freshness(F.col("s"), F.col("m"), as_of, days, soon).alias("freshness")), "item_id", "left")


def refresh_tasks(items: DataFrame) -> DataFrame:
    """A task per published item that isn't fresh, with the references to visit."""
    stale = items.where((F.col("publication_status") == "published") & (F.coalesce("freshness.status", F.lit("unknown")) != "fresh"))
    refs = F.array_sort(F.array_distinct("refs"))
    key = F.concat_ws("|", "item_id", F.to_json(F.struct(refs)))
    return stale.select(F.concat(F.lit("REFRESH-"), F.substring(F.sha2(key, 256), 1, 16)).alias("task_id"), "item_id", F.col("freshness.status").alias("reason"), F.col("freshness.due_on").alias("due_on"), refs.alias("refs"))


def catalogue(events: DataFrame, cutoff_run: Column | None = None) -> DataFrame:
    """Items after all runs: the last event of each by (run_order, seq) decides.

    Events: item_id, run_order, seq, kind (publish, withhold or remove_scope), revision_id, day.
    What was published and is withheld later is withdrawn and leaves a tombstone; publishing
    again clears it; what was never published isn't listed. Days never go back.
    """
    if cutoff_run is not None:
        events = events.where(F.col("run_order") <= cutoff_run)
    order = F.struct("run_order", "seq")
    published = F.col("kind") == "publish"
    found = events.groupBy("item_id").agg(
        F.max_by("kind", order).alias("last"), F.max_by(F.when(published, F.col("revision_id")), F.when(published, order)).alias("revision_id"),
        F.max(F.when(published, F.col("day"))).alias("last_observed"), F.bool_or(published).alias("ever"),
    )
    status = F.when(F.col("last") == "publish", "published").when(F.col("last") == "withhold", "withdrawn").otherwise("out_of_scope")
    return found.where("ever").select("item_id", status.alias("status"), "revision_id", "last_observed")


def catalogue_counts(items: DataFrame) -> DataFrame:
    return items.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("published", "withdrawn", "out_of_scope")])


def matching(items: DataFrame, status: str | None = None, industry: str | None = None, text: str | None = None) -> DataFrame:
    """The catalogue's list filter: by status, industry, and a substring of any of four fields."""
    if status:
        items = items.where(F.col("status") == status)
    if industry:
        items = items.where(F.array_contains("industry_ids", industry))
    if text:
        items = items.where(F.lower(F.concat_ws(" ", "title", "target_user", "problem", "summary")).contains(text.lower()))
    return items


def duplicate_ids(items: DataFrame, key: str) -> DataFrame:
    """Ids that stand more than once; a valid document has none."""
    return items.groupBy(key).count().where("count > 1")


def contract_problems(document: Column, required: list[str], optional: list[str]) -> Column:
    """Fields that a JSON object lacks or shouldn't have, as 'no x' and 'unknown x'."""
    keys = F.json_object_keys(document)
    lacking = F.transform(F.array_except(F.array(*[F.lit(k) for k in sorted(required)]), keys), lambda k: F.concat(F.lit("no "), k))
    extra = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in (*required, *optional)]))), lambda k: F.concat(F.lit("unknown "), k))
    return F.when(keys.isNull(), F.array(F.lit("no object"))).otherwise(F.concat(lacking, extra))


#: How VARIANT calls what JSON schemas name (fixed values).
KINDS = {"null": "VOID", "boolean": "BOOLEAN", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "string": "STRING", "array": "ARRAY.*", "object": "OBJECT.*"}
#: Formats of text as patterns; dates must also be days of the calendar (fixed values).
FORMATS = {"date": r"^\d{4}-\d{2}-\d{2}$", "date-time": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$", "uri": r"^https://[^/@?#\s]+([/?#].*)?$"}


def schema_problems(document: Column, schema: dict, consumer: bool = False) -> Column:
    """What in a JSON document breaks a JSON schema, as 'path: problem', in the order of the schema.

    Knows type, enum, const, required, properties, additionalProperties, items, minItems,
    maxItems, uniqueItems, minLength, maxLength, pattern, format, minimum, maximum, oneOf, anyOf
    and references to ``$defs`` (not to themselves: the check is one expression over VARIANT, laid
    out as deep as the schema). A ``consumer`` tolerates fields that the schema doesn't know.
    """
    value = F.try_parse_json(document)
    return F.when(value.isNull(), F.array(F.lit("$: no JSON"))).otherwise(_node_problems(value, schema, schema.get("$defs", {}), F.lit("$"), consumer))


def _node_problems(node: Column, spec: dict, defs: dict, path: Column, consumer: bool) -> Column:
    none = F.array().cast("array<string>")
    if "$ref" in spec:
        spec = defs[spec["$ref"].rsplit("/", 1)[-1]]
    said = lambda what: F.array(F.concat(path, F.lit(f": {what}")))
    for way in ("oneOf", "anyOf"):
        if way in spec:
            fitting = sum((F.when(F.size(_node_problems(node, s, defs, path, consumer)) == 0, 1).otherwise(0) for s in spec[way]), F.lit(0))
            return F.when(fitting == 1 if way == "oneOf" else fitting >= 1, none).otherwise(said(f"fits {way} wrongly"))
    kind = F.schema_of_variant(node)
    is_a = lambda *names: kind.rlike(f"^({'|'.join(KINDS[n] for n in names)})$")
    found = []
    if "enum" in spec:
        found.append(F.when(~F.to_json(node).isin([json.dumps(v, ensure_ascii=False) for v in spec["enum"]]), said("not in enum")))
    if "const" in spec:
        found.append(F.when(F.to_json(node) != json.dumps(spec["const"], ensure_ascii=False), said("not the constant")))
    if "required" in spec or "properties" in spec:
        keys = F.json_object_keys(F.to_json(node))
        own = [F.when(~F.array_contains(keys, k), F.array(F.concat(path, F.lit(f".{k}: required")))) for k in spec.get("required", [])]
        for k, child in spec.get("properties", {}).items():
            inner = F.try_variant_get(node, f"$['{k}']", "variant")
            own.append(F.when(F.array_contains(keys, k), _node_problems(inner, child, defs, F.concat(path, F.lit(f".{k}")), consumer)))
        if spec.get("additionalProperties") is False and not consumer:
            extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in spec.get("properties", {})]).cast("array<string>")))
            own.append(F.transform(extra, lambda k: F.concat(path, F.lit("."), k, F.lit(": not allowed"))))
        found.append(F.when(is_a("object"), F.concat(none, *[F.coalesce(x, none) for x in own])))
    if {"items", "minItems", "maxItems", "uniqueItems"} & set(spec):
        each = F.try_variant_get(node, "$", "array<variant>")
        n = F.size(each)
        own = [F.when(~n.between(spec.get("minItems", 0), spec.get("maxItems", (1 << 31) - 1)), said("number of items"))]
        if spec.get("uniqueItems"):
            own.append(F.when(F.size(F.array_distinct(F.transform(each, lambda x: F.to_json(x)))) < n, said("repeated items")))
        if "items" in spec:
            own.append(F.flatten(F.transform(each, lambda x, k: _node_problems(x, spec["items"], defs, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")), consumer))))
        found.append(F.when(is_a("array"), F.concat(none, *[F.coalesce(x, none) for x in own])))
    text = F.try_variant_get(node, "$", "string")
    if {"minLength", "maxLength"} & set(spec):
        fits = (F.length(F.trim(text)) >= spec.get("minLength", 0)) & (F.length(text) <= spec.get("maxLength", (1 << 31) - 1))
        found.append(F.when(is_a("string") & ~fits, said("length of text")))
    if "pattern" in spec:
        found.append(F.when(is_a("string") & ~text.rlike(spec["pattern"]), said("pattern")))
    if "format" in spec:
        fits = text.rlike(FORMATS[spec["format"]])
        fits = fits & F.try_to_timestamp(text).isNotNull() if spec["format"].startswith("date") else fits
        found.append(F.when(is_a("string") & ~fits, said("format")))
    if {"minimum", "maximum"} & set(spec):
        number = F.try_variant_get(node, "$", "double")
        inside = (number >= spec.get("minimum", float("-inf"))) & (number <= spec.get("maximum", float("inf")))
        found.append(F.when(is_a("number") & ~inside, said("number out of range")))
    inner = F.concat(none, *[F.coalesce(x, none) for x in found])
    if "type" not in spec:
        return inner
    types = [spec["type"]] if isinstance(spec["type"], str) else spec["type"]
    return F.when(~is_a(*types), said("wrong type")).otherwise(inner)


def dangling(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """References of ``items`` (item_id, refs array<struct<id,revision_id>>) that no evidence answers."""
    refs = items.select("item_id", F.explode("refs").alias("r")).select("item_id", "r.*")
    return refs.join(evidence.select("id", "revision_id"), ["id", "revision_id"], "left_anti")


def report_differences(stated: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows that a report states and recomputing doesn't give, and the other way round."""
    a, b = stated.select(*computed.columns), computed
    return a.exceptAll(b).withColumn("side", F.lit("stated")).unionByName(b.exceptAll(a).withColumn("side", F.lit("computed")))


def in_scope(items: DataFrame, industries: list[str]) -> DataFrame:
    """Items with the industries of theirs that are in scope; those with none go."""
    kept = items.withColumn("industry_ids", F.array_intersect("industry_ids", F.array(*[F.lit(i) for i in industries])))
    return kept.where(F.size("industry_ids") > 0)


def with_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row per item and reference, with the evidence that it names."""
    refs = items.select("item_id", F.explode("refs").alias("r")).select("item_id", "r.*")
    return refs.join(evidence, ["id", "revision_id"])
