"""Registered queries of the funnel's rules: customers as candidates, their orders as evidence and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.shared import dealt
from lodestone.operators import funnel, ledger
from lodestone.plans import catalog
from lodestone.plans.queries import query, quoted, table

#: What an order's priority says as a payment signal; one is written in full width.
TYPES = {"1-URGENT": "Paid", "2-HIGH": "Customer  Purchase", "3-MEDIUM": "Ｐｒｉｃｉｎｇ"}
TYPE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " ELSE 'note' END"
ROWS = f"""
WITH o AS (
  SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey, lower(substr(o_orderpriority, 3)) AS host, o_orderstatus <> 'P' AS stands, o_totalprice < 20000 AS demo, o_totalprice > 100000 AS here,
    o_totalprice > 50000 AS payer, o_totalprice, o_orderpriority, {TYPE} AS type, month(o_orderdate) < 6 AS demand
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their structs; a customer's orders are gathered, as a candidate's evidence is."""
    none = lambda kind: F.lit(None).cast(kind)
    host = F.lower(F.substring("o_orderpriority", 3, 20))
    shared = [
        F.concat(F.lit("o"), "o_orderkey").alias("evidence_id"), F.concat(F.lit("https://www."), host, F.lit(".example.com/"), "o_orderkey").alias("url"), (F.col("o_orderstatus") == "P").alias("retracted"), none("string").alias("status"),
        *[none("string").alias(c) for c in ("fact", "supporting_fact", "quote", "supports", "original_text", "original_url", "original_publisher", "market")], F.concat(F.lit("order "), "o_orderstatus").alias("text"),
    ]
    demo = (F.col("o_totalprice") < 20000).alias("is_demo")
    paid = F.struct(*shared, demo, F.expr(TYPE).alias("type"), F.when(F.col("o_totalprice") > 100000, F.col("c_mktsegment")).otherwise("elsewhere").alias("region"), F.when(F.col("o_totalprice") > 50000, "buyer").otherwise("TBD").alias("payer"))
    asked = F.struct(*shared, F.when(F.month("o_orderdate") < 6, "repeat usage").otherwise("visit").alias("type"))
    orders = table(spark, sf_dir, "orders")
    rows = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    real = F.col("o_orderkey").isNotNull()
    gathered = dealt(rows, "c_custkey").groupBy("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey").agg(
        F.count("o_orderkey").alias("mvp_days"), F.array_compact(F.collect_list(F.when(real, F.struct(*shared, demo)))).alias("evidence"),
        F.array_compact(F.collect_list(F.when(real, paid))).alias("payment_signals"), F.array_compact(F.collect_list(F.when(real, asked))).alias("demand_signals"),
        F.array_compact(F.collect_set("o_orderpriority")).alias("needed"), F.sum("o_totalprice").alias("spent"),
    )
    broken = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(F.lit("bench-1"))).otherwise(F.array().cast("array<string>"))
    return gathered.withColumns({
        "benchmark_ids": F.concat(F.array(F.concat(F.lit("BENCH-"), F.upper("c_mktsegment"))), broken), "payer": F.col("c_name"), "current_alternative": F.when(F.col("c_acctbal") < 500, "Unknown yet").otherwise("a sheet"),
        "product_gap": F.when(F.col("c_nationkey") == 3, "todo: ask").otherwise("slow"), "acquisition_channel": F.col("c_mktsegment"), "mvp_scope": F.lit("one page"), "source_region": F.lit("MACHINERY"), "target_region": F.col("c_mktsegment"),
        "transfer_reason": F.when(F.col("c_acctbal") > 8000, "TBD").otherwise("same need"), "unverified_hypotheses": F.when(F.col("c_acctbal") > 5000, F.array(F.lit("x"))),
    })


@query(f"""{ROWS},
g AS (
  SELECT c_custkey, c_acctbal, c_mktsegment AS target, c_nationkey, count(host) AS n, coalesce(bool_or(stands AND type <> 'note'), false) AND c_mktsegment <> 'HOUSEHOLD' AS market,
    coalesce(bool_or(stands AND NOT demo AND type IN ('Paid', 'Customer  Purchase') AND here AND payer), false) AS local, count(DISTINCT host) FILTER (stands AND NOT demo) AS sources, coalesce(bool_or(stands AND demand), false) AS demand
  FROM o GROUP BY c_custkey, c_acctbal, c_mktsegment, c_nationkey),
f AS (
  SELECT *, list_filter([CASE WHEN NOT market THEN 'paid_market' END, CASE WHEN c_acctbal < 500 THEN 'current_alternative' END, CASE WHEN c_nationkey = 3 THEN 'product_gap' END, CASE WHEN n NOT BETWEEN 1 AND 30 THEN 'mvp_within_30_days' END], lambda x: x IS NOT NULL) AS failed
  FROM g),
t AS (
  SELECT *, CASE WHEN len(failed) > 0 THEN NULL WHEN local AND c_acctbal <= 5000 AND sources >= 2 THEN 'A' WHEN target <> 'MACHINERY' AND NOT local AND c_acctbal <= 8000 THEN 'R' WHEN demand THEN 'B' END AS tier FROM f)
SELECT c_custkey, array_to_string(failed, ',') AS failed_gates, tier AS evidence_tier,
  CASE WHEN tier IS NOT NULL THEN '' WHEN len(failed) > 0 THEN array_to_string(failed, ',') ELSE 'missing_demand_or_local_payment_proof' END AS rejection_reasons FROM t""")
def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = funnel.classified(customers(spark, sf_dir))
    return found.select("c_custkey", F.array_join("failed_gates", ",").alias("failed_gates"), "evidence_tier", F.array_join("rejection_reasons", ",").alias("rejection_reasons"))


@query(f"""{ROWS},
g AS (SELECT c_custkey, list_sort(list_distinct(list(CASE type WHEN 'Ｐｒｉｃｉｎｇ' THEN 'pricing' WHEN 'Customer  Purchase' THEN 'customer_purchase' ELSE lower(type) END) FILTER (stands AND host IS NOT NULL))) AS types FROM o GROUP BY c_custkey)
SELECT c_custkey, coalesce(array_to_string(types, ','), '') AS types FROM g""")
def payment_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised types of the payment signals that stand, however they are written."""
    return customers(spark, sf_dir).select("c_custkey", F.array_join(F.array_sort(funnel.signal_types(F.col("payment_signals"))), ",").alias("types"))


OWNED = {"BUILDING": ["１-urgent", "2-high"], "MACHINERY": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "HOUSEHOLD": []}


@query(f"""{ROWS},
g AS (SELECT c_custkey, c_mktsegment, c_acctbal, list_distinct(list(o_orderpriority) FILTER (o_orderpriority IS NOT NULL)) AS needed, sum(o_totalprice) AS spent FROM o GROUP BY ALL),
f AS (
  SELECT *, CASE WHEN coalesce(len(needed), 0) = 0 THEN 'pass' WHEN c_mktsegment NOT IN ({quoted(list(OWNED))}) THEN 'unknown'
      WHEN c_mktsegment = 'MACHINERY' OR c_mktsegment = 'BUILDING' AND len(list_filter(needed, lambda x: x NOT IN ('1-URGENT', '2-HIGH'))) = 0 THEN 'pass' ELSE 'conflict' END AS skills,
    CASE WHEN spent IS NULL OR c_acctbal < 0 THEN 'unknown' WHEN spent <= 100 * c_acctbal THEN 'pass' ELSE 'conflict' END AS money FROM g)
SELECT c_custkey, skills, money, CASE WHEN 'conflict' IN (skills, money) THEN 'park' WHEN 'unknown' IN (skills, money) THEN 'clarify' ELSE 'validate' END AS action FROM f""")
def candidate_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a candidate needs against what its founder has, and what to do next."""
    owned = F.lit(None).cast("array<string>")
    for segment, have in OWNED.items():
        owned = F.when(F.col("c_mktsegment") == segment, F.array(*[F.lit(x) for x in have]).cast("array<string>")).otherwise(owned)
    rows = customers(spark, sf_dir).select("c_custkey", funnel.fit(F.col("needed"), owned).alias("skills"), funnel.within(F.col("spent"), F.when(F.col("c_acctbal") >= 0, 100 * F.col("c_acctbal"))).alias("money"))
    return rows.withColumn("action", funnel.action(F.col("skills"), F.col("money")))


REASONED = f"""{ROWS},
g AS (SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey, list_distinct(list(o_orderpriority) FILTER (o_orderpriority IS NOT NULL)) AS needed, count(host) AS days FROM o GROUP BY ALL),
m AS (
  SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN ['1-URGENT', '2-HIGH'] WHEN 'MACHINERY' THEN ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'] WHEN 'HOUSEHOLD' THEN [] END AS owned FROM g),
r AS (
  SELECT *, CASE WHEN coalesce(len(needed), 0) = 0 THEN '已明确没有额外要求' WHEN owned IS NULL THEN '尚未填写项目要求或个人能力' WHEN len(list_filter(needed, lambda x: NOT list_contains(owned, x))) = 0 THEN '符合已填写要求'
      ELSE '缺少：' || array_to_string(list_sort(list_transform(list_filter(needed, lambda x: NOT list_contains(owned, x)), lambda x: replace(lower(x), '-', ' '))), '、') END AS skills,
    CASE WHEN c_nationkey % 5 = 0 THEN '尚未确认具体获客入口' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN '入口在个人已确认可触达的渠道中' ELSE '该渠道尚不在个人可触达入口中' END AS channel,
    CASE WHEN c_acctbal < 0 THEN '缺少估算或个人上限' ELSE '估算 ' || days || '；上限 14' END AS mvp,
    CASE WHEN c_acctbal < 500 THEN '验证前需补齐' ELSE '已填写' END AS plan FROM m),
v AS (
  SELECT *, concat_ws(',', CASE WHEN skills LIKE '缺少：%' THEN '技能' END, CASE WHEN channel LIKE '该渠道%' THEN '渠道' END, CASE WHEN c_acctbal >= 0 AND days > 14 THEN 'MVP 工期' END) AS conflicts,
    concat_ws(',', CASE WHEN skills LIKE '尚未%' THEN '技能' END, CASE WHEN channel LIKE '尚未%' THEN '渠道' END, CASE WHEN c_acctbal < 0 THEN 'MVP 工期' END, CASE WHEN c_acctbal < 500 THEN 'hypothesis' END) AS unknowns FROM r),
a AS (SELECT *, CASE WHEN conflicts <> '' THEN 'park' WHEN unknowns <> '' THEN 'clarify' ELSE 'validate' END AS action FROM v)"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = F.lit(None).cast("array<string>")
    for segment, have in OWNED.items():
        owned = F.when(F.col("c_mktsegment") == segment, F.array(*[F.lit(x) for x in have]).cast("array<string>")).otherwise(owned)
    rich = F.col("c_acctbal") >= 0
    plan = {
        "required_skills": F.col("needed"), "required_languages": F.array().cast("array<string>"), "acquisition_channel": F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")), "hours": F.lit(2), "budget_usd": F.lit(50), "mvp_days": F.when(rich, F.col("mvp_days")),
        "hypothesis": F.when(F.col("c_acctbal") >= 500, "they pay").otherwise(" "), "success_criteria": F.lit("three pay"), "stop_criteria": F.lit("none pays"),
    }
    has = {"skills": owned, "reachable_channels": F.array(*[F.lit(x) for x in ("ｂuilding", "Machinery", "household")]), "weekly_hours": F.lit(4), "validation_budget_usd": F.lit(50), "max_mvp_days": F.lit(14)}
    return funnel.assessed(customers(spark, sf_dir), plan, has)


@query(f"{REASONED} SELECT c_custkey, skills, channel, mvp, plan, conflicts, unknowns, action FROM a")
def fit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a candidate fits its founder, doesn't, or can't be told to."""
    said = lambda k: F.get("checks", F.lit(k))["reason"]
    return _assessed(spark, sf_dir).select(
        "c_custkey", said(0).alias("skills"), said(2).alias("channel"), said(5).alias("mvp"), said(6).alias("plan"), F.array_join("conflicts", ",").alias("conflicts"), F.array_join("unknowns", ",").alias("unknowns"), "action"
    )


@query(f"""{REASONED}, t AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k FROM a WHERE action = 'validate')
SELECT max(c_custkey) FILTER (k = 1) AS primary_validation, coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY k) FILTER (k BETWEEN 2 AND 3), '') AS alternatives FROM t""")
def chosen_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to validate first of all that is ready, and two alternatives."""
    found = funnel.chosen(_assessed(spark, sf_dir), "c_custkey", [F.desc("c_acctbal"), "c_custkey"])
    return found.select("primary_validation", F.array_join(F.col("alternatives").cast("array<string>"), ",").alias("alternatives"))


@query("""
WITH x AS (SELECT o_orderpriority AS source, count(*) AS requests, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS error, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS cost FROM orders GROUP BY 1),
e AS (SELECT DISTINCT o_orderpriority AS source, l_partkey AS marker FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'),
c AS (SELECT p_partkey AS marker, p_brand AS record_id, p_size > 25 AS qualified FROM part),
l AS (SELECT source, count(DISTINCT record_id) FILTER (qualified) AS conclusions, count(DISTINCT record_id) FILTER (NOT qualified) AS leads FROM e JOIN c USING (marker) GROUP BY source)
SELECT source, coalesce(requests, 0) AS requests, coalesce(ok, 0) AS ok, coalesce(error, 0) AS error, coalesce(cost, 0)::DOUBLE AS cost, coalesce(n, 0) AS normalized_evidence, coalesce(conclusions, 0) AS linked_conclusions, coalesce(leads, 0) AS linked_research_leads
FROM x FULL JOIN (SELECT source, count(*) AS n FROM e GROUP BY source) USING (source) FULL JOIN l USING (source)""")
def digest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By priority as source: its orders as runs, parts as evidence, brands as conclusions and leads that cite them."""
    orders = table(spark, sf_dir, "orders")
    runs = orders.select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("content_hash"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"), F.col("o_totalprice").alias("cost_usd"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("marker"))
    evidence = lines.join(orders.select("o_orderkey", F.col("o_orderpriority").alias("source")), "o_orderkey").select("source", "marker")
    cited = table(spark, sf_dir, "part").select(F.col("p_brand").alias("record_id"), F.col("p_partkey").alias("marker"), (F.col("p_size") > 25).alias("qualified"))
    found = ledger.digest_by_source(runs, evidence, cited.where("qualified"), cited.where("not qualified"))
    return found.select("source", "requests", "ok", "error", F.col("estimated_cost_usd").cast("double").alias("cost"), "normalized_evidence", "linked_conclusions", "linked_research_leads")


@query(f"""
WITH d AS (SELECT ([{quoted(catalog.PAID + catalog.COMMUNITY + catalog.MANUAL)}])[1 + page_id % {len(catalog.PAID + catalog.COMMUNITY + catalog.MANUAL)}] AS source FROM pages)
SELECT source, count(*) AS pages, source IN ({quoted(catalog.BY_REGION)}) AS region_filter, source IN ({quoted(catalog.MANUAL)}) AS manual_import_only,
  CASE WHEN source IN ({quoted(catalog.MANUAL)}) THEN 'manual_import_only' WHEN source IN ({quoted(catalog.PAID)}) AND source <> 'reddit' THEN 'missing_required_config' ELSE 'configuration_ready' END AS configuration_status, {len(catalog.EVIDENCE_ROLES)} AS roles
FROM d GROUP BY source""")
def pages_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dealt over the sources, with what the source table says of theirs; only reddit's key is set."""
    names = catalog.PAID + catalog.COMMUNITY + catalog.MANUAL
    counts = table(spark, sf_dir, "pages").groupBy(F.get(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % len(names)).cast("int")).alias("source")).agg(F.count("*").alias("pages"))
    sources = catalog.configured(catalog.registry(spark, {"paid": ["paid_key"], "reddit": ["reddit_key"]}), ["reddit_key"])
    return counts.join(sources, "source").select("source", "pages", "region_filter", "manual_import_only", "configuration_status", F.size("evidence_roles").cast("long").alias("roles"))
