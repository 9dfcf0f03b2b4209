"""Fit of candidates with reasons, what to validate first, usage by source, and the source table."""

from decimal import Decimal

from pyspark.sql import functions as F

from lodestone.operators import funnel, ledger
from lodestone.plans import catalog

SCHEMA = "id string, skills array<string>, channel string, hours double, idea string"


def fitted(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    plan = {"required_skills": F.col("skills"), "required_languages": F.array().cast("array<string>"), "acquisition_channel": F.col("channel"), "hours": F.col("hours"), "budget_usd": F.lit(0), "mvp_days": F.lit(3), "hypothesis": F.col("idea"), "success_criteria": F.lit("x"), "stop_criteria": F.lit("y")}
    own = {"skills": F.array(F.lit("Ｐython"), F.lit("web-design")), "reachable_channels": F.array(F.lit("Forum Posts")), "weekly_hours": F.lit(5.5), "validation_budget_usd": F.lit(0), "max_mvp_days": F.lit(3)}
    return funnel.assessed(frame, plan, own)


def test_reasons_of_conflicts_and_unknowns(spark):
    rows = [
        ("ready", ["python", "Web Design"], "forum-posts", 5.5, "they pay"),
        ("lacks", ["sales", "Ads", "ads", "python"], "mail", 6.0, "they pay"),
        ("open", None, " ", None, "  "),
        ("none", [], "Forum posts", 0.5, None),
    ]
    found = {r.id: r for r in fitted(spark, rows).collect()}
    assert {k: r.action for k, r in found.items()} == {"ready": "validate", "lacks": "park", "open": "clarify", "none": "clarify"}
    assert found["lacks"].conflicts == ["技能", "渠道", "本周验证时间"] and found["lacks"].unknowns == []
    assert [c.reason for c in found["lacks"].checks[:4]] == ["缺少：ads、sales", "已明确没有额外要求", "该渠道尚不在个人可触达入口中", "估算 6.0；上限 5.5"]
    assert found["open"].unknowns == ["技能", "渠道", "本周验证时间", "hypothesis"] and found["none"].unknowns == ["hypothesis"]
    assert found["ready"].conflicts == found["ready"].unknowns == [] and not any(r.market_validated for r in found.values())
    assert all(len(r.checks) == 9 for r in found.values())


def test_an_empty_profile_leaves_everything_open(spark):
    frame = spark.createDataFrame([("a", "kept")], "id string, action string")
    row = funnel.assessed(frame, {}, {}).first()
    assert row.action == "clarify" and len(row.unknowns) == 9 and row.next_action == funnel.NEXT_ACTIONS["clarify"]


def test_primary_and_alternatives(spark):
    rows = fitted(spark, [(f"c{n}", ["python"], "forum posts", 1.0, "idea" if n != 1 else None) for n in range(6)])
    assert tuple(funnel.chosen(rows, "id", ["id"]).first()) == ("c0", ["c2", "c3"])
    assert tuple(funnel.chosen(rows.where("id = 'c1'"), "id", ["id"]).first()) == (None, [])
    assert tuple(funnel.chosen(rows.limit(0), "id", ["id"]).first()) == (None, [])


def test_digest_by_source(spark):
    runs = spark.createDataFrame([("a", "h1", "ok", 0.5), ("a", "h1", "ok", 0.5), ("a", "h2", None, 0.25), (None, "h3", "failed", None)], "source string, content_hash string, status string, cost_usd double")
    evidence = spark.createDataFrame([("a", "m1"), ("a", "m1"), ("b", "m2"), ("b", "m1")], "source string, marker string")
    conclusions = spark.createDataFrame([("r1", "m1"), ("r1", "m2"), ("r1", "m2"), ("r2", "gone"), ("r3", "m2"), ("r4", None)], "record_id string, marker string")
    found = {r.source: r for r in ledger.digest_by_source(runs, evidence, conclusions, conclusions.limit(0)).collect()}
    told = {k: (r.requests, r.ok, r.error, r.normalized_evidence, r.linked_conclusions, r.linked_research_leads) for k, r in found.items()}
    assert told == {"a": (2, 1, 1, 1, 1, 0), "b": (0, 0, 0, 2, 2, 0), "unknown": (1, 0, 1, 0, 0, 0)}
    assert found["a"].estimated_cost_usd == Decimal("0.75") and found["b"].estimated_cost_usd == 0
    used = {r.source: (r.cited, r.cited_evidence) for r in ledger.usage(conclusions, evidence, "cited").collect()}
    assert used == {"a": (1, 1), "b": (2, 2)}


def test_source_table_and_credentials(spark):
    sources = catalog.registry(spark, {"paid": ["key"], "github": ["token"]})
    assert sources.count() == 27 and sources.where("live_health <> 'not_checked' or size(evidence_roles) <> 14").count() == 0
    found = {r.source: r for r in catalog.configured(sources, ["token"]).collect()}
    assert found["github"].credentials_set == {"token": True} and found["reddit"].credentials_set == {"key": False}
    assert (found["github"].configuration_status, found["reddit"].configuration_status, found["web"].configuration_status) == ("configuration_ready", "missing_required_config", "manual_import_only")
    assert found["hackernews"].credentials_set == {} and found["tiktok"].region_filter and not found["web"].region_filter
    assert catalog.configured(sources, []).where("configuration_status = 'missing_required_config'").count() == len(catalog.PAID)
