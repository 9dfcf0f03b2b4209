from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.operators import discovery, rules

VALUE = "struct<status:string,baseline:string,capability:string,user_benefit:string,incremental_advantage:string,review:struct<reviewer:string,reviewed_at:string,rationale:string>,evidence_refs:array<struct<evidence_id:string,revision_id:string,quote:string>>>"


def test_rules_name_what_is_broken(spark):
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, " ", ["x", "x"]), (3, None, ["q"])], "k int, t string, l array<string>")
    checks = {"text": rules.text_rule("t"), "list": rules.list_rule("l", 3, ["x", "y"])}
    found = {r.k: r.violations for r in rules.violations(rows, checks).collect()}
    assert found == {1: [], 2: ["text", "list"], 3: ["text", "list"]}
    assert rules.strict(rows.where("k = 1"), checks).count() == 1
    with pytest.raises(Exception, match="broken rules: text, list"):
        rules.strict(rows, checks).collect()


def test_value_descriptions(spark):
    four = ("typed by hand", "reads the scan", "saves an hour", "no templates needed")
    review, refs = ("me", "2026-01-01", "read it"), [("e", "r", "q")]
    cases = [
        (("hypothesis", *four, None, None), True), (("hypothesis", *four[:3], four[0], None, None), False), (("hypothesis", *four[:3], "AI", None, None), False), (("supported", *four, None, None), False),
        (("supported", *four, review, refs), True), (("supported", *four, review, []), False), (("other", *four, review, refs), False), (None, False),
    ]
    frame = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], f"k int, v {VALUE}")
    assert [r[0] for r in frame.orderBy("k").select(rules.meaningful_value(F.col("v"))).collect()] == [w for _, w in cases]


def test_lead_request_and_catalogue_rules(spark):
    leads = spark.createDataFrame([("t", "u", "p", "w", ["a"], "LEAD-0123456789AB"), ("t", "", "p", "w", ["b"], "LEAD-x")], "title string, target_user string, problem_or_desire string, wedge string, industry_ids array<string>, lead_id string")
    assert [r.violations for r in rules.violations(leads, rules.lead_rules(["a"])).collect()] == [[], ["no target_user", "industry not allowed", "lead_id malformed"]]
    requests = spark.createDataFrame([("x", "/s", "GET", {"q": "a"}), ("x", "/t", "PUT", {"api_key": "k"}), ("y", "/s", "GET", {})], "source string, endpoint string, method string, params map<string,string>")
    assert [r.violations for r in rules.violations(requests, rules.request_rules({"x": "/s"})).collect()] == [[], ["other endpoint", "method", "secret in params"], ["unknown source", "other endpoint"]]
    topics = spark.createDataFrame([("pets", "n", "a", [("one",), ("two",)]), ("9", "n", "a", [("one",), ("one",)])], "id string, name string, audience string, subtracks array<struct<id:string>>")
    assert [r.violations for r in rules.violations(topics, rules.catalogue_rules()).collect()] == [[], ["id malformed", "subtrack ids"]]


def test_leads_whose_evidence_changed_need_review(spark):
    leads = spark.createDataFrame([("L1", "observed_need"), ("L2", "archived"), ("L3", "observed_need")], "lead_id string, research_status string")
    refs = spark.createDataFrame([("L1", "e1", "r1"), ("L2", "e2", "r1"), ("L3", "e3", "r1"), ("L1", "e9", "r1")], "lead_id string, evidence_id string, revision_id string")
    states = spark.createDataFrame([("e1", "r2", "current", False), ("e2", "r1", "current", True), ("e3", "r1", "current", False)], "evidence_id string, current_revision_id string, status string, retracted boolean")
    found = {r.lead_id: (r.research_status, r.stored_research_status, [i.issue for i in r.reference_issues or []]) for r in rules.lead_view(leads, refs, states).collect()}
    assert found == {"L1": ("needs_review", "observed_need", ["changed", "missing"]), "L2": ("archived", None, ["withdrawn"]), "L3": ("observed_need", None, [])}


def test_hypotheses_and_nested_clocks(spark):
    frame = spark.createDataFrame([({"payer": "Shops", "region": "JP", "x": None}, {"payer": "shops ", "region": "US"}, [(datetime(2026, 1, 1),), (None,)])], "c map<string,string>, v map<string,string>, n array<struct<published_at:timestamp>>")
    row = frame.select(F.array_sort(rules.unverified(F.col("c"), F.col("v"))).alias("u"), rules.future_nested(F.col("n"), F.lit(datetime(2025, 1, 1))).alias("f")).first()
    assert row.u == ["region", "x"] and row.f is True


def test_followups(spark):
    schema = "observation_id string, task_family_id string, task string, need string, artifact string, trigger string, current_workaround string, desired_outcome string, query_terms array<string>, language string"
    rows = [
        ("O1", "T1", "send invoices", "faster", None, None, None, None, [], "en"), ("O2", "T1", "send invoices", "faster", "pdf", "month end", "copy from sheets", "one click", ["invoice", "pdf"], "en"),
        ("O3", "T2", "word " * 60, "need " * 60, None, None, None, None, None, "unknown"),
    ]
    found = {(r.task_family_id, r.purpose): r for r in discovery.followups(spark.createDataFrame(rows, schema)).collect()}
    assert found["T1", "workflow_artifact"].query == "invoice pdf pdf copy from sheets" and found["T1", "alternative"].query == "invoice pdf one click alternatives services"
    assert found["T1", "non_adoption"].query == "invoice pdf copy from sheets tried stopped using why" and found["T1", "alternative"].source_observation_ids == ["O1", "O2"]
    assert all(len(r.query) <= 100 for r in found.values()) and not found["T2", "alternative"].query.endswith("nee")


def test_families_are_picked_for_breadth(spark):
    rows = [("T1", ["a"], ["en"]), ("T2", ["a", "b"], ["en"]), ("T3", ["c"], ["zh"]), ("T4", ["b"], ["unknown"])]
    frame = spark.createDataFrame(rows, "task_family_id string, industry_ids array<string>, languages array<string>")
    assert discovery.broad_families(frame, date(2026, 7, 14), 2) == ["T2", "T3"]
    assert sorted(discovery.broad_families(frame, date(2026, 7, 14))) == ["T1", "T2", "T3", "T4"]
    assert discovery.broad_families(frame.limit(0), date(2026, 7, 14)) == []


def test_request_batches(spark):
    requests = spark.createDataFrame([("r1", "a", "x"), ("r2", "a", "x"), ("r3", "b", "y"), ("r4", "b", "z"), ("r5", "c", "x")], "id string, topic string, endpoint string")
    placed = discovery.in_turns(requests, "topic", ["id"])
    assert [r.id for r in placed.orderBy("place").collect()] == ["r1", "r3", "r5", "r2", "r4"]
    prices = spark.createDataFrame([("x", Decimal(3)), ("y", Decimal(5))], "endpoint string, cost decimal(38,12)")
    decided = {r.id: r.decision for r in discovery.affordable(placed, prices, Decimal(9), 2).collect()}
    assert decided == {"r1": "selected", "r3": "selected", "r5": "budget_limit", "r2": "budget_limit", "r4": "live_price_unavailable"}
    assert {r.id: r.decision for r in discovery.affordable(placed, prices, Decimal(99), 2).collect()}["r5"] == "batch_limit"
    tasks = spark.createDataFrame([("g", k, n) for k, n in enumerate([10, 10, 10, 50, 5])] + [("h", 9, 999)], "g string, k int, n int")
    assert {r.k: r.batch for r in discovery.review_batches(tasks, "g", ["k"], "n", 2, 60, 0).collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 9: 1}


def test_candidates_and_progress(spark):
    hits = spark.createDataFrame([("https://x.com/a/status/5", "p", "q"), ("https://twitter.com/i/web/status/5?s=1", "o", "q"), ("https://www.h.org/a/?utm_x=1", "p", "q"), ("http://localhost/x", "p", "q"), (None, "p", "q")], "url string, provider string, query string")
    found = {r.key: (r.providers, r.discoveries) for r in discovery.merged_candidates(hits).collect()}
    assert found == {"x:5": (["o", "p"], 2), "https://h.org/a": (["p"], 1)}
    tasks = spark.createDataFrame([("1",), ("2",), ("3",)], "task_id string")
    receipts = spark.createDataFrame([("1", True, "ok"), ("2", True, "error")], "task_id string, searched boolean, status string")
    assert {r.task_id: (r.execution, r.discovery) for r in discovery.search_progress(tasks, receipts).collect()} == {"1": ("searched", "completed"), "2": ("searched", "incomplete"), "3": ("pending", "incomplete")}


def test_upstream_errors(spark):
    cases = {'{"code":200,"data":{"code":0}}': None, '{"success":false}': "upstream_success_false", '{"data":{"data":{"status_code":"500"}}}': "upstream_non_success_code", '{"errors":["x"]}': "upstream_error_payload", '{"error":null}': None, "bad": None, '{"error":""}': None}
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.e for r in frame.select("v", discovery.upstream_error(F.col("v")).alias("e")).collect()} == cases
