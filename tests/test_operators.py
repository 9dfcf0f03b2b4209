from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from lodestone.operators import claims, coverage, funnel, ledger, needs, publish, quality, retrieval

WORDS = "red green blue one two three four".split()


def corpus(n=60, seed=2):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))) for k in range(n)]


def test_bm25_equals_the_plain_form(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc int, text string")
    mean = sum(len(t.split()) for _, t in docs) / len(docs)
    found = {r.doc: r.score for r in retrieval.bm25(retrieval.postings(frame, "doc", "text"), "doc", ["red", "two", "red"], len(docs), mean).collect()}
    df = {w: sum(w in t.split() for _, t in docs) for w in WORDS}
    want = {}
    for k, t in docs:
        c, n = Counter(t.split()), len(t.split())
        if c["red"] and c["two"]:
            want[k] = sum(retrieval.expected_idf(len(docs), df[w]) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w in ("red", "two"))
    assert set(found) == set(want) and all(math.isclose(found[k], want[k]) for k in want)


def test_matches_by_word_and_by_substring(spark):
    frame = spark.createDataFrame([(1, "Red apples"), (2, "reddish"), (3, "中文检索内容"), (4, None)], "doc int, text string")
    assert [r.doc for r in retrieval.all_terms(frame, "text", ["red"]).collect()] == [1]
    assert [r.doc for r in retrieval.substring_match(frame, "text", ["red"]).collect()] == [1, 2]
    assert [r.doc for r in retrieval.substring_match(frame, "text", ["检索"]).collect()] == [3]


def test_fusion_equals_the_plain_form(spark):
    rng = random.Random(4)
    streams = [[rng.choice("abcdefgh") for _ in range(12)] for _ in range(3)]
    rows = [(s, r, k) for s, keys in enumerate(streams) for r, k in enumerate(keys, 1)]
    score, order = defaultdict(float), []
    for keys in streams:
        seen = set()
        for r, k in enumerate(keys, 1):
            if k not in order:
                order.append(k)
            if k not in seen:
                seen.add(k)
                score[k] += 1 / (60 + r)
    want = sorted(order, key=lambda k: -round(score[k], 12))
    found = retrieval.reciprocal_rank_fusion(spark.createDataFrame(rows, "stream int, rank int, key string")).orderBy("position").collect()
    assert [r.key for r in found] == want
    top = retrieval.reciprocal_rank_fusion(spark.createDataFrame(rows, "stream int, rank int, key string"), limit=3).orderBy("position").collect()
    assert [r.key for r in top] == want[:3]


def test_lexical_relevance(spark):
    cases = [
        ("invoice automation for freelancers", "I automate invoice reminders, automation for freelancers", "matched"), ("gaming team software", "a gaming team that plays", "weak_match"),
        ("invoice", "my invoice", "matched"), ("发票 管理", "completely english", "unassessable"), ("invoice", "nothing here", "no_match"), ("how do i", "text", "unassessable"), ("invoice", None, "unassessable"),
    ]
    frame = spark.createDataFrame([(k, q, t) for k, (q, t, _) in enumerate(cases)], "k int, q string, t string")
    day = F.lit(date(2026, 7, 1))
    none = F.lit(None).cast("date")
    found = quality.assessed(frame, (date(2026, 6, 15), date(2026, 7, 14)), F.col("q"), F.col("t"), day, none, none).orderBy("k").collect()
    assert [r.lexical_status for r in found] == [c[2] for c in cases]
    assert [r.recent_evidence_eligible for r in found] == [c[2] == "matched" for c in cases]
    assert found[0].matched_terms == ["automation", "freelancers", "invoice"] and found[0].local_relevance == 1.0
    manual = quality.assessed(frame, (date(2026, 6, 15), date(2026, 7, 14)), F.col("q"), F.col("t"), day, none, none, F.lit("unrelated")).collect()
    assert {r.relevance_status for r in manual} == {"unrelated"} and {r.requires_semantic_review for r in manual} == {False}


def test_deduplication(spark):
    rows = spark.createDataFrame(
        [("1", "hn", "9", "https://h/a?utm_x=1", "t", "q1"), ("2", "hn", "9", "https://h/b", "u", "q2"), ("3", "web", None, "https://h/c", "t", "q1"), ("4", "web", " ", "https://h/c", "v", "q3"), ("5", "web", None, None, "same", "q1"), ("6", "web", None, "", "same", "q2")],
        "id string, source string, native string, url string, text string, query_id string",
    )
    found = quality.first_of_each(rows, [quality.evidence_identity(F.col("source"), F.col("native"), F.col("url"), F.col("text"))], F.col("id"), {"query_id": "query_ids"}).collect()
    assert sorted((r.id, r.copies, tuple(r.query_ids)) for r in found) == [("1", 2, ("q1", "q2")), ("3", 2, ("q1", "q3")), ("5", 2, ("q1", "q2"))]
    marked = quality.reposts(spark.createDataFrame([("a", "https://h/x?utm_a=1", False), ("b", "https://H/x", False), ("c", "https://h/x", True), ("d", None, False)], "id string, url string, c boolean"), "id", "url", F.col("c")).collect()
    assert {r.id: r.duplicate_of for r in marked} == {"a": None, "b": "a", "c": None, "d": None}
    requests = spark.createDataFrame([("f", 2, ["b"], "y"), ("f", 1, ["a", "b"], "x"), ("g", 3, ["c"], "z")], "fp string, pos int, refs array<string>, name string")
    merged = {r.fp: (r.name, r.refs) for r in quality.merged_requests(requests, "fp", "pos", ["refs"]).collect()}
    assert merged == {"f": ("x", ["a", "b"]), "g": ("z", ["c"])}


def test_ranks_within_requests(spark):
    rows = spark.createDataFrame([("q", 1, "unrelated", 0.0, True, {"l": 99.0}), ("q", 2, "relevant", 0.5, False, {}), ("q", 3, "relevant", 0.5, True, None), ("q", 4, "relevant", 0.5, True, {"l": 3.0})], "q string, id int, rel string, s double, r boolean, e map<string,double>")
    found = quality.engagement_rank(rows, F.col("rel"), F.col("s"), F.col("r"), F.col("e"), ["q"], "id").orderBy("rank").collect()
    assert [r.id for r in found] == [4, 3, 2, 1]


EVIDENCE = "struct<evidence_id:string,url:string,original_url:string,original_publisher:string,retracted:boolean,status:string,is_demo:boolean,fact:string,supporting_fact:string,quote:string,text:string,supports:string,original_text:string>"
SIGNAL = EVIDENCE[:-1] + ",type:string,region:string,market:string,payer:string>"
CANDIDATE = f"id string, benchmark_ids array<string>, payer string, current_alternative string, product_gap string, acquisition_channel string, mvp_days int, mvp_scope string, source_region string, target_region string, transfer_reason string, unverified_hypotheses array<string>, evidence array<{EVIDENCE}>, payment_signals array<{SIGNAL}>, demand_signals array<{SIGNAL}>"


def fact(key, url, **more):
    base = {"evidence_id": key, "url": url, "original_url": None, "original_publisher": None, "retracted": None, "status": None, "is_demo": None, "fact": "said so", "supporting_fact": None, "quote": None, "text": None, "supports": None, "original_text": None}
    return base | more


def signal(kind, key, url, **more):
    return fact(key, url) | {"type": kind, "region": None, "market": None, "payer": None} | more


def candidate(key, **more):
    base = {
        "id": key, "benchmark_ids": ["BENCH-ABC1"], "payer": "shops", "current_alternative": "sheets", "product_gap": "slow", "acquisition_channel": "forum", "mvp_days": 14, "mvp_scope": "one page",
        "source_region": "US", "target_region": "JP", "transfer_reason": None, "unverified_hypotheses": [], "evidence": [fact("e1", "https://a.org/1"), fact("e2", "https://b.org/2")],
        "payment_signals": [signal("Paid", "e1", "https://a.org/1", region="jp", payer="shops")], "demand_signals": [signal("complaint", "e2", "https://b.org/2")],
    }
    return base | more


def test_tiers(spark):
    priced = [signal("pricing", "e1", "https://a.org/1")]
    cases = [
        (candidate("a"), "A", []), (candidate("b", unverified_hypotheses=["payer"]), "B", []), (candidate("c", payment_signals=priced, transfer_reason="works there"), "R", []),
        (candidate("d", payment_signals=priced), "B", []), (candidate("e", payment_signals=priced, demand_signals=[]), None, ["missing_demand_or_local_payment_proof"]),
        (candidate("f", payer="TBD", mvp_days=45), None, ["clear_payer", "mvp_within_30_days"]), (candidate("g", evidence=[fact("e1", "https://a.org/1"), fact("e2", "https://a.org/2")]), "B", []),
        (candidate("h", evidence=[fact("e1", "https://a.org/1", status="withdrawn"), fact("e2", "https://b.org/2")]), "B", []), (candidate("i", benchmark_ids=None), None, ["paid_market"]),
        (candidate("j", payment_signals=[signal("paid", "e9", None, region="JP", payer="x")]), None, ["paid_market"]),
    ]
    found = funnel.classified(spark.createDataFrame([c for c, *_ in cases], CANDIDATE)).orderBy("id").collect()
    assert [(r.id, r.evidence_tier, r.rejection_reasons) for r in found] == [(c["id"], t, why) for c, t, why in cases]


def test_independent_sources_merge_by_address_and_publisher(spark):
    cases = [
        ([fact("1", "https://a.org/1"), fact("2", "https://a.org/2")], 1), ([fact("1", "https://a.org/1"), fact("2", "https://b.org/2")], 2),
        ([fact("1", "https://a.org/1", original_publisher="P"), fact("2", "https://b.org/2", original_publisher="p ")], 1),
        ([fact("1", "https://a.org/1", original_url="https://c.org/x"), fact("2", "https://c.org/x"), fact("3", "https://d.org/y", original_url="https://a.org/1"), fact("4", "https://e.org/")], 2),
        ([fact("1", "bad"), fact("2", "https://a.org/1", retracted=True)], 0), ([], 0),
    ]
    frame = spark.createDataFrame([(k, e) for k, (e, _) in enumerate(cases)], f"k int, e array<{EVIDENCE}>")
    assert [r.n for r in frame.select("k", funnel.independent_sources(F.col("e")).alias("n")).orderBy("k").collect()] == [n for _, n in cases]


def test_expansion_takes_turns_and_drops_repeats(spark):
    axes = {a: None for a in funnel.AXES}
    rows = [{"benchmark_id": "B1", "pos": 0} | axes | {"segments": ["x", "X ", "y"], "regions": ["r1", "r2"]}, {"benchmark_id": "B2", "pos": 1} | axes | {"segments": ["z"]}]
    frame = spark.createDataFrame(rows, "benchmark_id string, pos int, " + ", ".join(f"{a} array<string>" for a in funnel.AXES))
    found = funnel.expanded(frame).orderBy("scan").collect()
    assert [(r.benchmark_id, r.segment, r.region) for r in found] == [("B1", "x", "r1"), ("B2", "z", None), ("B1", "x", "r2"), ("B1", "y", "r1"), ("B1", "y", "r2")]
    assert len({r.candidate_id for r in found}) == 5 and funnel.expanded(frame, limit=2).count() == 2


def test_scores_need_every_field_in_range(spark):
    full = {f: 10.0 for f in funnel.WEIGHTS["needle"]}
    rows = [(1, "needle", full), (2, "needle", full | {"demand": 11.0}), (3, "other", full), (4, "new_form", {k: v for k, v in full.items() if k != "evidence"}), (5, "regional_gap", dict.fromkeys(full, 6.1))]
    found = funnel.scored(spark.createDataFrame(rows, "id int, track string, scores map<string,double>")).orderBy("id").collect()
    assert [(r.total_score, r.recommendation) for r in found] == [(100.0, "推荐"), (None, None), (None, None), (None, None), (61.0, "重点观察")]


def test_fit_and_priorities(spark):
    frame = spark.createDataFrame([(1, ["Python"], [" python", "sql"], 5.0, 8.0), (2, ["rust"], ["python"], 9.0, 8.0), (3, [], None, 1.0, 8.0), (4, None, ["x"], None, 8.0)], "id int, need array<string>, own array<string>, v double, cap double")
    found = frame.select(funnel.fit(F.col("need"), F.col("own")).alias("f"), funnel.within(F.col("v"), F.col("cap")).alias("w"), funnel.action(funnel.fit(F.col("need"), F.col("own")), funnel.within(F.col("v"), F.col("cap"))).alias("a")).collect()
    assert [tuple(r) for r in found] == [("pass", "pass", "validate"), ("conflict", "conflict", "park"), ("pass", "pass", "validate"), ("unknown", "unknown", "clarify")]
    people = spark.createDataFrame([("c1", "Shops", "JP"), ("c2", "x", "jp "), ("c3", "y", "US")], "candidate_id string, target_user string, region string")
    wanted = spark.createDataFrame([("segments", "shops", 2.0), ("regions", "JP", 1.5)], "axis string, value string, priority double")
    ranked = {r.candidate_id: r.axis_priority for r in funnel.prioritised(people, wanted, {"segments": "target_user", "regions": "region"}).collect()}
    assert ranked == {"c1": 3.5, "c2": 1.5, "c3": 0.0}


def test_reservations_equal_a_plain_fold(spark):
    rng = random.Random(9)
    rows = [(f"h{rng.randint(0, 4)}", k, Decimal(rng.randint(1, 50))) for k in range(400)]
    frame = spark.createDataFrame(rows, "home string, seq int, list_cost_usd decimal(38,12)").repartition(5)
    found = {r.seq: r.accepted for r in ledger.reservations(frame, "home", ["seq"], Decimal(300)).collect()}
    used, want = defaultdict(Decimal), {}
    for home, seq, amount in rows:
        want[seq] = used[home] + amount <= 300
        used[home] += amount if want[seq] else 0
    assert found == want


def test_money_is_exact(spark):
    values = ["0.1", "0.2", "1e2", "-1", "x", None, "0.000000000001"]
    frame = spark.createDataFrame([(v,) for v in values], "v string").select(ledger.money(F.col("v")).alias("m"))
    assert [r.m for r in frame.collect()] == [Decimal("0.1"), Decimal("0.2"), Decimal(100), None, None, None, Decimal("0.000000000001")]
    assert frame.agg(ledger.plain(F.sum("m")).alias("s")).first().s == "100.300000000001"
    states = spark.createDataFrame([("f", 1, "succeeded"), ("f", 2, "failed"), ("g", 1, "failed"), ("g", 2, "started")], "fingerprint string, id int, state string")
    assert {r.fingerprint: r.state for r in ledger.request_state(ledger.recovered(states), "id").collect()} == {"f": "succeeded", "g": "outcome_unknown"}


def test_packets_pass_over_what_does_not_fit(spark):
    sizes = [5, 9, 3, 4, 2, 8]
    frame = spark.createDataFrame([("g", k, n) for k, n in enumerate(sizes)] + [("h", 9, 100)], "g string, k int, n int")
    found = {r.k: r.packed for r in claims.budget_packets(frame, ["g"], ["k"], "n", 3, 12).collect()}
    assert found == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False, 9: False}


def test_diversity_and_batches(spark):
    frame = spark.createDataFrame([(k, "a" if k < 6 else "b") for k in range(9)], "k int, s string")
    rows = claims.reading_batches(claims.diversified(frame, ["s"], "k"), "position", 4).orderBy("position").collect()
    assert [r.k for r in rows] == [0, 6, 1, 7, 2, 8, 3, 4, 5]
    assert [r.batch_id for r in rows] == ["READ-0001"] * 4 + ["READ-0002"] * 4 + ["READ-0003"]


def test_batches_from_the_ten_thousandth_on_keep_all_digits(spark):
    frame = spark.createDataFrame([(p,) for p in (1, 149_985, 149_986, 1_500_000)], "position long")
    rows = claims.reading_batches(frame, "position").orderBy("position").collect()
    assert [r.batch_id for r in rows] == ["READ-0001", "READ-9999", "READ-10000", "READ-100000"]


def test_claims(spark):
    catalog = spark.createDataFrame([("e1", "r1", "the exact words"), ("e1", "r2", "new words"), ("e2", "r1", "x")], "evidence_id string, revision_id string, original_text string")
    refs = "array<struct<evidence_id:string,revision_id:string,quote:string>>"
    rows = [("c1", [("e1", "r1", "exact")]), ("c2", [("e1", "r1", "exact"), ("e1", "r2", "exact")]), ("c3", [("e9", "r1", "x")]), ("c4", [("e2", "r7", "x")]), ("c5", []), ("c6", None)]
    located = claims.located(spark.createDataFrame(rows, f"claim_id string, refs {refs}"), catalog)
    found = sorted((r.claim_id, r.ref_no if r.ref_no is not None else -1, r.problem, r.start) for r in located.where("evidence_id is not null").collect())
    assert found == [("c1", 0, None, 4), ("c2", 0, None, 4), ("c2", 1, "no_quote", None), ("c3", 0, "no_evidence", None), ("c4", 0, "other_revision", None)]
    assert {r.claim_id: r.validation for r in claims.claim_status(located).collect()} == {"c1": "verified", "c2": "incomplete", "c3": "unsupported", "c4": "unsupported", "c5": "unsupported", "c6": "unsupported"}


def test_topic_status(spark):
    names = ("reviewed", "related", "material", "failures", "attempts")
    rows = [(1, 1, 1, 0, 1, True), (0, 1, 1, 0, 1, True), (0, 0, 1, 0, 1, True), (0, 0, 0, 1, 1, True), (0, 0, 0, 0, 1, True), (0, 0, 0, 0, 0, True), (0, 0, 0, 0, 0, False), (1, 1, 1, 1, 1, True)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", scheduled boolean")
    found = [r[0] for r in frame.select(coverage.topic_status({n: F.col(n) for n in (*names, "scheduled")})).collect()]
    assert found == ["reviewed_evidence", "related_material", "needs_relevance_review", "collection_failed", "no_results", "not_collected", "not_scheduled", "partial"]
    spans = spark.createDataFrame([(3, 3, 10), (0, 10, 10), (5, 11, 10), (None, 2, 10)], "s int, e int, n int")
    assert [r[0] for r in spans.select(coverage.citation_range(F.col("s"), F.col("e"), F.col("n"))).collect()] == ["zero_length", "answer_span", "unlocated", "unlocated"]


def test_needs_group_across_products(spark):
    refs = [("e1", "r1", "q")]
    rows = [("Shops", "Invoice", "faster", ["b", "A"], refs, ["P1"], ["i"], ["s"], ["t"], False, "complaint", None), ("shops ", "invoice", "Faster!", ["a", "B"], refs, ["P2"], ["i"], ["s"], ["u"], False, "complaint", None), ("Shops", "Invoice", "cheaper", [], refs, ["P1"], ["i"], ["s"], ["t"], True, "complaint", None)]
    frame = spark.createDataFrame(rows, "target_user string, task string, need string, constraints array<string>, evidence_refs array<struct<evidence_id:string,revision_id:string,quote:string>>, products array<string>, industry_ids array<string>, sources array<string>, query_terms array<string>, is_demo boolean, feedback_type string, behavior_type string")
    ident = needs.identified(frame)
    merged = needs.merged(ident)
    assert merged.count() == 2
    both = merged.where("size(products) = 2").first()
    assert both.products == ["P1", "P2"] and both.query_terms == ["t", "u"]
    assert needs.clusters(ident).count() == 1
    s = needs.summary(ident).first()
    assert (s.observation_count, s.demand_cluster_count, s.task_family_count) == (3, 1, 1)


def test_publication(spark):
    rows = [("a", 1, 1, "publish", "r1", date(2026, 1, 1)), ("a", 2, 1, "withhold", "r1", date(2026, 1, 2)), ("b", 1, 2, "withhold", "r1", date(2026, 1, 1)), ("c", 1, 3, "publish", "r1", date(2026, 1, 5)), ("c", 2, 2, "withhold", "r1", date(2026, 1, 6)), ("c", 3, 1, "publish", "r2", date(2026, 1, 3)), ("d", 1, 4, "publish", "r1", date(2026, 1, 1)), ("d", 3, 2, "remove_scope", None, None)]
    found = {r.item_id: (r.status, r.revision_id, str(r.last_observed)) for r in publish.catalogue(spark.createDataFrame(rows, "item_id string, run_order int, seq int, kind string, revision_id string, day date")).collect()}
    assert found == {"a": ("withdrawn", "r1", "2026-01-01"), "c": ("published", "r2", "2026-01-05"), "d": ("out_of_scope", "r1", "2026-01-01")}
    reasons = spark.createDataFrame([(True, True, None, "h", 0), (False, True, None, "h", 0), (None, None, None, "h", 1), (None, None, "g", "h", 1), (None, None, "h", "h", None), (None, None, "h", "h", 2)], "is_demo boolean, retracted boolean, review_hash string, content_hash string, public_refs int")
    assert [r[0] for r in reasons.select(publish.withheld_reason({c: F.col(c) for c in reasons.columns})).collect()] == ["demo", "retracted", "not_reviewed", "review_outdated", "no_public_evidence", None]
    items = spark.createDataFrame([("1", "published", ["a", "b"], "Title X", "u", "p", None), ("2", "withdrawn", ["b"], "t", "u", "prob x", "s")], "id string, status string, industry_ids array<string>, title string, target_user string, problem string, summary string")
    assert [r.id for r in publish.matching(items, text="x").collect()] == ["1", "2"] and [r.id for r in publish.matching(items, "published", "b", "TITLE").collect()] == ["1"]
