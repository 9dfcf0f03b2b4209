"""Candidate expansion, evidence rules, gates, tiers, families and scores."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import fingerprint
from lodestone.functions.shared import materialise
from lodestone.functions.text import fold, identity_text, present
from lodestone.functions.urls import evidence_url, source_key
from lodestone.operators.ranks import numbered_within

#: Signals that show demand (fixed values).
DEMAND_TYPES = (
    "complaint workaround manual manual_workaround hiring hire job_posting outsourcing outsource cancellation cancelled "
    "switching switched repeat_usage repeat_purchase paid_renewal creative_output learning_progress task_completion "
    "organic_sharing community_participation"
).split()
#: Signals of a payment made, and of a market (fixed values).
PAYMENT_TYPES = "paid payment purchase customer_purchase transaction sale sales paid_subscription paid_invoice paid_contract paid_preorder".split()
MARKET_TYPES = PAYMENT_TYPES + "pricing price subscription invoice contract preorder".split()
#: What can support a claim (fixed values).
FACT_FIELDS = ("fact", "supporting_fact", "quote", "text", "supports", "original_text")
INACTIVE = ("retracted", "withdrawn", "superseded", "not_current")
AXES = ("segments", "triggers", "forms", "regions", "channels", "offers")
#: Most candidates of a tier that a daily report shows; the rest is overflow (fixed values).
CAPS = {"B": 40, "R": 80}
#: Weights of the seven scores by track (fixed values).
WEIGHTS = {
    "needle": {"demand": 2.5, "new_form": 0.5, "distribution": 1.5, "regional_gap": 0.5, "monetization": 1.5, "mvp_feasibility": 2.0, "evidence": 1.5},
    "new_form": {"demand": 2.0, "new_form": 2.5, "distribution": 1.5, "regional_gap": 0.5, "monetization": 1.0, "mvp_feasibility": 1.5, "evidence": 1.0},
    "regional_gap": {"demand": 2.0, "new_form": 0.5, "distribution": 1.5, "regional_gap": 2.5, "monetization": 1.5, "mvp_feasibility": 1.0, "evidence": 1.0},
}


def active(retracted: Column, status: Column) -> Column:
    """Whether a record still stands."""
    return ~F.coalesce(retracted, F.lit(False)) & ~F.coalesce(status, F.lit("")).isin(*INACTIVE)


def linked_fact(item: Column) -> Column:
    """Whether a struct of evidence stands, has an address and says something."""
    says = F.lit(False)
    for f in FACT_FIELDS:
        says = says | present(item[f])
    return active(item["retracted"], item["status"]) & (evidence_url(item["url"]) != "") & says


def qualifying(evidence: Column) -> Column:
    """The structs of an evidence array that are linked facts and no demo."""
    return F.filter(F.coalesce(evidence, F.array()), lambda x: linked_fact(x) & ~F.coalesce(x["is_demo"], F.lit(False)))


def signal_types(signals: Column) -> Column:
    """Distinct normalised types of supported signals."""
    return F.array_distinct(F.transform(F.filter(signals, linked_fact), lambda s: F.replace(fold(s["type"]), F.lit(" "), F.lit("_"))))


def backed(signals: Column, evidence: Column) -> Column:
    """Signals that stand and whose id or address is among the qualifying evidence."""
    known = qualifying(evidence)
    match = lambda s: F.exists(
        known,
        lambda e: (s["evidence_id"].isNull() | (s["evidence_id"] == e["evidence_id"]))
        & ((evidence_url(s["url"]) == "") | (evidence_url(s["url"]) == evidence_url(e["url"]))),
    )
    named = lambda s: s["evidence_id"].isNotNull() | (evidence_url(s["url"]) != "")
    return F.filter(F.coalesce(signals, F.array()), lambda s: active(s["retracted"], s["status"]) & named(s) & match(s))


def local_payment(signals: Column, evidence: Column, region: Column) -> Column:
    """Whether one backed signal shows a payer's payment in the target region."""
    target = fold(region)
    paid = lambda s: (
        F.replace(fold(s["type"]), F.lit(" "), F.lit("_")).isin(*PAYMENT_TYPES)
        & (fold(F.coalesce(s["region"], s["market"])) == target)
        & present(s["payer"])
        & ~F.coalesce(s["is_demo"], F.lit(False))
    )
    return (target != "") & F.exists(backed(signals, evidence), paid)


def independent_sources(evidence: Column) -> Column:
    """How many sources stand behind an array of evidence.

    Records with an address, an original address, or a publisher (else host) in common are one.
    A candidate's evidence is a short array, so groups are merged by folding within the row.
    """
    usable = F.filter(evidence, lambda e: (evidence_url(e["url"]) != "") & active(e["retracted"], F.when(e["status"] == "retracted", e["status"])))

    def keys(e: Column) -> Column:
        url = evidence_url(e["url"])
        original = F.coalesce(F.nullif(evidence_url(e["original_url"]), F.lit("")), url)
        return F.array_distinct(F.array(F.concat(F.lit("url:"), url), F.concat(F.lit("url:"), original), source_key(original, fold(e["original_publisher"]))))

    none = F.array().cast("array<array<string>>")
    return F.size(
        F.aggregate(
            F.transform(usable, keys),
            none,
            lambda groups, k: F.concat(
                F.filter(groups, lambda g: ~F.arrays_overlap(g, k)),
                F.array(F.array_distinct(F.concat(k, F.flatten(F.filter(groups, lambda g: F.arrays_overlap(g, k)))))),
            ),
        )
    )


def gates(c: DataFrame) -> dict[str, Column]:
    """The six hard gates as boolean columns of candidates."""
    ids = F.coalesce(F.col("benchmark_ids"), F.array().cast("array<string>"))
    known = (F.size(ids) > 0) & F.forall(ids, lambda i: i.rlike(r"^BENCH-[A-Z0-9]+$"))
    return {
        "paid_market": known & F.arrays_overlap(signal_types(F.col("payment_signals")), F.array(*[F.lit(t) for t in MARKET_TYPES])),
        "clear_payer": present(F.col("payer")),
        "current_alternative": present(F.col("current_alternative")),
        "product_gap": present(F.col("product_gap")),
        "acquisition_channel": present(F.col("acquisition_channel")),
        "mvp_within_30_days": F.coalesce(F.col("mvp_days").between(1, 30), F.lit(False)) & present(F.col("mvp_scope")),
    }


def failed_gates(passed: dict[str, Column]) -> Column:
    """Names of the gates that don't pass, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in passed.items()]))


def tier(failed: Column, local: Column, unverified: Column, sources: Column, transfer: Column, reason: Column, demand: Column) -> Column:
    """A, R, B or null, in that order of rules; a failed gate rules out all."""
    return F.when(F.size(failed) > 0, F.lit(None).cast("string")).when(local & (F.size(unverified) == 0) & (sources >= 2), "A").when(
        transfer & ~local & present(reason), "R"
    ).when(F.arrays_overlap(demand, F.array(*[F.lit(t) for t in DEMAND_TYPES])), "B")


def classified(candidates: DataFrame) -> DataFrame:
    """``candidates`` with failed_gates, evidence_tier and rejection_reasons."""
    source, target = identity_text(F.col("source_region")), identity_text(F.col("target_region"))
    rows = candidates.withColumns({
        "failed_gates": failed_gates(gates(candidates)),
        "_local": local_payment(F.col("payment_signals"), F.col("evidence"), F.col("target_region")),
        "_sources": independent_sources(qualifying(F.col("evidence"))),
        "_demand": signal_types(F.col("demand_signals")),
    })
    found = tier(
        F.col("failed_gates"), F.col("_local"), F.coalesce(F.col("unverified_hypotheses"), F.array().cast("array<string>")), F.col("_sources"),
        (source != "") & (target != "") & (source != target), F.col("transfer_reason"), F.col("_demand"),
    )
    rows = rows.withColumn("evidence_tier", found)
    why = F.when(F.col("evidence_tier").isNotNull(), F.array().cast("array<string>")).when(F.size("failed_gates") > 0, F.col("failed_gates"))
    return rows.withColumn("rejection_reasons", why.otherwise(F.array(F.lit("missing_demand_or_local_payment_proof")))).drop("_local", "_sources", "_demand")


def families(candidates: DataFrame, family: str, tier_col: str, order: str) -> DataFrame:
    """One row per family: its best variant (A before B before R before none, then first), and how many it has."""
    level = F.when(F.col(tier_col) == "A", 0).when(F.col(tier_col) == "B", 1).when(F.col(tier_col) == "R", 2).otherwise(3)
    rest = [c for c in candidates.columns if c != family]
    return candidates.groupBy(family).agg(F.min_by(F.struct(*rest), F.struct(level, order)).alias("_row"), F.count("*").alias("variants"), F.min(order).alias("first")).select(
        family, "_row.*", "variants", "first"
    )


def capped(rows: DataFrame, tier_col: str, order: str, caps: dict[str, int] | None = None) -> DataFrame:
    """``rows`` with bucket: emitted or overflow past a tier's cap. Nothing is dropped."""
    caps = CAPS if caps is None else caps
    limit = F.lit(None).cast("int")
    for name, n in caps.items():
        limit = F.when(F.col(tier_col) == name, F.lit(n)).otherwise(limit)
    return numbered_within(rows, [tier_col], [order], "nth").withColumn("bucket", F.when(F.col("nth") > limit, "overflow").otherwise("emitted"))


def near_misses(rejected: DataFrame, reasons: str, key: str, n: int = 20) -> DataFrame:
    """The top-n report of rejected candidates: fewest failed gates first."""
    return rejected.orderBy(F.size(reasons), key).limit(n)


def tier_summary(rows: DataFrame, tier_col: str = "evidence_tier", bucket: str = "bucket") -> DataFrame:
    """Counts of candidates by tier, shown, qualified and rejected."""
    t, shown = F.col(tier_col), F.col(bucket) == "emitted"
    return rows.agg(
        F.count("*").alias("families"),
        F.count_if(t == "A").alias("tier_a"),
        F.count_if((t == "B") & shown).alias("tier_b"),
        F.count_if((t == "R") & shown).alias("tier_r"),
        F.count_if(t == "B").alias("tier_b_qualified"),
        F.count_if(t == "R").alias("tier_r_qualified"),
        F.count_if(t.isNull()).alias("rejected"),
    )


def axis(values: Column) -> Column:
    """An axis' values without those that repeat another when normalised; the first stays."""
    marked = F.transform(values, lambda v, i: F.struct(fold(v).alias("k"), i.alias("i"), v.alias("v")))
    first = F.filter(marked, lambda x: ~F.exists(marked, lambda y: (y["k"] == x["k"]) & (y["i"] < x["i"])))
    return F.transform(first, lambda x: x["v"])


def expanded(benchmarks: DataFrame, limit: int = 200, scans: int = 5000) -> DataFrame:
    """Candidates of all combinations of six axes (array columns), dealt in turns over benchmarks.

    Axes lose repeats first. Turn by turn, each benchmark (by ``pos``) gives its next combination,
    ``scans`` in all; the first ``limit`` distinct candidates stay. A combination's number spells
    its place on each axis, so those past the budget are never made. Every benchmark gives at
    least one, so only the first ``scans`` of them matter; their numbers of combinations, that many
    at the most, say how many turns the budget lasts. So about as many rows are made as are
    scanned, whatever the number of benchmarks, and identifiers only of those.
    """
    rows = benchmarks.orderBy("pos").limit(scans).withColumns({a: F.when(F.size(axis(F.col(a))) > 0, axis(F.col(a))).otherwise(F.array(F.lit(None).cast("string"))) for a in AXES})
    total = F.lit(1).cast("long")
    for a in AXES:
        total = total * F.size(a)
    rows = materialise(rows.withColumn("_total", F.least(total, F.lit(scans))), "benchmarks")
    totals = [r[0] for r in rows.select("_total").collect()]
    turns = bisect_left(range(scans), scans, key=lambda t: sum(min(n, t) for n in totals))
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_total"), F.lit(turns)) - 1)))
    rest = F.col("turn")
    picks = {}
    for a in reversed(AXES):
        picks[a.removesuffix("s")] = F.get(F.col(a), (rest % F.size(a)).cast("int"))
        rest = F.floor(rest / F.size(a))
    rows = rows.withColumns(picks).drop(*AXES, "_total")
    names = [a.removesuffix("s") for a in AXES]
    key = F.concat(F.lit("CAND-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "benchmark_id", *[F.coalesce(identity_text(F.col(n)), F.lit("")) for n in names]), 256), 1, 10)))
    budget = rows.orderBy("turn", "pos").limit(scans)  # so the window has few rows
    scanned = budget.withColumn("candidate_id", key).withColumn("scan", F.row_number().over(Window.orderBy("turn", "pos")))
    first = F.min("scan").over(Window.partitionBy("candidate_id"))
    return scanned.withColumn("_first", first).where("scan = _first").drop("_first").orderBy("scan").limit(limit)


def hypotheses(changed: dict[str, tuple[Column, Column]], required: dict[str, Column]) -> Column:
    """Names of fields that differ from their baseline, and of required ones that are unknown."""
    moved = [F.when(identity_text(v) != identity_text(base), F.lit(name)) for name, (v, base) in changed.items()]
    unknown = [F.when(v.isNull(), F.lit(name)) for name, v in required.items()]
    return F.array_compact(F.array(*moved, *unknown))


def family_key(*parts: Column) -> Column:
    return fingerprint(*parts)


def scored(candidates: DataFrame, track: str = "track", scores: str = "scores") -> DataFrame:
    """``candidates`` with total_score and recommendation by the weights of their track.

    A track or score that is missing, or a score outside 0 to 10, gives a null total.
    """
    total = F.lit(None).cast("double")
    for name, weights in WEIGHTS.items():
        valid, s = F.lit(True), F.lit(0.0)
        for field, w in weights.items():
            value = F.element_at(F.col(scores), field)
            valid = valid & F.coalesce(value.between(0, 10), F.lit(False))
            s = s + value * w
        total = F.when(F.col(track) == name, F.when(valid, F.round(s, 1))).otherwise(total)
    label = F.when(F.col("total_score") >= 75, "推荐").when(F.col("total_score") >= 60, "重点观察").when(F.col("total_score").isNotNull(), "早期信号")
    return candidates.withColumn("total_score", total).withColumn("recommendation", label)


def ranked(rows: DataFrame, score: str, order: str, partition: list[str] | None = None) -> DataFrame:
    """``rows`` with ``rank`` by falling score; ties keep their order."""
    return numbered_within(rows, partition or [], [F.col(score).desc_nulls_last(), order], "rank")


def prioritised(candidates: DataFrame, priorities: DataFrame, axes: dict[str, str]) -> DataFrame:
    """``candidates`` with the sum of the priorities that match their axis values.

    ``priorities``: axis, value, priority; ``axes`` maps axis names to columns. All candidates stay.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.lower(F.trim(F.col(c))).alias("value")) for a, c in axes.items()])
    wanted = priorities.select("axis", F.lower(F.trim("value")).alias("value"), "priority")
    sums = candidates.select("candidate_id", F.explode(pairs).alias("p")).select("candidate_id", "p.*").join(wanted, ["axis", "value"]).groupBy("candidate_id").agg(F.sum("priority").alias("axis_priority"))
    return candidates.join(sums, "candidate_id", "left").fillna(0, ["axis_priority"])


def fit(needed: Column, owned: Column) -> Column:
    """pass, conflict or unknown of what is needed against what is there (arrays of text)."""
    norm = lambda a: F.transform(a, fold)
    return F.when(F.size(needed) == 0, "pass").when(needed.isNull() | owned.isNull(), "unknown").when(
        F.size(F.array_except(norm(needed), norm(owned))) > 0, "conflict"
    ).otherwise("pass")


def within(value: Column, cap: Column) -> Column:
    """pass, conflict or unknown of an estimate against a limit."""
    return F.when(value.isNull() | cap.isNull(), "unknown").when(value <= cap, "pass").otherwise("conflict")


def action(*checks: Column) -> Column:
    """What to do next: park on any conflict, clarify on any unknown, else validate."""
    found = F.array(*checks)
    return F.when(F.array_contains(found, "conflict"), "park").when(F.array_contains(found, "unknown"), "clarify").otherwise("validate")


#: Names of the checks, what they say, and what follows from them (fixed values).
SKILLS, LANGUAGES, CHANNEL, HOURS, BUDGET, DAYS = "技能", "语言", "渠道", "本周验证时间", "验证预算 USD", "MVP 工期"
PLAN_TEXTS = ("hypothesis", "success_criteria", "stop_criteria")
NOTHING_NEEDED, NOT_FILLED, MISSING, MATCHES = "已明确没有额外要求", "尚未填写项目要求或个人能力", "缺少：", "符合已填写要求"
NO_CHANNEL, REACHABLE, UNREACHABLE = "尚未确认具体获客入口", "入口在个人已确认可触达的渠道中", "该渠道尚不在个人可触达入口中"
NO_ESTIMATE, ESTIMATE, LIMIT, FILLED, TO_FILL = "缺少估算或个人上限", "估算 ", "；上限 ", "已填写", "验证前需补齐"
NEXT_ACTIONS = {"park": "先解决资源或渠道冲突", "clarify": "补齐未知项后再安排实验", "validate": "执行小规模验证并记录真实行为"}


def _check(name: str, status: Column, reason: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), status.alias("status"), reason.alias("reason"))


def _ability(name: str, needed: Column, owned: Column) -> Column:
    norm = lambda a: F.transform(a, fold)
    lacking = F.array_sort(F.array_except(norm(needed), norm(owned)))
    status = fit(needed, owned)
    reason = F.when(F.size(needed) == 0, NOTHING_NEEDED).when(status == "unknown", NOT_FILLED).when(status == "pass", MATCHES)
    return _check(name, status, reason.otherwise(F.concat(F.lit(MISSING), F.array_join(lacking, "、"))))


def _estimate(name: str, value: Column, cap: Column) -> Column:
    status = within(value, cap)
    said = F.concat(F.lit(ESTIMATE), value.cast("string"), F.lit(LIMIT), cap.cast("string"))
    return _check(name, status, F.when(status == "unknown", NO_ESTIMATE).otherwise(said))


def assessed(candidates: DataFrame, plan: dict[str, Column], profile: dict[str, Column]) -> DataFrame:
    """``candidates`` with what speaks for or against their next validation, given what a founder has.

    ``plan``: required_skills, required_languages (arrays), acquisition_channel, hours, budget_usd,
    mvp_days, hypothesis, success_criteria, stop_criteria; ``profile``: skills, languages,
    reachable_channels (arrays), weekly_hours, validation_budget_usd, max_mvp_days. What is missing
    of either counts as not filled in. Adds checks (check, status, reason), conflicts, unknowns, action,
    next_action and market_validated, which no fit ever makes true. Columns of these names are replaced.
    """
    p = {k: plan.get(k, F.lit(None).cast("array<string>" if k.startswith("required_") else "string")) for k in ("required_skills", "required_languages", "acquisition_channel", *PLAN_TEXTS)}
    own = {k: profile.get(k, F.lit(None).cast("array<string>")) for k in ("skills", "languages", "reachable_channels")}
    number = lambda of, k: of.get(k, F.lit(None).cast("double"))
    channel, reach = p["acquisition_channel"], own["reachable_channels"]
    unsure = channel.isNull() | (F.trim(channel) == "") | reach.isNull()
    known = F.array_contains(F.transform(reach, fold), fold(channel))
    entry = F.when(unsure, "unknown").when(known, "pass").otherwise("conflict")
    filled = {k: F.trim(F.coalesce(p[k], F.lit(""))) != "" for k in PLAN_TEXTS}
    checks = [
        _ability(SKILLS, p["required_skills"], own["skills"]), _ability(LANGUAGES, p["required_languages"], own["languages"]),
        _check(CHANNEL, entry, F.when(unsure, NO_CHANNEL).when(known, REACHABLE).otherwise(UNREACHABLE)),
        _estimate(HOURS, number(plan, "hours"), number(profile, "weekly_hours")), _estimate(BUDGET, number(plan, "budget_usd"), number(profile, "validation_budget_usd")),
        _estimate(DAYS, number(plan, "mvp_days"), number(profile, "max_mvp_days")),
        *[_check(k, F.when(filled[k], "pass").otherwise("unknown"), F.when(filled[k], FILLED).otherwise(TO_FILL)) for k in PLAN_TEXTS],
    ]
    of = lambda status: F.transform(F.filter("checks", lambda c: c["status"] == status), lambda c: c["check"])
    rows = candidates.withColumn("checks", F.array(*checks)).withColumns({"conflicts": of("conflict"), "unknowns": of("unknown")})
    rows = rows.withColumn("action", F.when(F.size("conflicts") > 0, "park").when(F.size("unknowns") > 0, "clarify").otherwise("validate"))
    said = F.coalesce(*[F.when(F.col("action") == k, v) for k, v in NEXT_ACTIONS.items()])
    return rows.withColumns({"next_action": said, "market_validated": F.lit(False)})


def chosen(rows: DataFrame, key: str, order: list[str | Column], alternatives: int = 2) -> DataFrame:
    """One row: the first candidate by ``order`` that is ready to validate, and the next few.

    Only those few leave their tasks. Without any the first is null and the list empty.
    """
    ready = rows.where("action = 'validate'").orderBy(*order).limit(1 + alternatives).select(key)
    ids = [r[0] for r in ready.collect()]
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(ids[0] if ids else None, ids[1:])], f"primary_validation {kind}, alternatives array<{kind}>")
