"""Validation: rules as named conditions, and the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import fold, only_latin

#: What says nothing about the use of a model (fixed values, folded).
EMPTY_VALUES = ("", "未知", "待验证", "ai", "ai赋能", "加聊天框", "提升效率", "unknown", "tbd", "这是需要验证的事情")
VALUE_FIELDS = ("baseline", "capability", "user_benefit", "incremental_advantage")
#: Lead states (fixed values).
LEAD_STATES = ("needs_verification", "observed_need", "archived", "disproven", "promoted", "needs_review")
#: Evidence states that can't carry a current conclusion (fixed values).
UNSURE = ("ambiguous", "superseded", "derivation_superseded", "needs_review", "deleted", "removed")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``violations``: the names of the rules that don't hold, in order. Null counts as broken."""
    broken = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)))


def strict(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` unchanged; the job fails at the first one that breaks a rule, and says which."""
    checked = violations(rows, rules)
    why = F.concat(F.lit("broken rules: "), F.array_join("violations", ", "))
    ok = F.when(F.size("violations") > 0, F.raise_error(why)).otherwise(F.lit(True))
    return checked.where(ok.cast("boolean")).drop("violations")


def text_rule(name: str, most: int = 4000) -> Column:
    """Whether a text column says something and isn't too long."""
    return (F.trim(F.coalesce(F.col(name), F.lit(""))) != "") & (F.length(name) <= most)


def list_rule(name: str, most: int, allowed: list[str] | None = None, least: int = 1) -> Column:
    """Whether an array column has distinct, non-blank and allowed values within the limits."""
    a = F.col(name)
    ok = F.size(a).between(least, most) & (F.size(F.array_distinct(a)) == F.size(a)) & F.forall(a, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return ok if allowed is None else ok & (F.size(F.array_except(a, F.array(*[F.lit(v) for v in allowed]))) == 0)


def meaningful_value(value: Column) -> Column:
    """Whether a struct describes what a model adds: four different texts of some length, and for
    'supported' a review and quotes. It says nothing about whether that is true."""
    said = F.array(*[fold(value[f]) for f in VALUE_FIELDS])
    long_enough = F.forall(F.array(*[F.coalesce(F.length(F.trim(value[f])), F.lit(0)) for f in VALUE_FIELDS]), lambda n: n >= 6)
    plain = F.size(F.array_distinct(said)) == len(VALUE_FIELDS)
    empty = F.arrays_overlap(said, F.array(*[F.lit(v) for v in EMPTY_VALUES]))
    review, refs = value["review"], value["evidence_refs"]
    full = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    backed = full(review["reviewer"]) & full(review["reviewed_at"]) & full(review["rationale"]) & (F.size(refs) > 0)
    backed = backed & F.forall(refs, lambda r: full(r["evidence_id"]) & full(r["revision_id"]) & full(r["quote"]))
    status = value["status"]
    return F.coalesce(plain & long_enough & ~empty & ((status == "hypothesis") | ((status == "supported") & F.coalesce(backed, F.lit(False)))), F.lit(False))


def lead_rules(industries: list[str]) -> dict[str, Column]:
    """What a research lead must show."""
    texts = {f"no {c}": text_rule(c) for c in ("title", "target_user", "problem_or_desire", "wedge")}
    number = F.col("lead_id").isNull() | F.col("lead_id").rlike("^LEAD-[A-F0-9]{12,32}$")
    return texts | {"industry not allowed": list_rule("industry_ids", 1000, industries), "lead_id malformed": number}


def request_rules(endpoints: dict[str, str], methods: tuple[str, ...] = ("GET", "POST"), most_params: int = 20) -> dict[str, Column]:
    """What a planned request must be: a known source's endpoint, a method, and plain parameters without secrets."""
    known = F.create_map(*[F.lit(x) for pair in sorted(endpoints.items()) for x in pair])
    secret = r"(?i)(token|secret|password|cookie|authorization|api[_-]?key)"
    keys = F.map_keys("params")
    return {
        "unknown source": F.col("source").isin(*sorted(endpoints)),
        "other endpoint": F.element_at(known, F.col("source")) == F.col("endpoint"),
        "method": F.col("method").isin(*methods),
        "too many params": F.size("params") <= most_params,
        "secret in params": ~F.exists(keys, lambda k: k.rlike(secret)),
    }


def catalogue_rules() -> dict[str, Column]:
    """What an industry of the catalogue must have: id, texts, and tasks of different ids."""
    ids = F.transform("subtracks", lambda s: s["id"])
    return {
        "id malformed": F.col("id").rlike("^[a-z][a-z0-9_]{1,63}$"),
        "no name": text_rule("name", 200),
        "no audience": text_rule("audience", 500),
        "subtrack ids": (F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)),
    }


def reference_issue(known: Column, retracted: Column, status: Column, current: Column, revision: Column) -> Column:
    """Why a reference can't carry a current conclusion: missing, withdrawn, unsure or changed; null if it can."""
    gone = F.coalesce(retracted, F.lit(False)) | F.coalesce(status, F.lit("")).isin("retracted", "withdrawn")
    return (
        F.when(~F.coalesce(known, F.lit(False)), "missing").when(gone, "withdrawn").when(F.coalesce(status, F.lit("")).isin(*UNSURE), "unsure")
        .when(~current.eqNullSafe(revision), "changed")
    )


def lead_view(leads: DataFrame, references: DataFrame, states: DataFrame) -> DataFrame:
    """Leads with what is wrong with their references; open ones with an issue need review.

    ``references``: lead_id, evidence_id, revision_id; ``states`` as of ``derivations.current_state``.
    """
    s = states.select(F.col("evidence_id").alias("_id"), "current_revision_id", F.col("status").alias("_status"), "retracted")
    joined = references.join(s, references.evidence_id == s._id, "left")
    issue = reference_issue(F.col("_id").isNotNull(), F.col("retracted"), F.col("_status"), F.col("current_revision_id"), F.col("revision_id"))
    found = joined.withColumn("issue", issue).where("issue is not null").groupBy("lead_id").agg(F.array_sort(F.collect_set(F.struct("evidence_id", "revision_id", "issue"))).alias("reference_issues"))
    rows = leads.join(found, "lead_id", "left")
    reopened = F.col("reference_issues").isNotNull() & ~F.col("research_status").isin("archived", "disproven", "promoted")
    return rows.withColumns({"stored_research_status": F.when(reopened, F.col("research_status")), "research_status": F.when(reopened, "needs_review").otherwise(F.col("research_status"))})


def unverified(changed: Column, verified: Column) -> Column:
    """Changed fields (map name -> value) whose value no check (map name -> value) confirms."""
    return F.map_keys(F.map_filter(changed, lambda k, v: v.isNull() | ~F.coalesce(fold(F.element_at(verified, k)) == fold(v), F.lit(False))))


def future_nested(nested: Column, cutoff: Column, clock: str = "published_at") -> Column:
    """Whether anything in an array of structs is from after the cutoff."""
    return F.exists(nested, lambda x: F.coalesce(x[clock] > cutoff, F.lit(False)))


def intent_rules(sources: list[str], roles: list[str], english_only: tuple[str, ...] = ("hackernews", "github")) -> dict[str, Column]:
    """What a search intent must be: named, worded, of a known source, and English where that is all a source has.

    Follow-ups (with a task_family_id) name their purpose, key, checks, observations and evidence.
    """
    follows = F.col("task_family_id").isNotNull()
    refs = F.col("source_evidence_refs")
    whole = F.size(refs).between(1, 20) & F.forall(refs, lambda r: (F.trim(r["evidence_id"]) != "") & (F.trim(r["revision_id"]) != ""))
    followup = text_rule("purpose", 100) & text_rule("query_key", 100) & list_rule("required_checks", 20) & list_rule("source_observation_ids", 20) & whole
    base = F.substring_index("language", "-", 1)
    texts = {f"no {c}": text_rule(c, 100 if c == "search_query" else 1000) for c in ("question", "search_query", "ranking_query")}
    return texts | {
        "id malformed": F.col("id").rlike("^[a-z0-9][a-z0-9._-]{0,39}$") & ~F.col("id").endswith("-"),
        "unknown source": F.col("source").isin(*sources),
        "unknown evidence_type": F.col("evidence_type").isin(*roles),
        "not in English": ~F.col("source").isin(*english_only) | ((base == "en") & only_latin(F.col("search_query"))),
        "too many gaps": F.coalesce(F.size("candidate_gaps"), F.lit(0)) <= 20,
        "followup incomplete": ~follows | F.coalesce(followup, F.lit(False)),
    }


def comparison_rules() -> dict[str, Column]:
    """What a comparison of a baseline and a model must state before, and its measurements after.

    Columns: baseline, ai_variant, task_selection, evaluation_method, planned_sample_size, metrics
    array<struct<id,unit,acceptance_rule>>, measurements array<struct<metric_id,baseline_value,ai_value,sample_size,evidence_ref>>.
    """
    full = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    ids = F.transform("metrics", lambda m: m["id"])
    measured = F.forall(
        F.coalesce(F.col("measurements"), F.slice(F.col("measurements"), 1, 0)),
        lambda r: F.array_contains(ids, r["metric_id"]) & r["baseline_value"].isNotNull() & r["ai_value"].isNotNull() & (r["sample_size"] >= 1) & full(r["evidence_ref"]),
    )
    return {f"no {c}": text_rule(c) for c in ("baseline", "ai_variant", "task_selection", "evaluation_method")} | {
        "planned_sample_size": F.col("planned_sample_size") >= 1,
        "metrics": (F.size("metrics") > 0) & F.forall("metrics", lambda m: full(m["id"]) & full(m["unit"]) & full(m["acceptance_rule"])),
        "metric ids": F.size(F.array_distinct(ids)) == F.size(ids),
        "measurements": F.col("measurements").isNull() | measured,
    }
