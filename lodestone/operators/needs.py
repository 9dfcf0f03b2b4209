"""User observations, task families and demand clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ids import prefixed
from lodestone.functions.text import fold, identity_text

#: Feedback that shows a need at first hand (fixed values).
DIRECT_TYPES = ("complaint", "workaround", "request", "positive_behavior", "payment", "question")
POSITIVE_BEHAVIORS = ("repeat_usage", "repeat_purchase", "creative_output", "learning_progress", "task_completion", "organic_sharing", "community_participation")


def _parts(*texts: Column, constraints: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    limits = F.array_sort(F.array_distinct(F.transform(none if constraints is None else F.coalesce(constraints, none), fold)))
    return F.to_json(F.struct(limits.alias("constraints"), *[identity_text(t).alias(f"t{i}") for i, t in enumerate(texts)]))


def identified(observations: DataFrame, product: str | None = None) -> DataFrame:
    """``observations`` with task_family_id, cluster_id and observation_id.

    A family is who does what under which constraints; a cluster adds the need; an observation
    the quotes. Products aren't part of any, so one need spans products; the first contract's
    clusters, for which ``product`` names a column, are needs of one product, whatever the
    constraints.
    """
    user, task, limits = F.col("target_user"), F.col("task"), F.col("constraints")
    refs = F.array_sort(F.col("evidence_refs"))
    rows = observations.withColumns({
        "task_family_id": prefixed("TASK", _parts(user, task, constraints=limits), 16),
        "cluster_id": prefixed("NEED", _parts(F.col(product), user, task, F.col("need")) if product else _parts(user, task, F.col("need"), constraints=limits), 16),
    })
    return rows.withColumn("observation_id", prefixed("OBS", F.concat_ws("|", "cluster_id", F.to_json(refs)), 16))


def merged(observations: DataFrame) -> DataFrame:
    """One row per observation: products, industries and query terms of repeats are joined."""
    sets = ("products", "industry_ids", "query_terms")
    rest = [c for c in observations.columns if c not in (*sets, "observation_id")]
    return observations.groupBy("observation_id").agg(
        F.min(F.struct(*rest)).alias("_row"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets]
    ).select("observation_id", "_row.*", *sets)


def clusters(observations: DataFrame) -> DataFrame:
    """Needs that users show at first hand, demos aside; what they show is not a validated market."""
    direct = observations.where(F.col("feedback_type").isin(*DIRECT_TYPES) & ~F.coalesce("is_demo", F.lit(False)))
    ids = F.transform("evidence_refs", lambda r: r["evidence_id"])
    return direct.withColumn("_ids", ids).groupBy("cluster_id").agg(
        F.first("task_family_id").alias("task_family_id"),
        F.min(F.struct("target_user", "task", "need")).alias("about"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(n) for c, n in {"products": "products", "industry_ids": "industry_ids", "sources": "sources", "_ids": "evidence_ids"}.items()],
        F.array_sort(F.collect_set("observation_id")).alias("observation_ids"),
        F.lit(False).alias("market_validated"),
    )


def summary(observations: DataFrame) -> DataFrame:
    """Counts over all observations and clusters, one row."""
    direct = F.col("feedback_type").isin(*DIRECT_TYPES) & ~F.coalesce("is_demo", F.lit(False))
    return observations.agg(
        F.count("*").alias("observation_count"),
        F.count_distinct(F.when(direct, F.col("cluster_id"))).alias("demand_cluster_count"),
        F.count_distinct(F.when(direct, F.col("task_family_id"))).alias("task_family_count"),
        F.count_if(direct & ((F.col("feedback_type") == "positive_behavior") | F.col("behavior_type").isin(*POSITIVE_BEHAVIORS))).alias("positive_behavior_count"),
    )


def with_families(evidence: DataFrame, observations: DataFrame) -> DataFrame:
    """``evidence`` with the task families of the observations that quote it."""
    pairs = observations.select("task_family_id", F.explode("evidence_refs.evidence_id").alias("evidence_id"))
    found = pairs.groupBy("evidence_id").agg(F.array_sort(F.collect_set("task_family_id")).alias("task_family_ids"))
    return evidence.join(found, "evidence_id", "left")
