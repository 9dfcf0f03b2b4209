"""Coverage, label statistics and research quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a covered topic must show (fixed values).
DIMENSIONS = ("recent_user_behavior", "commercial_benchmark", "alternative", "counter_evidence")
BEHAVIOUR_ROLES = ("user_behavior", "community_behavior", "payment_behavior", "user_feedback")
NOT_MADE = ("not_requested", "skipped-policy", "needs_host_queries", "skipped")
WINDOWS = {"in_window": "recent_evidence_count", "out_of_window": "out_of_window_evidence_count", "uncertain": "uncertain_date_evidence_count", "unknown": "unknown_date_evidence_count"}


def histogram(value: Column, values: list[str]) -> Column:
    """map of value to count, for a few known values, those that occur."""
    counts = F.array(*[F.struct(F.lit(v).alias("k"), F.count_if(value == v).alias("n")) for v in values])
    return F.map_from_entries(F.filter(counts, lambda x: x["n"] > 0))


#: What a label can say (fixed values).
LABELS = {
    "query_match": ["adjacent", "direct", "unknown", "unrelated"],
    "actor": ["editorial", "supplier", "unknown", "user"],
    "signal": ["alternative", "discussion", "payment", "promotion", "task", "unknown"],
}


def label_statistics(material: DataFrame, by: list[list[str]]) -> DataFrame:
    """Label counts over grouping sets; an empty set is the grand total.

    ``material`` has a row per item: query_match, actor and signal (null: unlabelled), and
    window_status. One pass over the items serves all groupings. Histograms are maps of the
    values that occur: of each label, and of the publication windows of direct user signals.
    """
    labelled = F.col("actor").isNotNull()
    direct = (F.col("actor") == "user") & (F.col("query_match") == "direct") & F.col("signal").isin("task", "payment", "alternative")
    unknown = (F.col("actor") == "unknown") | (F.col("query_match") == "unknown") | (F.col("signal") == "unknown")
    names = list(dict.fromkeys(c for group in by for c in group))
    grouped = material.groupingSets([[F.col(c) for c in group] for group in by], *[F.col(c) for c in names])
    found = grouped.agg(
        F.grouping_id().alias("grouping"),
        F.count("*").alias("material_count"),
        F.count_if(labelled).alias("labeled_count"),
        F.count_if(direct).alias("direct_user_signal_count"),
        F.count_if(direct & (F.col("window_status") == "in_window")).alias("recent_direct_user_signal_count"),
        F.count_if(F.col("actor") == "supplier").alias("supplier_count"),
        F.count_if(F.col("signal") == "promotion").alias("promotion_count"),
        F.count_if(unknown).alias("unknown_count"),
        *[histogram(F.when(labelled, F.col(name)), values).alias(f"{name}_counts") for name, values in LABELS.items()],
        histogram(F.when(direct, F.col("window_status")), sorted(WINDOWS)).alias("direct_user_publication_window_counts"),
    )
    n = F.col("labeled_count")
    return found.withColumns({
        "unlabeled_count": F.col("material_count") - n,
        "label_coverage": F.round(n / F.col("material_count"), 4),
        "direct_user_share_of_labeled": F.when(n > 0, F.round(F.col("direct_user_signal_count") / n, 4)),
    })


def coverage(material: DataFrame, by: list[str]) -> DataFrame:
    """Counts of distinct objects by topic.

    ``material``: object_key, source, fresh (of this run), relevance_status, semantic
    (relevant, unrelated or not_reviewed), verified, window_status, role. Objects that aren't
    fresh count as historical alone, and only where the topic has no fresh copy.
    """
    fresh = F.coalesce(F.col("fresh"), F.lit(False))
    reviewed = F.col("semantic").isin("relevant", "unrelated")
    meant = fresh & (F.col("semantic") == "relevant")
    # One row per object of a topic first, so that counting distinct ones needs no second shuffle.
    flags = {
        "material_count": fresh,
        "related_evidence_count": fresh & ((F.col("relevance_status") == "relevant") | (F.col("semantic") == "relevant")),
        "verified_evidence_count": fresh & F.col("verified"),
        "semantic_reviewed_count": fresh & reviewed,
        "semantic_related_count": meant,
        **{name: fresh & (F.col("window_status") == status) for status, name in WINDOWS.items()},
        "recent_user_behavior_count": meant & F.col("role").isin(*BEHAVIOUR_ROLES) & (F.col("window_status") == "in_window"),
        "commercial_benchmark_count": meant & (F.col("role") == "official_pricing") & F.col("verified"),
        "alternative_count": meant & (F.col("role") == "alternative"),
        "counter_evidence_count": meant & (F.col("role") == "counter_evidence"),
    }
    objects = material.groupBy(*by, "object_key").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()], F.collect_set(F.when(fresh, F.col("source"))).alias("_sources"))
    found = objects.groupBy(*by).agg(
        *[F.count_if(n).alias(n) for n in flags],
        F.count_if(~F.col("material_count")).alias("historical_evidence_count"),
        F.count_if(F.col("material_count") & ~F.col("semantic_reviewed_count")).alias("unreviewed_evidence_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_sources")))).alias("sources"),
    )
    return found.withColumn("review_gaps", gaps(F.col("unreviewed_evidence_count")))


def gaps(unreviewed: Column) -> Column:
    """What a topic still lacks, in order."""
    lacking = [F.when(F.col(f"{d}_count") == 0, F.lit(d)) for d in DIMENSIONS]
    return F.array_compact(F.array(*lacking, F.when(unreviewed > 0, F.lit("semantic_review"))))


def topic_status(c: dict[str, Column]) -> Column:
    """The state of a topic from its counts: reviewed, related, material, failures, attempts, scheduled."""
    rule = (
        F.when(c["reviewed"] > 0, "reviewed_evidence").when(c["related"] > 0, "related_material").when(c["material"] > 0, "needs_relevance_review")
        .when(c["failures"] > 0, "collection_failed").when(c["attempts"] > 0, "no_results").when(c["scheduled"], "not_collected").otherwise("not_scheduled")
    )
    return F.when((c["failures"] > 0) & (c["material"] > 0), "partial").otherwise(rule)


def verified_coverage(topics: DataFrame, material: DataFrame, attempts: DataFrame, by: str) -> DataFrame:
    """The first contract's coverage: a row per topic, which only verified evidence makes reviewed.

    ``topics``: the topic and scheduled; ``material``: the topic, object_key, source, fresh,
    relevance_status, verified, is_demo; ``attempts``: the topic, source, request_id, status.
    Requests that were never made don't count as attempts. Demos are material and no more.
    """
    real, fresh = ~F.coalesce("is_demo", F.lit(False)), F.coalesce("fresh", F.lit(False))
    checked = F.coalesce("verified", F.lit(False))
    flags = {
        "material_count": fresh, "related_evidence_count": fresh & real & (checked | (F.col("relevance_status") == "relevant")),
        "verified_evidence_count": fresh & real & checked, "historical_evidence_count": ~fresh,
    }
    objects = material.groupBy(by, "object_key").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    counts = objects.groupBy(by).agg(*[F.count_if(n).alias(n) for n in flags])
    made = attempts.where(~F.coalesce("status", F.lit("")).isin(*NOT_MADE))
    failed = ~F.coalesce("status", F.lit("")).isin("ok", "succeeded", "no-results")
    requests = made.groupBy(by, "source", "request_id").agg(F.bool_or(failed).alias("_failed"))
    requests = requests.groupBy(by).agg(F.count("*").alias("request_count"), F.count_if("_failed").alias("failed_request_count"))
    rows = topics.join(counts, by, "left").join(requests, by, "left").fillna(0, [*flags, "request_count", "failed_request_count"])
    names = {"reviewed": "verified_evidence_count", "related": "related_evidence_count", "material": "material_count", "failures": "failed_request_count", "attempts": "request_count", "scheduled": "scheduled"}
    return rows.withColumn("status", topic_status({k: F.col(c) for k, c in names.items()}))


def research_quality(rows: DataFrame) -> DataFrame:
    """One row: current and historical evidence, reviewed or not, and why there may be no result.

    ``rows``: historical, reviewed, qualified (booleans), one per current object.
    """
    h, r = F.col("historical"), F.col("reviewed")
    found = rows.agg(
        F.count_if(~h).alias("current_evidence_count"),
        F.count_if(~h & r).alias("current_reviewed_evidence_count"),
        F.count_if(~h & ~r).alias("current_unreviewed_evidence_count"),
        F.count_if(h).alias("historical_evidence_count"),
        F.count_if(h & r).alias("historical_reviewed_evidence_count"),
        F.count_if(h & ~r).alias("historical_unreviewed_evidence_count"),
        F.count_if("qualified").alias("qualified_count"),
    )
    open_ = F.col("current_unreviewed_evidence_count") + F.col("historical_unreviewed_evidence_count")
    reason = F.when(F.col("qualified_count") > 0, F.lit(None).cast("string")).when(open_ > 0, "coverage_or_evidence_incomplete")
    return found.withColumn("zero_result_reason", reason.otherwise(F.when(F.col("qualified_count") == 0, F.lit("no_qualified_candidates_in_reviewed_material"))))


def provider_overlap(hits: DataFrame, provider: str = "provider", candidate: str = "candidate_id") -> DataFrame:
    """By provider: candidates found, by it alone, and by others too."""
    each = hits.select(provider, candidate).distinct()
    shared = each.groupBy(candidate).agg(F.collect_set(provider).alias("_p")).select(F.explode("_p").alias(provider), (F.size("_p") > 1).alias("_shared"))
    return shared.groupBy(provider).agg(
        F.count("*").alias("unique_candidate_count"), F.count_if(~F.col("_shared")).alias("exclusive_candidate_count"), F.count_if("_shared").alias("overlap_candidate_count")
    )


def citation_range(start: Column, end: Column, answer_length: Column) -> Column:
    """zero_length, answer_span or unlocated."""
    return F.when(start == end, "zero_length").when((start >= 0) & (start < end) & (end <= answer_length), "answer_span").otherwise("unlocated")


def collection_coverage(pages: DataFrame) -> DataFrame:
    """Comments by source: posts, pages, comments, and posts whose pages weren't all read."""
    posts = pages.groupBy("source", "post_id").agg(F.count_distinct("fingerprint").alias("pages"), F.sum("comments").alias("comments"), F.max_by("has_more", "page").alias("open"))
    return posts.groupBy("source").agg(F.count("*").alias("posts"), F.sum("pages").alias("pages"), F.sum("comments").alias("comments"), F.count_if("open").alias("open_posts"))


#: States of a review task (fixed values), and those that leave it unreviewed.
TASK_STATES = ("pending", "leased", "reviewed", "unknown", "needs_fulltext", "failed", "stale", "excluded")
UNREVIEWED = ("pending", "leased", "unknown", "needs_fulltext", "failed")


def community_statistics(requests: DataFrame, items: DataFrame) -> DataFrame:
    """One row on a collection: what requests brought, what is valid, and how items are spread.

    ``requests``: fetched, parsed, relevant, retained; ``items``: source, kind (evidence or
    comment), eligible, window_status, relevance_status, duplicate.
    """
    sums = requests.agg(F.count("*").alias("requests"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fetched", "parsed", "relevant", "retained")])
    shown = items.where(~F.coalesce("duplicate", F.lit(False)))
    eligible = F.coalesce("eligible", F.lit(False))
    counts = shown.agg(
        F.count_if(eligible & (F.col("kind") == "evidence")).alias("valid_items"), F.count_if(eligible & (F.col("kind") == "comment")).alias("valid_comments"),
        histogram(F.col("window_status"), sorted(WINDOWS)).alias("window_status"), histogram(F.col("relevance_status"), ["relevant", "unknown", "unrelated"]).alias("relevance_status"),
    )
    gone = items.agg(F.count_if(F.coalesce("duplicate", F.lit(False))).alias("duplicates_removed"))
    by_source = shown.groupBy("source").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "count")))).alias("by_source"))
    rows = [x.withColumn("_one", F.lit(1)) for x in (sums, counts, gone, by_source)]  # a row each
    return rows[0].join(rows[1], "_one").join(rows[2], "_one").join(rows[3], "_one").drop("_one")


def normaliser_statistics(statuses: DataFrame) -> DataFrame:
    """By source, over ``parse_status`` rows: requests, items, and requests of unknown or of each parse state.

    A response that isn't recognised has no known number of items, which isn't 0.
    """
    return statuses.groupBy("source").agg(
        F.count("*").alias("requests_seen"), F.coalesce(F.sum("raw_items"), F.lit(0)).alias("raw_items"), F.sum("parsed_items").alias("parsed_items"),
        F.count_if(F.col("raw_items").isNull()).alias("requests_with_unknown_raw_count"), F.sum("skipped_items").alias("skipped_noncontent_items"),
        histogram(F.col("parse_status"), ["empty_result", "parsed", "partial_parse", "unrecognized_response"]).alias("parse_status"),
    )


def queue_summary(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Review tasks by state; what is only leased or unclear counts as unreviewed."""
    return tasks.groupBy(*by).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in TASK_STATES], F.count_if(F.col("status").isin(*UNREVIEWED)).alias("unreviewed_count")
    )


def execution_summary(results: DataFrame) -> DataFrame:
    """By source: requests by outcome, those reused, attempts, and what the attempts are estimated to cost."""
    return results.groupBy("source").agg(
        F.count("*").alias("requests"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "error", "skipped", "outcome_unknown")],
        F.count_if("reused").alias("reused"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.bround(F.sum("cost_usd"), 6).alias("estimated_attempted_cost_usd"),
    )
