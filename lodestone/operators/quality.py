"""Lexical relevance, status roll-ups, reposts and deduplication."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shared import materialise
from lodestone.functions.text import BROAD_TERMS, query_terms, scripts, terms
from lodestone.functions.times import window_status
from lodestone.functions.urls import content_url
from lodestone.operators.ranks import numbered_within

#: States of a request that count as failures (fixed values).
FAILURES = ("error", "auth-required", "rate-limited", "skipped-policy", "partial", "unrecognized_response", "upstream_error", "partial_parse")
#: Characters of a query and of a text, as cleaned, that relevance is judged by (fixed value).
READ = 4000


def overlap(wanted: Column, found: Column) -> Column:
    """The share of ``wanted`` terms that are found, to four places; 0 for none wanted."""
    return F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(wanted, found)) / F.size(wanted), 4)).otherwise(F.lit(0.0))


def lexical(wanted: Column, found: Column, shared_script: Column) -> Column:
    """struct(local_relevance, relevance_status, relevance_reason, lexical_status, matched_terms, anchors).

    A strong match has a matched term that isn't broad, and is the whole of a one-term query or
    at least two terms and 35 % of them.
    """
    matched = F.array_sort(F.array_intersect(wanted, found))
    anchors = F.array_except(matched, F.array(*[F.lit(t) for t in BROAD_TERMS]))
    score, n = overlap(wanted, found), F.size(matched)
    strong = (F.size(anchors) > 0) & (((F.size(wanted) == 1) & (n == 1)) | ((n >= 2) & (score >= 0.35)))
    row = lambda a, b, c: F.struct(F.lit(a).alias("status"), F.lit(b).alias("reason"), F.lit(c).alias("lexical"))
    verdict = (
        F.when((F.size(wanted) == 0) | (F.size(found) == 0), row("unknown", "missing_task_query_or_text", "unassessable"))
        .when(strong, row("relevant", "multiple_task_terms_or_specific_query", "matched"))
        .when(n > 0, row("unknown", "weak_overlap_requires_review", "weak_match"))
        .when(~shared_script, row("unknown", "cross_script_requires_review", "unassessable"))
        .otherwise(row("unrelated", "no_task_term_overlap", "no_match"))
    )
    return F.struct(
        score.alias("local_relevance"),
        verdict["status"].alias("relevance_status"),
        verdict["reason"].alias("relevance_reason"),
        verdict["lexical"].alias("lexical_status"),
        matched.alias("matched_terms"),
        anchors.alias("task_anchor_terms"),
    )


def assessed(
    items: DataFrame, window: tuple[date, date], query: Column, text: Column, published: Column, earliest: Column, latest: Column, semantic: Column | None = None
) -> DataFrame:
    """``items`` with lexical relevance, publication window and what both allow.

    ``semantic`` is the status of a review bound to the revision ('not_reviewed' without one);
    a review overrides the lexical verdict. Terms are computed once per row, before the rules, of the
    first ``READ`` characters of a text as cleaned.
    """
    semantic = F.lit("not_reviewed") if semantic is None else semantic
    prepared = items.withColumns({
        "_want": query_terms(query, READ), "_have": terms(text, READ), "_shared": F.arrays_overlap(scripts(query), scripts(text)), "_review": semantic,
        "window_status": window_status(published, earliest, latest, window),
    })
    judged = prepared.withColumn("_l", lexical(F.col("_want"), F.col("_have"), F.col("_shared")))
    by_hand = F.col("_review") != "not_reviewed"
    status = F.when(by_hand, F.col("_review")).otherwise(F.col("_l.relevance_status"))
    recent = F.col("window_status") == "in_window"
    return judged.withColumns({
        "local_relevance": F.col("_l.local_relevance"), "relevance_status": status,
        "relevance_reason": F.when(by_hand, "explicit_semantic_review").otherwise(F.col("_l.relevance_reason")),
        "lexical_status": F.col("_l.lexical_status"), "matched_terms": F.col("_l.matched_terms"), "task_anchor_terms": F.col("_l.task_anchor_terms"),
        "relevance_basis": F.when(by_hand, "semantic_review").otherwise("lexical_screening"),
        "requires_semantic_review": F.col("_review").isin("not_reviewed", "unknown"),
        "recent_lexical_match": (F.col("_l.lexical_status") == "matched") & recent,
        "recent_semantically_verified": (F.col("_review") == "relevant") & recent,
        "recent_evidence_eligible": (status == "relevant") & recent,
    }).drop("_want", "_have", "_shared", "_review", "_l")


def source_status(requests: DataFrame, source: str = "source", status: str = "status") -> DataFrame:
    """One status per source: its failure if all requests had the same, partial with others beside it,
    else ok if any was, else no-results."""
    failed = F.col(status).isin(*FAILURES)
    g = requests.groupBy(source).agg(
        F.bool_or(failed).alias("failed"), F.min(status).alias("low"), F.max(status).alias("high"), F.bool_or(F.col(status) == "ok").alias("ok")
    )
    rule = F.when(F.col("failed"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("partial")).when(F.col("ok"), "ok").otherwise("no-results")
    return g.select(source, rule.alias("status"))


def reposts(items: DataFrame, key: str, url: str, comment: Column | None = None) -> DataFrame:
    """``items`` with duplicate_of: the first item (by key) that shows the same address; comments stand alone."""
    address = content_url(F.col(url))
    stands = F.col(url).isNull() | (F.col(url) == "") | (F.lit(False) if comment is None else F.coalesce(comment, F.lit(False)))
    place = F.when(~stands, address)
    first = materialise(items.where(~stands).groupBy(address.alias("_place")).agg(F.min(key).alias("_first")), "first")  # a plain join then, whose hot keys Spark splits
    joined = items.withColumn("_at", place).join(first, F.col("_at") == F.col("_place"), "left")
    return joined.withColumn("duplicate_of", F.when(F.col("_first") != F.col(key), F.col("_first"))).drop("_at", "_place", "_first")


def first_of_each(rows: DataFrame, by: list[Column], order: Column, merge: dict[str, str] | None = None) -> DataFrame:
    """The first row of each group, with array columns of the whole group merged.

    ``merge`` names columns and the arrays they become. Aggregates combine before the shuffle.
    """
    keys = [c.alias(f"_k{i}") for i, c in enumerate(by)]
    whole = F.min_by(F.struct(*rows.columns), order).alias("_row")
    sets = [F.array_sort(F.collect_set(c)).alias(name) for c, name in (merge or {}).items()]
    return rows.groupBy(*keys).agg(whole, F.count("*").alias("copies"), *sets).select("_row.*", "copies", *(merge or {}).values())


def evidence_identity(source: Column, key: Column, url: Column, text: Column) -> Column:
    """What makes two collected rows the same: source with id, else url, else text digest."""
    shown = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("|", source, F.coalesce(shown(key), shown(url), F.sha2(F.coalesce(text, F.lit("")), 256)))


def best_rank_merge(rows: DataFrame, url: str, rank: Column, position: Column) -> DataFrame:
    """Rows with the same address as one: text of the first, quality of the best ranked, all query ids."""
    return rows.groupBy(content_url(F.col(url)).alias("canonical")).agg(
        F.min_by(F.struct("id", "original_text", "author"), position).alias("first"),
        F.max_by("quality", F.struct(rank, (-position).alias("early"))).alias("quality"),
        F.array_sort(F.collect_set("query_id")).alias("query_ids"),
        F.count("*").alias("copies"),
    )


def merged_requests(requests: DataFrame, fingerprint: str, order: str, arrays: list[str]) -> DataFrame:
    """Requests of one fingerprint as one: the first stays, arrays of all are joined in order, each value once.

    Values are made distinct before they are gathered, so a request that is repeated without end
    gathers no more than the different values it had.
    """
    rest = [c for c in requests.columns if c not in arrays]
    found = requests.groupBy(F.col(fingerprint).alias("_f")).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    none = {a: F.array().cast(requests.schema[a].dataType) for a in arrays}
    for k, a in enumerate(arrays):
        each = requests.select(F.col(fingerprint).alias(f"_f{k}"), F.col(order).alias("_o"), F.posexplode(a).alias("_p", "_value"))
        once = each.groupBy(f"_f{k}", "_value").agg(F.min(F.struct("_o", "_p")).alias("_at"))
        joined = once.groupBy(f"_f{k}").agg(F.array_sort(F.collect_list(F.struct("_at", "_value"))).alias("_all"))
        joined = materialise(joined.select(f"_f{k}", F.col("_all._value").alias(f"_a{k}")), "merged")
        found = found.join(joined, F.col("_f").eqNullSafe(F.col(f"_f{k}")), "left").withColumn(f"_a{k}", F.coalesce(f"_a{k}", none[a]))
    return found.select("_row.*", *[F.col(f"_a{k}").alias(a) for k, a in enumerate(arrays)])


def engagement_rank(rows: DataFrame, relevance: Column, score: Column, recent: Column, engagement: Column, partition: list[str], order: str) -> DataFrame:
    """``rows`` with ``rank`` in each partition: relevance class, lexical score, recency, then log engagement."""
    level = F.when(relevance == "relevant", 2).when(relevance == "unknown", 1).otherwise(0)
    total = F.log1p(F.aggregate(F.map_values(engagement), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))
    keys = {"_level": level, "_score": score, "_recent": recent, "_total": F.coalesce(total, F.lit(0.0))}
    by = [F.col(k).desc() for k in keys]
    return numbered_within(rows.withColumns(keys), partition, [*by, order], "rank").drop(*keys)
