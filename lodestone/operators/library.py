"""The evidence library: an append-only observation log and views of it as of a day.

A log has the columns evidence_id, revision_id, observed_at, known_at (when the batch became
known), seq (ingest order), and may have published_at, historical_import, retracted, status, run_id, source,
url, content_hash and event_id. Nothing in the past is rewritten: a late correction has a later
``known_at`` and wins from then on only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shared import materialise

OPTIONAL = {"published_at": "timestamp", "historical_import": "boolean", "retracted": "boolean", "status": "string", "run_id": "string", "source": "string", "url": "string"}


def completed(log: DataFrame) -> DataFrame:
    """``log`` with every optional column, null where it had none."""
    return log.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in log.columns})


def appended(log: DataFrame, batch: DataFrame, key: str = "event_id") -> DataFrame:
    """The log after a batch: events that it has are not added again. Events without a key are one event."""
    held = log.select(F.col(key).alias("_held"))
    new = batch.dropDuplicates([key])
    new = new.join(held, new[key].eqNullSafe(held["_held"]), "left_anti")
    return log.unionByName(new, allowMissingColumns=True)


def distinct_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per event, however often a batch was replayed."""
    return events.dropDuplicates([key])


def is_future(cutoff: Column, clocks: list[str]) -> Column:
    """Whether any clock of a row is after ``cutoff``."""
    late = F.lit(False)
    for c in clocks:
        late = late | F.coalesce(F.col(c) > cutoff, F.lit(False))
    return late


def future_events(batch: DataFrame, cutoff: Column, clocks: list[str]) -> DataFrame:
    """Rows with any clock after ``cutoff``, for quarantine; a strict ingest takes none of the batch."""
    return batch.where(is_future(cutoff, clocks))


def revision_conflicts(log: DataFrame) -> DataFrame:
    """Revisions that stand for more than one content; a valid log has none."""
    found = log.groupBy("evidence_id", "revision_id").agg(F.count_distinct("content_hash").alias("contents"))
    return found.where("contents > 1")


def snapshot(log: DataFrame, cutoff: Column | None, keep: list[str] | None = None, include_retracted: bool = False) -> DataFrame:
    """The current revision of every evidence id, as known by ``cutoff``.

    An event counts if it was observed, known and (where dated) published by then. The latest by
    (known_at, seq) is current, but historical imports never displace what was really seen.
    First and last observation span all events; runs, sources and urls those of the current
    revision. Aggregates alone, so a hot id combines before the shuffle.
    """
    log, keep = completed(log), keep or []
    if cutoff is not None:
        log = log.where((F.col("observed_at") <= cutoff) & (F.col("known_at") <= cutoff) & (F.col("published_at").isNull() | (F.col("published_at") <= cutoff)))
    order = F.struct((~F.coalesce("historical_import", F.lit(False))).alias("seen"), "known_at", "seq")
    by_revision = log.groupBy("evidence_id", "revision_id").agg(
        F.max(order).alias("order"),
        F.max_by(F.struct("retracted", "status", *keep), order).alias("row"),
        F.min("observed_at").alias("first"),
        F.max("observed_at").alias("last"),
        F.count("*").alias("n"),
        *[F.array_sort(F.collect_set(c)).alias(c) for c in ("run_id", "source", "url")],
    )
    current = F.struct("revision_id", "order", "row", "run_id", "source", "url")
    found = by_revision.groupBy("evidence_id").agg(
        F.max_by(current, "order").alias("now"),
        F.min("first").alias("first_observed_at"),
        F.max("last").alias("last_observed_at"),
        F.sum("n").alias("observations"),
        F.count("*").alias("revisions"),
    )
    gone = F.coalesce(F.col("now.row.retracted"), F.lit(False)) | (F.coalesce(F.col("now.row.status"), F.lit("")) == "retracted")
    return (found if include_retracted else found.where(~gone)).select(
        "evidence_id",
        F.col("now.revision_id").alias("revision_id"),
        F.col("now.order.known_at").alias("recorded_on"),
        "first_observed_at",
        "last_observed_at",
        "observations",
        "revisions",
        F.col("now.run_id").alias("run_ids"),
        F.col("now.source").alias("source_labels"),
        F.col("now.url").alias("same_source_refs"),
        gone.alias("retracted"),
        *[F.col(f"now.row.{c}").alias(c) for c in keep],
    )


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two snapshots: added, revised or reobserved. Nothing is ever 'removed'."""
    old = before.select("evidence_id", F.col("revision_id").alias("before_revision_id"), F.col("last_observed_at").alias("before"))
    change = (
        F.when(F.col("before_revision_id").isNull(), "added")
        .when(F.col("before_revision_id") != F.col("revision_id"), "revised")
        .when(F.col("before") != F.col("last_observed_at"), "reobserved")
    )
    joined = after.join(old, "evidence_id", "left").withColumn("change", change)
    return joined.where("change is not null").select("evidence_id", "change", "before_revision_id", F.col("revision_id").alias("after_revision_id"))


def resolved(references: DataFrame, records: DataFrame) -> DataFrame:
    """References to the one record that each means.

    ``references``: ref_id, evidence_id, revision_id, url, quote (each may be null); ``records``:
    evidence_id, revision_id, object_key, url, original_text, aliases (array). An id or alias
    goes before an object key, that before a url; a revision, if given, and the quote must fit.
    Adds match_evidence_id, match_revision_id and problem: null, 'missing' or 'ambiguous'.
    """
    keys = F.array_compact(
        F.flatten(F.array(
            F.array(F.struct(F.lit(1).alias("rank"), F.col("evidence_id").alias("key"))),
            F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit(1).alias("rank"), a.alias("key"))),
            F.array(F.struct(F.lit(2).alias("rank"), F.col("object_key").alias("key")), F.struct(F.lit(3).alias("rank"), F.col("url").alias("key"))),
        ))
    )
    index = records.select("evidence_id", "revision_id", "original_text", F.explode(keys).alias("k")).where("k.key is not null").distinct()
    index = index.select(F.col("evidence_id").alias("_id"), F.col("revision_id").alias("_rev"), F.col("original_text").alias("_text"), F.col("k.key").alias("_key"), F.col("k.rank").alias("_rank"))
    ways = references.select(
        "ref_id", "revision_id", "quote",
        F.explode(F.array(
            F.struct(F.lit(1).alias("rank"), F.col("evidence_id").alias("key")),
            F.struct(F.lit(2).alias("rank"), F.col("evidence_id").alias("key")),
            F.struct(F.lit(3).alias("rank"), F.col("url").alias("key")),
        )).alias("w"),
    ).where("w.key is not null")
    # The least and the greatest match tell one from many, however many there are. Without a quote they follow
    # from the key, and the revision if one is given, so a key that many records share makes no row for each pair.
    match = F.struct("_id", "_rev")
    ends = (F.min(match).alias("low"), F.max(match).alias("high"))
    same = (F.col("w.key") == F.col("_key")) & (F.col("w.rank") == F.col("_rank"))
    of_key = materialise(index.groupBy("_key", "_rank").agg(*ends), "keys")  # plain joins then, of which Spark splits the hot side
    of_revision = materialise(index.where("_rev is not null").groupBy("_key", "_rank", "_rev").agg(*ends), "revisions")
    unquoted = ways.where("quote is null")
    parts = [
        unquoted.where("revision_id is null").join(of_key, same).select("ref_id", "w.rank", "low", "high"),
        unquoted.where("revision_id is not null").join(of_revision, same & (F.col("revision_id") == F.col("_rev"))).select("ref_id", "w.rank", "low", "high"),
        ways.where("quote is not null").join(index, same).where((F.col("revision_id").isNull() | (F.col("revision_id") == F.col("_rev"))) & F.contains(F.col("_text"), F.col("quote")))
        .select("ref_id", "w.rank", match.alias("low"), match.alias("high")),
    ]
    hits = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = hits.groupBy("ref_id", "rank").agg(F.struct(F.min("low").alias("low"), F.max("high").alias("high")).alias("found"))
    best = best.groupBy("ref_id").agg(F.min_by("found", "rank").alias("found"))
    one = F.when(F.col("found.low") == F.col("found.high"), F.col("found.low"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found.low") != F.col("found.high"), "ambiguous")
    return references.join(best, "ref_id", "left").withColumns({"match_evidence_id": one["_id"], "match_revision_id": one["_rev"], "problem": problem}).drop("found")


def latest_reviews(reviews: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """The review that holds for each (evidence_id, revision_id): latest by (reviewed_at, known_on, seq)."""
    if cutoff is not None:
        reviews = reviews.where(F.col("reviewed_at") <= cutoff)
    rest = [c for c in reviews.columns if c not in ("evidence_id", "revision_id")]
    order = F.struct("reviewed_at", "known_on", "seq")
    return reviews.groupBy("evidence_id", "revision_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("evidence_id", "revision_id", "r.*")


def reviewed(evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """Evidence with its review ``status`` and ``role``; not_reviewed where none is bound to the revision."""
    own = reviews.select("evidence_id", "revision_id", F.col("status").alias("_status"), F.col("evidence_role").alias("_role"))
    joined = evidence.join(own, ["evidence_id", "revision_id"], "left")
    return joined.withColumn("semantic_status", F.coalesce("_status", F.lit("not_reviewed"))).withColumnRenamed("_role", "evidence_role").drop("_status")


def migrated(old_to_new: DataFrame) -> DataFrame:
    """Old ids with the new ones they became, and whether that is unique."""
    found = old_to_new.groupBy("old_id").agg(F.array_sort(F.collect_set("new_id")).alias("new_ids"))
    return found.withColumn("ambiguous", F.size("new_ids") > 1)
