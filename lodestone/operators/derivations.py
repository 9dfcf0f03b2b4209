"""Which parsed records still stand when a response is parsed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import version_key


def derive_sets(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """The full set of objects that each parsed response gave, the empty one too.

    ``records``: sha, object_key, content_hash; ``inputs``: sha, parser_version, status.
    """
    members = records.groupBy("sha").agg(F.array_sort(F.collect_set(F.struct("object_key", "content_hash"))).alias("members"))
    none = F.array().cast("array<struct<object_key:string,content_hash:string>>")
    rows = inputs.join(members, "sha", "left").withColumn("members", F.coalesce("members", none))
    digest = F.sha2(F.to_json(F.struct("members", "parser_version", "sha", "status")), 256)
    return rows.withColumn("derive_set_id", F.concat(F.lit("DERIVE-"), F.substring(digest, 1, 24)))


def latest_sets(sets: DataFrame) -> DataFrame:
    """Per response the set of the newest parser; 'conflict' if that version gave different ones."""
    valid = sets.where(version_key(F.col("parser_version")).isNotNull()).withColumn("v", version_key(F.col("parser_version")))
    top = valid.withColumn("r", F.rank().over(Window.partitionBy("sha").orderBy(F.col("v").desc()))).where("r = 1")
    signature = F.struct("status", "members")
    same = F.count_distinct(signature) == 1
    return top.groupBy("sha").agg(
        F.first("v").alias("v"),
        F.when(same, F.min("status")).otherwise("conflict").alias("status"),
        F.when(same, F.min("members")).otherwise(F.array().cast(sets.schema["members"].dataType)).alias("members"),
        F.min("derive_set_id").alias("derive_set_id"),
    )


def decided(records: DataFrame, refs: DataFrame, latest: DataFrame) -> DataFrame:
    """``records`` with derivation_status: active, superseded or needs_review.

    ``records``: record_id, object_key, content_hash; ``refs``: record_id, sha, parser_version.
    Only a newer complete set of the same response that lacks the object supersedes it. It stays
    active while any response still holds it or one that wasn't parsed anew backs it; what is
    unfinished, older, of the same version or in conflict leaves it for review.
    """
    prior = refs.groupBy("record_id", "sha").agg(F.max(version_key(F.col("parser_version"))).alias("prior"))
    joined = prior.join(latest, "sha", "left").join(records.select("record_id", "object_key", "content_hash"), "record_id")
    known = F.col("status").isNotNull()
    holds = known & F.exists("members", lambda m: (m["object_key"] == F.col("object_key")) & (m["content_hash"] == F.col("content_hash")))
    doubt = known & ~holds & ((F.col("status") != "complete") | (F.col("prior").isNotNull() & (F.col("v") <= F.col("prior"))))
    flags = joined.groupBy("record_id").agg(
        F.bool_or(~known).alias("independent"), F.bool_or(holds).alias("held"), F.bool_or(doubt).alias("doubt"),
        F.array_sort(F.collect_set(F.when(known & ~holds & ~doubt, F.col("derive_set_id")))).alias("superseded_by"),
    )
    stands = F.coalesce(F.col("held") | F.col("independent"), F.lit(True))
    gone = (F.size("superseded_by") > 0) & ~F.col("doubt") & F.col("object_key").isNotNull()
    status = F.when(stands, "active").when(gone, "superseded").otherwise("needs_review")
    return records.join(flags, "record_id", "left").withColumn("derivation_status", status).drop("independent", "held", "doubt")


def current_state(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The state of each id as of its last row: 'ambiguous' where it stands for several revisions.

    A retraction of any row counts once revisions differ; else that of the last row.
    """
    g = rows.groupBy(key).agg(
        F.count_distinct("revision_id").alias("n"), F.max_by(F.struct("revision_id", "retracted"), order).alias("last"), F.bool_or("retracted").alias("any")
    )
    return g.select(
        key,
        F.col("last.revision_id").alias("current_revision_id"),
        F.when(F.col("n") > 1, "ambiguous").otherwise("current").alias("status"),
        F.when(F.col("n") > 1, F.col("any")).otherwise(F.col("last.retracted")).alias("retracted"),
    )
