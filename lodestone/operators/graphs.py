"""Groups of records that have keys in common, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shared import materialise
from lodestone.functions.text import identity_text
from lodestone.functions.urls import evidence_url, source_key
from lodestone.operators.funnel import active
from lodestone.operators.ranks import numbered


def groups(memberships: DataFrame, record: str = "record", key: str = "key") -> DataFrame:
    """(record, group) of every record of ``memberships``, rows of a record and one of its keys.

    Records with a key in common are of one group, directly or by way of others; ``group`` is the
    least record of it. A key that a third of the records has is no more work than others: each
    key links its records to the least of them, so there are as many links as rows, and the least
    is found by an aggregate. Links are then contracted: each record is renamed to its least
    neighbour until none is left. Records are numbered in the order of a hash for that, in which
    rounds grow with the logarithm of a group's size. Null records are left out; null keys link
    nothing, so a record that has no other key is a group of its own.
    """
    rows = memberships.select(F.col(record).alias("record"), F.col(key).alias("key")).where("record is not null")
    nodes = materialise(numbered(rows.select("record").distinct(), [F.xxhash64("record"), "record"], "node"), "nodes")
    keyed = materialise(rows.where("key is not null").distinct().join(nodes, "record").select("node", "key"), "keyed")
    least = materialise(keyed.groupBy(F.col("key").alias("of")).agg(F.min("node").alias("to")), "least")
    edges = _links(keyed.join(least, keyed.key == least.of).select(F.col("node").alias("a"), F.col("to").alias("b")))
    names = nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "hook")
        names = materialise(names.join(hook, names.root == hook.a, "left").select("node", F.coalesce("m", "root").alias("root")), "names")
        here, there = hook.select("a", F.col("m").alias("x")), hook.select(F.col("a").alias("b"), F.col("m").alias("y"))
        edges = _links(edges.join(here, "a").join(there, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    found = materialise(names.join(nodes, "node").select("record", "root"), "named")
    first = materialise(found.groupBy(F.col("root").alias("of")).agg(F.min("record").alias("group")), "first")
    return found.join(first, found.root == first.of).select(F.col("record").alias(record), "group")


def _links(edges: DataFrame) -> DataFrame:
    return materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def independent_sources(
    records: DataFrame, key: str = "evidence_id", url: str = "url", original_url: str = "original_url", publisher: str = "original_publisher", stands: Column | None = None
) -> DataFrame:
    """(key, source_group): records that share an address, an original address, or who published them, over all records.

    The publisher is a name, else the host of the original address. Records without a web
    address, and those that ``stands`` (by default: not retracted) leaves out, back nothing and
    have no row. The number of distinct groups is that of independent sources. Unlike
    ``funnel.independent_sources``, which folds the few records of one candidate, this is for
    records of any number, and keys of any number of records.
    """
    if stands is None:
        stands = active(F.col("retracted"), F.when(F.col("status") == "retracted", F.col("status")))
    used = records.where(stands).select(F.col(key).alias("record"), evidence_url(F.col(url)).alias("url"), evidence_url(F.col(original_url)).alias("original"), identity_text(F.col(publisher)).alias("publisher"))
    used = used.where("url <> ''").withColumn("original", F.coalesce(F.nullif(F.col("original"), F.lit("")), "url"))
    keys = F.array(F.concat(F.lit("url:"), "url"), F.concat(F.lit("url:"), "original"), source_key(F.col("original"), F.col("publisher")))
    found = groups(used.select("record", F.explode(F.array_distinct(keys)).alias("key")))
    return found.select(F.col("record").alias(key), F.col("group").alias("source_group"))
