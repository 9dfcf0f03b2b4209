"""The observation log as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestone.functions.shared import materialise


def observations(spark: SparkSession, path: str, schema: StructType | str, files: int | None = None) -> DataFrame:
    """New files of a folder as a stream of events."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def once(events: DataFrame, key: str = "event_id", clock: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each event once. With a clock, ids are forgotten ``delay`` after it, so state stays bounded."""
    if clock is None:
        return events.dropDuplicates([key])
    return events.withWatermark(clock, delay).dropDuplicatesWithinWatermark([key])


def daily(events: DataFrame, clock: str, by: str, delay: str = "1 day") -> DataFrame:
    """Events and distinct-free totals by day; a day closes once the watermark passes it."""
    return (
        events.withWatermark(clock, delay)
        .groupBy(F.window(clock, "1 day").alias("day"), by)
        .agg(F.count("*").alias("events"), F.min(clock).alias("first"), F.max(clock).alias("last"))
        .select(F.to_date("day.start").alias("day"), by, "events", "first", "last")
    )


def ingest(events: DataFrame, log: str, quarantine: str, checkpoint: str, late: Callable[[DataFrame], DataFrame], key: str = "event_id") -> StreamingQuery:
    """Appends a stream to the log, and rows from the future to the quarantine.

    A batch that is replayed after a failure overwrites its own folder, so that each is there
    once; the log is the union of the folders. A batch is written once with numbered rows and
    split by those, so a row is in one of the two whatever its key, null included. For a stream
    without end see ``exact``: the state here holds every key.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = materialise(batch.withColumn("_row", F.monotonically_increasing_id()), "batch")
        bad = late(rows)
        good = rows.join(bad.select("_row"), "_row", "left_anti").select(*batch.columns)
        good.write.mode("overwrite").parquet(f"{log}/batch={number}")
        bad.select(*batch.columns).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    return once(events, key).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucketed_log(spark: SparkSession, path: str, schema: StructType, key: str = "event_id", buckets: int = 64) -> str:
    """The name of the table over the log at ``path``, bucketed by a hash of ``key``; made where there is none.

    The files say which bucket they are of, so another session, or one started anew, that names
    the same path, key and number finds the log as it was left.
    """
    name = "lodestone_log_" + hashlib.sha256(f"{path} {key} {buckets}".encode()).hexdigest()[:16]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return name


def unseen(batch: DataFrame, log: str, key: str = "event_id", buckets: int = 64) -> DataFrame:
    """Rows of ``batch`` whose key the bucketed table ``log`` has not, one of each key.

    The batch is dealt as the log is, so the log itself is never shuffled, and only its keys are read.
    """
    dealt = batch.dropDuplicates([key]).repartition(buckets, key)
    held = batch.sparkSession.table(log).select(key).hint("merge")
    return dealt.join(held, key, "left_anti")


def exact(
    events: DataFrame, log: str, quarantine: str, checkpoint: str, late: Column, key: str = "event_id", buckets: int = 64, every: str | None = None
) -> StreamingQuery:
    """Appends a stream to a log of which every event is there once, whatever is sent again and whenever.

    No state is kept: each batch leaves out what the log has, by key. So a batch that runs again
    after a failure, in whole or after it was written, adds nothing, and neither does an event that
    comes back after years. Rows for which ``late`` holds, and rows without a key, which can't be
    told from another, go to the quarantine, a folder for each batch. The log is a table bucketed
    by key (``bucketed_log``): a batch costs a scan of the log's keys, without a shuffle.

    ``every``: the time between batches of a query that runs on; else what is there is taken and
    the query ends. Events of one key are one event; which of several in a batch stays is open.
    """
    name = bucketed_log(events.sparkSession, log, events.schema, key, buckets)
    held = F.coalesce(late, F.lit(False)) | F.col(key).isNull()

    def write(batch: DataFrame, number: int) -> None:
        rows = materialise(batch.withColumn("_held", held), "batch")
        rows.where("_held").drop("_held").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        new = unseen(rows.where("not _held").drop("_held"), name, key, buckets)
        new.select(*batch.columns).write.insertInto(name)

    out = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
