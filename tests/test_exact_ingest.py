from __future__ import annotations

import json
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import library
from lodestone.streaming import ingest

SCHEMA = "event_id string, year long, v long"
LATE = "year > 2026"


def added(spark, path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{name}")


def run(spark, path, checkpoint="c"):
    source = ingest.observations(spark, f"{path}/in/*", StructType.fromDDL(SCHEMA), 1)
    query = ingest.exact(source, f"{path}/log", f"{path}/q", f"{path}/{checkpoint}", F.expr(LATE), buckets=4)
    query.awaitTermination()
    return query, ingest.bucketed_log(spark, f"{path}/log", StructType.fromDDL(SCHEMA), buckets=4)


def test_replays_restarts_and_null_keys(spark, tmp_path):
    added(spark, tmp_path, "a", [("e1", 2024, 1), ("e2", 2024, 2), ("e1", 2024, 1), (None, 2024, 3), ("f", 2030, 4), (None, 2030, 5)])
    query, log = run(spark, tmp_path)
    assert all(not p["stateOperators"] for p in query.recentProgress)
    added(spark, tmp_path, "b", [("e2", 2024, 2), ("e3", 2025, 6), ("f", 2024, 7)])
    run(spark, tmp_path)
    # The same files from the beginning, with another checkpoint: nothing is new.
    run(spark, tmp_path, "other")
    ids = Counter(r.event_id for r in spark.table(log).collect())
    assert ids == {"e1": 1, "e2": 1, "e3": 1, "f": 1}
    held = [tuple(r[:3]) for r in spark.read.parquet(f"{tmp_path}/q/batch=0").collect()]
    assert sorted(held, key=str) == sorted([(None, 2024, 3), ("f", 2030, 4), (None, 2030, 5)], key=str)


def test_a_batch_that_was_written_but_not_noted_adds_nothing(spark, tmp_path):
    added(spark, tmp_path, "a", [("e1", 2024, 1), ("e2", 2024, 2)])
    _, log = run(spark, tmp_path)
    for note in Path(f"{tmp_path}/c/commits").iterdir():
        note.unlink()  # as if the query had died before it could note the batch
    run(spark, tmp_path)
    assert Counter(r.event_id for r in spark.table(log).collect()) == {"e1": 1, "e2": 1}


def test_another_session_finds_the_log(spark, tmp_path):
    added(spark, tmp_path, "a", [("e1", 2024, 1)])
    _, log = run(spark, tmp_path)
    spark.sql(f"DROP TABLE {log}")  # the table's entry only, as in a session started anew
    added(spark, tmp_path, "b", [("e1", 2024, 1), ("e2", 2024, 1)])
    _, log = run(spark, tmp_path)
    assert sorted(r.event_id for r in spark.table(log).collect()) == ["e1", "e2"]


def test_the_log_is_not_shuffled_and_only_its_keys_are_read(spark, tmp_path):
    log = ingest.bucketed_log(spark, f"{tmp_path}/log", StructType.fromDDL(SCHEMA), buckets=4)
    spark.range(1000).select(F.col("id").cast("string").alias("event_id"), F.lit(1).cast("long"), F.lit(2).cast("long")).repartition(3).write.insertInto(log)
    batch = spark.createDataFrame([("5", 1, 1), ("x", 1, 1)], SCHEMA)
    found = ingest.unseen(batch, log, buckets=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("FileScan") - 400 :]
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 2 and "Bucketed: true" in plan
    assert "ReadSchema: struct<event_id:string>" in side and [r.event_id for r in found.collect()] == ["x"]
    after = plan[plan.index("SortMergeJoin") :].split("\n")
    scan = next(k for k, line in enumerate(after) if "FileScan" in line)
    between = [line for line in after[:scan][::-1]]
    assert not any("Exchange" in line for line in between[: next(k for k, line in enumerate(between) if "Sort " in line) + 1])


def test_append_without_keys_is_idempotent(spark):
    log = spark.createDataFrame([(None, 2024, 1), ("a", 2024, 2)], SCHEMA)
    assert library.appended(log, log).count() == 2
    batch = spark.createDataFrame([(None, 2024, 1), (None, 2024, 1), ("b", 2024, 2)], SCHEMA)
    once = library.appended(log.limit(0), batch)
    assert once.count() == 2 and library.appended(once, batch).count() == 2


def test_the_older_ingest_splits_rows_without_keys(spark, tmp_path):
    added(spark, tmp_path, "a", [(None, 2030, 1), ("x", 2024, 2), ("y", 2031, 3)])
    source = ingest.observations(spark, f"{tmp_path}/in/*", StructType.fromDDL(SCHEMA))
    ingest.ingest(source, f"{tmp_path}/log", f"{tmp_path}/q", f"{tmp_path}/c", lambda b: b.where(LATE)).awaitTermination()
    read = lambda name: sorted(json.dumps(r.event_id) for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert read("log") == ['"x"'] and read("q") == ['"y"', "null"]
