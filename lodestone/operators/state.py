"""Histories of opportunities, signals, leads, experiments and sources."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranks import numbered_within


def latest(rows: DataFrame, key: str, order: list[str], cutoff: Column | None = None, clock: str = "as_of") -> DataFrame:
    """The last row of each key by ``order`` as of a cutoff; later rows win ties by the last order column."""
    if cutoff is not None:
        rows = rows.where(F.col(clock) <= cutoff)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def conflicts(rows: DataFrame, key: str, clock: str, content: str) -> DataFrame:
    """Keys that say different things at one instant; a valid history has none."""
    return rows.groupBy(key, clock).agg(F.count_distinct(content).alias("contents")).where("contents > 1").select(key, clock)


def occurrences(history: DataFrame, key: str, day: str) -> DataFrame:
    """By record: the days on which it was seen, first and last."""
    return history.groupBy(key).agg(F.count_distinct(day).alias("occurrences"), F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))


def window_view(history: DataFrame, records: DataFrame, key: str, as_of: date, days: int, seq: str) -> DataFrame:
    """The last snapshot of each record within ``days`` to ``as_of``, and records without any history."""
    inside = history.where(F.col("day").between(F.lit(as_of - timedelta(days=days - 1)), F.lit(as_of)))
    seen = latest(inside, key, ["day", seq])
    rest = records.join(history.select(key).distinct(), key, "left_anti").where(F.col("day") <= F.lit(as_of))
    return seen.unionByName(rest.select(*seen.columns), allowMissingColumns=True)


def revision_chain(rows: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Revisions of evidence in a record: version, and what each supersedes.

    Rows that repeat the content before them are no revision. A record may hold most of the
    rows: they are numbered by ranges, and each meets the one before it by a join on the record
    and the number, so no task takes a whole record. Rows of a null key are one record; ``order``
    should leave no ties.
    """
    at = numbered_within(rows, [key], order, "_n")
    changed = _with_before(at, key, "_n", content, "_before").where(F.col("_before").isNull() | (F.col("_before") != F.col(content)))
    versions = numbered_within(changed.drop("_before"), [key], ["_n"], "version").drop("_n")
    return _with_before(versions, key, "version", "revision_id", "supersedes")


def _with_before(numbered: DataFrame, key: str, n: str, value: str, out: str) -> DataFrame:
    """``numbered`` with a column's value in the row of the number before; null for the first."""
    before = numbered.select(F.col(key).alias("_k"), (F.col(n) + 1).alias("_m"), F.col(value).alias(out))
    return numbered.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col(n) == F.col("_m")), "left").drop("_k", "_m")


def health(events: DataFrame) -> DataFrame:
    """The current state of each source, once per distinct event, and for how many events it has held."""
    distinct = events.dropDuplicates(["event_id"])
    return distinct.groupBy("source").agg(
        F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max("at").alias("since_check"),
        F.count("*").alias("events"), F.count_if(F.col("status") != "ok").alias("failures"),
    )


def lease_view(leases: DataFrame, now: Column) -> DataFrame:
    """Batches with who holds them: an expired lease holds nothing; committed ones are done."""
    last = latest(leases, "batch_id", ["claimed_at", "seq"])
    status = F.when(F.col("committed"), "committed").when(F.col("expires_at") <= now, "available").otherwise("leased")
    return last.withColumn("status", status)


def promotions(signals: DataFrame, opportunity_prefix: str = "OPP") -> DataFrame:
    """The two events of each signal that became an opportunity: one closes it, one opens the other."""
    new = F.concat(F.lit(f"{opportunity_prefix}-"), F.substring("signal_id", 5, 64))
    pair = F.array(
        F.struct(F.col("signal_id").alias("record_id"), F.lit("promoted").alias("kind"), new.alias("other_id")),
        F.struct(new.alias("record_id"), F.lit("opened").alias("kind"), F.col("signal_id").alias("other_id")),
    )
    return signals.where("promoted").select(F.explode(pair).alias("e"), "day").select("e.*", "day")


def experiments(rows: DataFrame, cutoff: Column) -> DataFrame:
    """The latest snapshot of each experiment as of a cutoff, and whether it can set a priority.

    Only one that ended with an outcome and traceable evidence can; it never changes a tier.
    """
    seen = latest(rows, "experiment_id", ["as_of", "observed_at"], cutoff)
    ended = F.col("status").isin("completed", "stopped") & (F.trim(F.coalesce("outcome", F.lit(""))) != "")
    return seen.withColumn("usable_for_priority", ended & (F.coalesce("traceable_evidence", F.lit(0)) > 0))


def supported_signals(signals: DataFrame, revisions: DataFrame) -> DataFrame:
    """``signals`` that still stand on current evidence.

    ``signals``: record_id, signal_no, evidence_id, evidence_revision_id, facts (array);
    ``revisions``: the current revision of each record's evidence with version, retracted and
    facts. What was revised must be cited by its revision, and with facts that it still states;
    what was retracted supports nothing.
    """
    now = revisions.where((F.col("version") > 1) | F.col("retracted")).select(
        F.col("record_id").alias("_r"), F.col("evidence_id").alias("_e"), F.col("revision_id").alias("_v"), F.col("retracted").alias("_gone"), F.col("facts").alias("_facts")
    )
    joined = signals.join(now, (signals.record_id == now._r) & (signals.evidence_id == now._e), "left")
    bound = F.col("_v").eqNullSafe(F.col("evidence_revision_id")) & (F.size("facts") > 0) & (F.size(F.array_except("facts", "_facts")) == 0)
    return joined.where(F.col("_v").isNull() | (~F.col("_gone") & bound)).select(*signals.columns)
