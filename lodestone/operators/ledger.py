"""Requests, attempts, budgets and costs, in exact decimals."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.budgets import greedy

MONEY = "decimal(38,12)"
STATES = ("succeeded", "failed", "outcome_unknown", "started")


def money(text: Column) -> Column:
    """Text as an exact amount; null for what is no amount or negative."""
    amount = text.try_cast(MONEY)
    return F.when(amount >= 0, amount)


def plain(amount: Column) -> Column:
    """An amount as text without idle zeros."""
    return F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def recovered(attempts: DataFrame) -> DataFrame:
    """Attempts that a crash left open, as outcome_unknown."""
    return attempts.withColumn("state", F.when(F.col("state") == "started", "outcome_unknown").otherwise(F.col("state")))


def attempts_with_source(attempts: DataFrame, batch_requests: DataFrame) -> DataFrame:
    """Attempts with the source of their batch's request; 'unknown' without one.

    Joined by batch and fingerprint, so reuse of a request in another batch counts nothing twice.
    """
    meta = batch_requests.select("batch_id", "fingerprint", "source")
    return attempts.join(meta, ["batch_id", "fingerprint"], "left").withColumn("source", F.coalesce("source", F.lit("unknown")))


def ledger(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Attempts, states and exact costs by group, whatever their outcome."""
    return attempts.groupBy(*by).agg(
        F.count("*").alias("attempts"),
        *[F.count_if(F.col("state") == s).alias(s) for s in STATES],
        F.sum(F.col("list_cost_usd").cast(MONEY)).alias("list_cost"),
        F.sum(F.col("estimated_cost_usd").cast(MONEY)).alias("estimated_cost"),
    )


def attempt_ordinals(attempts: DataFrame, request: list[str], order: str) -> DataFrame:
    """``attempts`` with their number among those of the same request."""
    return attempts.withColumn("ordinal", F.row_number().over(Window.partitionBy(*request).orderBy(order)))


def budget(entries: DataFrame, day: date, limits: dict[str, Decimal | None]) -> DataFrame:
    """One row: occupied and remaining amounts of the day, its month and in total.

    No limit leaves remaining null; what is overdrawn leaves 0.
    """
    amount = F.col("list_cost_usd").cast(MONEY)
    zero = F.lit(Decimal(0)).cast(MONEY)
    periods = {"daily": F.col("day") == F.lit(day), "monthly": F.date_format("day", "yyyy-MM") == f"{day:%Y-%m}", "total": F.lit(True)}
    sums = entries.agg(*[F.coalesce(F.sum(F.when(w, amount)), zero).cast(MONEY).alias(f"{p}_occupied") for p, w in periods.items()], F.count("*").alias("entries"))
    left = {f"{p}_remaining": F.greatest(zero, F.lit(limits[p]).cast(MONEY) - F.col(f"{p}_occupied")).cast(MONEY) if limits.get(p) is not None else F.lit(None).cast(MONEY) for p in periods}
    return sums.withColumns(left)


def reservations(entries: DataFrame, home: str, order: list[str], limit: Decimal) -> DataFrame:
    """``entries`` with ``accepted``: whether each fitted the home's limit when its turn came.

    What is turned down takes no room, so this is no running sum; see ``budgets.greedy``. Limits
    are below 10**13, so that sums of what fits are exact.
    """
    if limit >= 10**13:
        raise ValueError("limits are below 10**13")
    return greedy(entries, [home], order, F.col("list_cost_usd").try_cast("decimal(25,12)"), limit, out="accepted")


def pricing(rows: DataFrame) -> DataFrame:
    """One price per endpoint: the highest, with a discount or credit only if every row allows it."""
    return rows.groupBy("endpoint").agg(
        F.max(F.col("cost").cast(MONEY)).alias("cost"),
        F.bool_and("allow_discount").alias("allow_discount"),
        F.bool_and("allow_free_credit").alias("allow_free_credit"),
    )


def cost_estimate(requests: DataFrame, prices: DataFrame, discount: Decimal, by: str = "source") -> DataFrame:
    """List and discounted cost by source; requests without a price count as unpriced."""
    rows = requests.join(prices, "endpoint", "left")
    listed = F.col("cost")
    cut = F.when(F.col("allow_discount"), listed * F.lit(discount)).otherwise(listed)
    return rows.groupBy(by).agg(
        F.count("*").alias("requests"),
        F.sum(listed).cast(MONEY).alias("list_cost"),
        F.sum(cut).cast(MONEY).alias("discounted_cost"),
        F.sum(F.when(F.col("allow_free_credit"), listed)).cast(MONEY).alias("credit_eligible"),
        F.count_if(listed.isNull()).alias("unpriced"),
    )


def rounded(amount: Column) -> Column:
    """Six places, halves to even."""
    return F.bround(amount, 6)


def request_state(attempts: DataFrame, order: str) -> DataFrame:
    """The state of each request: succeeded once any attempt was, else that of the latest."""
    latest = F.max_by("state", order)
    done = F.bool_or(F.col("state") == "succeeded")
    return attempts.groupBy("fingerprint").agg(F.when(done, "succeeded").otherwise(latest).alias("state"), F.count("*").alias("attempts"))


def cost_yield(executions: DataFrame, evidence: DataFrame, by: str = "source") -> DataFrame:
    """By source: requests, successes, cost, evidence, and cost per piece of evidence (null for none)."""
    runs = executions.dropDuplicates(["content_hash"]).groupBy(by).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") == "ok").alias("ok"), F.sum(F.col("cost_usd").cast(MONEY)).alias("cost")
    )
    found = evidence.groupBy(by).agg(F.count_distinct("evidence_id").alias("evidence"), F.count_if("linked").alias("linked"))
    rows = runs.join(found, by, "full").fillna(0, ["requests", "ok", "evidence", "linked"])
    return rows.withColumn("cost_per_evidence", F.when(F.col("evidence") > 0, F.col("cost") / F.col("evidence")).cast(MONEY))


def digest(qualified: DataFrame, evidence: DataFrame, used: DataFrame, executions: DataFrame) -> DataFrame:
    """One row on a run: conclusions and families, how much evidence they use, and what each cost.

    ``qualified``: family, tier (A and B are validated, R is regional); ``evidence`` and
    ``used``: marker; ``executions`` as of ``cost_yield``. What would be divided by 0 is null.
    """
    families = qualified.agg(
        F.count("*").alias("qualified_conclusion_count"), F.count_distinct("family").alias("qualified_family_count"),
        F.count_distinct(F.when(F.col("tier").isin("A", "B"), F.col("family"))).alias("validated_opportunity_family_count"),
        F.count_distinct(F.when(F.col("tier") == "R", F.col("family"))).alias("regional_hypothesis_family_count"),
        (F.least(F.count_if(F.col("tier") == "A"), F.lit(5)) + F.least(F.count_if(F.col("tier") == "B"), F.lit(40)) + F.least(F.count_if(F.col("tier") == "R"), F.lit(80))).alias("suggested_report_display_count"),
    )
    known = evidence.select("marker").distinct()
    markers = known.join(used.select("marker", F.lit(True).alias("_used")).distinct(), "marker", "left").agg(
        F.count("*").alias("normalized_evidence_count"), F.count_if(F.coalesce("_used", F.lit(False))).alias("used_normalized_evidence_count")
    )
    costs = executions.dropDuplicates(["content_hash"]).agg(
        F.count("*").alias("paid_request_count"), F.count_if(F.col("status") == "ok").alias("paid_request_ok"), F.coalesce(F.sum(F.col("cost_usd").cast(MONEY)), F.lit(0)).cast(MONEY).alias("estimated_cost_usd")
    )
    rows = [x.withColumn("_one", F.lit(1)) for x in (families, markers, costs)]  # a row each
    whole = rows[0].join(rows[1], "_one").join(rows[2], "_one").drop("_one")

    def share(top: Column, bottom: str, places: int) -> Column:
        return F.when(F.col(bottom) > 0, F.bround(top / F.col(bottom), places).cast("double"))

    return whole.withColumns({
        "additional_conclusion_count": F.col("qualified_conclusion_count") - F.col("suggested_report_display_count"),
        "evidence_utilization_percent": share(100 * F.col("used_normalized_evidence_count").cast("decimal(20,0)"), "normalized_evidence_count", 2),
        "cost_per_qualified_conclusion_usd": share(F.col("estimated_cost_usd"), "qualified_conclusion_count", 6),
        "cost_per_validated_family_usd": share(F.col("estimated_cost_usd"), "validated_opportunity_family_count", 6),
    })


def usage(records: DataFrame, evidence: DataFrame, out: str) -> DataFrame:
    """By source: how many records cite any of its evidence, as ``out``, and how much of it they use.

    ``records``: record_id and marker of each citation; ``evidence``: source, marker, which stands
    (what was withdrawn isn't in it). A citation that evidence doesn't have counts for nothing, and
    a record once for a source, however often it cites it.
    """
    pairs = records.select("record_id", "marker").distinct().join(evidence.select("source", "marker").distinct(), "marker")
    # two rounds of plain counts, so that a source with most of the records is no single task
    by_record = pairs.groupBy("source", "record_id").agg(F.lit(1).alias("_")).groupBy("source").agg(F.count("*").alias(out))
    by_marker = pairs.groupBy("source", "marker").agg(F.lit(1).alias("_")).groupBy("source").agg(F.count("*").alias(f"{out}_evidence"))
    return by_record.join(by_marker, "source")


def digest_by_source(executions: DataFrame, evidence: DataFrame, conclusions: DataFrame, leads: DataFrame) -> DataFrame:
    """A row for each source that was asked, gave evidence or is cited.

    ``executions`` as of ``cost_yield``; ``evidence``: source, marker; ``conclusions`` and
    ``leads`` as of ``usage``. Requests, ok, error, estimated_cost_usd, normalized_evidence,
    linked_conclusions and linked_research_leads, 0 where there is none. Null sources are 'unknown'.
    """
    named = lambda rows: rows.withColumn("source", F.coalesce("source", F.lit("unknown")))
    known = named(evidence).select("source", "marker").distinct()
    runs = named(executions).dropDuplicates(["content_hash"]).groupBy("source").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(~F.col("status").eqNullSafe("ok")).alias("error"), F.sum(F.col("cost_usd").cast(MONEY)).alias("estimated_cost_usd")
    )
    held = known.groupBy("source").agg(F.count("*").alias("normalized_evidence"))
    rows = runs.join(held, "source", "full")
    for records, out in ((conclusions, "linked_conclusions"), (leads, "linked_research_leads")):
        rows = rows.join(usage(records, known, out).drop(f"{out}_evidence"), "source", "full")
    counts = ("requests", "ok", "error", "normalized_evidence", "linked_conclusions", "linked_research_leads")
    return rows.fillna(0, list(counts)).withColumn("estimated_cost_usd", F.coalesce("estimated_cost_usd", F.lit(0)).cast(MONEY))
