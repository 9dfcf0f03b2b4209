"""Claims, their quotes, and bounded packets of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import quote_span
from lodestone.operators.budgets import greedy
from lodestone.operators.ranks import numbered, numbered_within


def visibility(clocks: list[Column], observed: Column, cutoff: Column) -> Column:
    """future if any clock is after the cutoff, missing_observation without an observation, else visible."""
    late = F.lit(False)
    for c in clocks:
        late = late | F.coalesce(c > cutoff, F.lit(False))
    return F.when(late, "future").when(observed.isNull(), "missing_observation").otherwise("visible")


def located(claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every reference of every claim with where its quote stands, and what is wrong with it.

    ``claims``: claim_id, refs array<struct<evidence_id,revision_id,quote>>; ``catalog``:
    evidence_id, revision_id, original_text. problem: no_evidence, other_revision, no_quote or null.
    """
    refs = claims.select("claim_id", F.posexplode_outer("refs").alias("ref_no", "r")).select("claim_id", "ref_no", "r.*")
    known = catalog.select(F.col("evidence_id").alias("_id"), F.col("revision_id").alias("_rev"), F.col("original_text").alias("_text"))
    joined = refs.join(known, refs.evidence_id == known._id, "left").withColumn("span", F.when(F.col("revision_id") == F.col("_rev"), quote_span(F.col("_text"), F.col("quote"))))
    best = joined.groupBy("claim_id", "ref_no", "evidence_id", "revision_id", "quote").agg(
        F.max(F.col("_id").isNotNull()).alias("_any"), F.max(F.coalesce(F.col("_rev") == F.col("revision_id"), F.lit(False))).alias("_same"), F.min("span").alias("span")
    )
    problem = F.when(~F.col("_any"), "no_evidence").when(~F.col("_same"), "other_revision").when(F.col("span").isNull(), "no_quote")
    return best.withColumns({"problem": problem, "start": F.col("span.start"), "end": F.col("span.end")}).drop("_any", "_same", "span")


def claim_status(references: DataFrame) -> DataFrame:
    """By claim: references, those located, and validation: verified, incomplete or unsupported."""
    found = references.groupBy("claim_id").agg(F.count("evidence_id").alias("refs"), F.count_if(F.col("problem").isNull() & F.col("evidence_id").isNotNull()).alias("located"))
    rule = F.when((F.col("refs") > 0) & (F.col("located") == F.col("refs")), "verified").when(F.col("located") > 0, "incomplete").otherwise("unsupported")
    return found.withColumn("validation", rule)


def budget_packets(items: DataFrame, group: list[str], order: list[str], size: str, max_items: int, max_chars: int) -> DataFrame:
    """``items`` with ``packed``: whether each found room in its group's packet.

    In order, an item is taken if the packet has room for it, and passed over otherwise, so later
    and smaller ones may still fit; see ``budgets.greedy``. No group columns: one packet.
    """
    return greedy(items, group, order, F.col(size).cast("decimal(25,12)"), max_chars, max_items, "packed")


def diversified(items: DataFrame, fields: list[str], order: str) -> DataFrame:
    """``items`` with ``turn`` and ``position``: each turn shows what has been shown least.

    An item's turn is the most often that any of its field values has come before; so the first
    items of every industry, role, task and source go before second ones.
    """
    rows = items
    for k, f in enumerate(fields):
        rows = numbered_within(rows, [f], [order], f"_turn{k}")
    turns = [F.col(f"_turn{k}") for k in range(len(fields))]
    rows = rows.withColumn("turn", F.greatest(*turns) if len(turns) > 1 else turns[0])
    return numbered(rows.drop(*[f"_turn{k}" for k in range(len(fields))]), ["turn", order], "position")


def trimmed(items: DataFrame, packet: list[str], text: str, order: str, size: str, max_chars: int, least: int = 100) -> DataFrame:
    """``items`` with texts cut so that their packet has at most ``max_chars``, and ``text_truncated``.

    The longest text is cut first, by what the packet is over but by ``least`` characters at the
    least; if all of it isn't enough, the next longest, and so on. ``size`` is an item's length as
    written, its text included. A packet that stays over without any text keeps empty texts.
    """
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    longest = Window.partitionBy(*packet).orderBy(F.desc("_length"), order)
    rows = items.withColumn("_length", length).withColumn("_over", F.sum(size).over(Window.partitionBy(*packet)) - max_chars)
    gone = F.coalesce(F.sum("_length").over(longest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_over", F.col("_over") - gone)
    cut = F.when(F.col("_over") > 0, F.least(F.col("_length"), F.greatest(F.col("_over"), F.lit(least)))).otherwise(0)
    rows = rows.withColumn("_cut", cut)
    kept = F.when(F.col("_cut") > 0, F.substr(F.col(text), F.lit(1), (F.col("_length") - F.col("_cut")).cast("int"))).otherwise(F.col(text))
    return rows.withColumn(text, kept).withColumn("text_truncated", F.col("_cut") > 0).drop("_length", "_over", "_cut")


def reading_batches(items: DataFrame, position: str, max_items: int = 15) -> DataFrame:
    """``items`` with the batch READ-nnnn in which they are read; from the 10,000th on, with as many digits as it takes."""
    n = (F.floor((F.col(position) - 1) / max_items) + 1).cast("string")
    return items.withColumn("batch_id", F.concat(F.lit("READ-"), F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0"))))


def without(items: DataFrame, packet: DataFrame) -> DataFrame:
    """Items that a packet doesn't hold, by evidence and revision."""
    return items.join(packet.select("evidence_id", "revision_id"), ["evidence_id", "revision_id"], "left_anti")


def context_union(hits: DataFrame, snapshot: DataFrame, keys: dict[str, DataFrame]) -> DataFrame:
    """Search hits, and snapshot rows that are referenced by any of the key tables, once each."""
    parts = [hits.select(*snapshot.columns)] + [snapshot.join(k.select(c).distinct(), c, "left_semi") for c, k in keys.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.dropDuplicates(["evidence_id", "revision_id"])


def compact(items: DataFrame, provenance: tuple[str, ...] = ("raw_file", "raw_ref", "raw_refs", "derivation_refs", "engagement", "query_metadata")) -> DataFrame:
    """Items for a packet: no provenance, titles of at most 200 characters, and no field that repeats the text."""
    kept = items.drop(*provenance)
    changes = {"title": F.substring("title", 1, 200)} if "title" in kept.columns else {}
    for c in ("text", "fact", "quote"):
        if c in kept.columns and "original_text" in kept.columns:
            changes[c] = F.when(~F.col(c).eqNullSafe(F.col("original_text")), F.col(c))
    return kept.withColumns(changes)


def basis(rationale: Column, refs: Column, located: Column) -> Column:
    """struct(reference_validation, missing) of what backs a score or choice; it changes neither."""
    lacking = F.array_compact(F.array(F.when(F.trim(F.coalesce(rationale, F.lit(""))) == "", "rationale"), F.when(F.coalesce(refs, F.lit(0)) == 0, "evidence_refs")))
    state = F.when(F.coalesce(refs, F.lit(0)) == 0, "missing").when(located == refs, "located").otherwise("invalid")
    return F.struct(state.alias("reference_validation"), lacking.alias("missing"))


def evidence_index(evidence: DataFrame, packet: DataFrame) -> DataFrame:
    """All evidence with whether the packet holds it and what it waits for."""
    held = packet.select("evidence_id", "revision_id", F.lit(True).alias("in_packet"))
    rows = evidence.join(held, ["evidence_id", "revision_id"], "left").withColumn("in_packet", F.coalesce("in_packet", F.lit(False)))
    reason = F.when(F.col("derivation_status") == "needs_review", "derivation_review").when(F.col("semantic_status") == "not_reviewed", "semantic_review").when(~F.col("in_packet"), "not_in_packet")
    return rows.withColumn("review_reason", reason)
