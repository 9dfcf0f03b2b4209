"""What to search next: follow-ups of observed tasks, request batches, and search candidates."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shared import materialise
from lodestone.functions.text import collapse, fold
from lodestone.functions.urls import evidence_url, public_url, x_post_id
from lodestone.operators.budgets import greedy
from lodestone.operators.ranks import numbered, numbered_within

#: Ends of follow-up queries by purpose and language (fixed values).
SUFFIXES = {("alternative", "zh"): "现成方法 替代 服务", ("non_adoption", "zh"): "试过 放弃 没有购买 原因", ("alternative", "en"): "alternatives services", ("non_adoption", "en"): "tried stopped using why"}


def balanced_query(parts: list[Column], suffix: Column, most: int = 100) -> Column:
    """A query of up to three distinct texts with equal room for each, cut at words, and a suffix."""
    texts = F.slice(F.array_distinct(F.filter(F.array(*[F.substring(collapse(F.coalesce(p, F.lit(""))), 1, 500) for p in parts]), lambda t: t != "")), 1, 3)
    n = F.size(texts)
    room = F.lit(most) - F.length(suffix) - F.when(suffix != "", 1).otherwise(0) - n + 1
    width = F.greatest(F.lit(1), F.floor(room / F.greatest(n, F.lit(1)))).cast("int")

    def cut(t: Column) -> Column:
        head = F.substr(t, F.lit(1), width)
        return F.when((F.length(t) > width) & head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)

    return F.when(n == 0, "").otherwise(F.trim(F.concat_ws(" ", F.array_join(F.transform(texts, cut), " "), suffix)))


def followups(observations: DataFrame) -> DataFrame:
    """Three searches per task family: its artefact, alternatives, and why people stopped.

    The best described observation of a family speaks for it. A query is asked once, whatever the
    family. ``observations`` as of ``needs``, with artifact, trigger, current_workaround,
    desired_outcome, query_terms and language.
    """
    told = sum((F.col(c).isNotNull().cast("int") for c in ("trigger", "current_workaround", "desired_outcome", "artifact")), F.when(F.size("query_terms") > 0, 1).otherwise(0))
    rest = ["task", "need", "artifact", "trigger", "current_workaround", "desired_outcome", "query_terms", "language"]
    best = observations.groupBy("task_family_id").agg(
        F.min_by(F.struct(*rest), F.struct((-told).alias("t"), "observation_id")).alias("o"), F.array_sort(F.collect_set("observation_id")).alias("source_observation_ids")
    ).select("task_family_id", "source_observation_ids", "o.*")
    anchor = F.coalesce(F.nullif(F.array_join(F.slice(F.coalesce("query_terms", F.array().cast("array<string>")), 1, 3), " "), F.lit("")), F.col("task"))
    end = F.create_map(*[F.lit(x) for (purpose, lang), s in SUFFIXES.items() for x in (f"{purpose}:{lang}", s)])

    def proposal(purpose: str, *parts: Column) -> Column:
        suffix = F.coalesce(F.element_at(end, F.concat(F.lit(f"{purpose}:"), F.coalesce("language", F.lit("unknown")))), F.lit(""))
        return F.struct(F.lit(purpose).alias("purpose"), balanced_query([anchor, *parts], suffix).alias("query"))

    made = F.array(
        proposal("workflow_artifact", F.coalesce("artifact", "trigger"), F.col("current_workaround")), proposal("alternative", F.coalesce("desired_outcome", "need")),
        proposal("non_adoption", F.coalesce("current_workaround", "trigger")),
    )
    rows = best.select("task_family_id", "source_observation_ids", "language", F.explode(made).alias("p")).select("task_family_id", "source_observation_ids", "language", "p.*").where("query <> ''")
    key = F.substring(F.sha2(F.concat_ws("|", fold(F.col("query")), F.coalesce("language", F.lit("unknown"))), 256), 1, 24)
    first = F.min_by(F.struct("task_family_id", "purpose", "query", "language", "source_observation_ids"), F.struct("task_family_id", "purpose"))
    return rows.groupBy(key.alias("query_key")).agg(first.alias("t")).select("query_key", F.concat(F.lit("followup-"), "query_key").alias("id"), "t.*")


def broad_families(families: DataFrame, as_of: date, most: int = 8) -> list[str]:
    """Up to ``most`` families that together span the most industries and languages.

    ``families``: task_family_id, industry_ids, languages. Each pick adds what is new most, an
    industry counting twice; the day decides where among equals to begin. One job per pick, and
    no more than ``most`` ids come to the driver.
    """
    n = families.count()
    start = as_of.toordinal() % n if n else 0
    rows = numbered(families, ["task_family_id"], "_place").withColumn("_place", F.pmod(F.col("_place") - 1 - F.lit(start), F.lit(max(n, 1))))
    picked, industries, languages = [], set(), {"unknown"}
    while len(picked) < min(most, n):
        new = lambda c, seen: F.size(F.array_except(c, F.array(*[F.lit(s) for s in sorted(seen)]).cast("array<string>")))
        gain = 2 * new("industry_ids", industries) + new("languages", languages)
        r = rows.where(~F.col("task_family_id").isin(*picked) if picked else F.lit(True)).orderBy(gain.desc(), "_place").first()
        picked.append(r.task_family_id)
        industries |= set(r.industry_ids)
        languages |= set(r.languages)
    return picked


def in_turns(requests: DataFrame, topic: str, order: list[str]) -> DataFrame:
    """``requests`` with ``place``: topics take turns, each by its own order."""
    return numbered(numbered_within(requests, [topic], order, "turn"), ["turn", *order], "place")


def affordable(requests: DataFrame, prices: DataFrame, limit: Decimal, most: int = 12) -> DataFrame:
    """``requests`` (in ``place`` order) with ``decision``: selected, or why not.

    A request without a price isn't asked; one past the budget is passed over, and cheaper ones
    after it may still fit; at most ``most`` are selected. All are one group of ``budgets.greedy``.
    """
    priced = requests.join(prices.select("endpoint", F.col("cost").alias("list_cost_usd")), "endpoint", "left")
    size = F.col("list_cost_usd").try_cast("decimal(25,12)")
    taken = greedy(priced.where("list_cost_usd is not null").select("id", "place", "list_cost_usd"), [], ["place"], size, limit, out="accepted").select("id", "place", "accepted")
    taken = materialise(taken, "affordable")
    nth = numbered(taken.where("accepted"), ["place"], "_nth").select("id", "_nth")
    rows = priced.join(taken.drop("place"), "id", "left").join(nth, "id", "left")
    decision = F.when(F.col("list_cost_usd").isNull(), "live_price_unavailable").when(~F.col("accepted"), "budget_limit").when(F.col("_nth") > most, "batch_limit").otherwise("selected")
    return rows.withColumn("decision", decision).drop("_nth", "accepted")


#: Tasks of a group that are cut into batches at once.
STRETCH = 16_384


def _starts(sizes: np.ndarray, max_items: int, room: int) -> np.ndarray:
    """Of each place, where the batch after the one that begins there begins: a search in running sums."""
    sums = np.append(0, np.cumsum(sizes))
    here = np.arange(len(sizes))
    fits = np.searchsorted(sums, sums[:-1] + room, "right") - 1
    return np.clip(fits, here + 1, here + max_items)


def review_batches(tasks: DataFrame, group: str, order: list[str], size: str, max_items: int = 16, max_chars: int = 18000, overhead: int = 1000) -> DataFrame:
    """``tasks`` with the number of their batch within the group: a batch ends before it overflows.

    In order, a task joins the batch unless that has ``max_items``, or would have over
    ``max_chars`` with an ``overhead`` of its own; a task too large for any batch has one to
    itself. Sizes are not negative, and null ones are 0. Null groups are a group.

    Where a batch begins depends on all before it, but the batches that a stretch of tasks makes
    only on which of its first ``max_items`` begins one. So many tasks each find, for their stretch,
    where each such beginning leads in the next one and by how many batches; these few rows by
    stretch are followed in order; then each stretch is numbered by itself. No task of Spark has
    more than a stretch, however large a group.
    """
    length = max(STRETCH, max_items)
    places = materialise(numbered_within(tasks, [group], order, "_no"), "places")
    stretch = F.floor((F.col("_no") - 1) / length).cast("long")
    early = F.when((F.col("_no") - 1) % length < max_items, F.when(stretch > 0, stretch - 1))
    slim = places.select(F.col(group).alias("g"), "_no", F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"), F.explode(F.array_compact(F.array(stretch, early))).alias("s"))
    slim = materialise(slim.withColumn("own", F.floor((F.col("_no") - 1) / length) == F.col("s")), "stretches")
    room = max_chars - overhead
    kind = slim.schema["g"].dataType.simpleString()

    def leads(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_no")
        own = int(frame["own"].sum())
        to = _starts(frame["n"].to_numpy(), max_items, room)
        end, count = np.empty(own, np.int64), np.empty(own, np.int64)
        for i in range(own - 1, -1, -1):
            j = to[i]
            end[i], count[i] = (j - own, 1) if j >= own else (end[j], count[j] + 1)
        first = np.arange(min(max_items, own))
        return pd.DataFrame({"g": [frame["g"].iloc[0]] * len(first), "s": frame["s"].iloc[0], "first": first, "leads_to": end[: len(first)], "batches": count[: len(first)]})

    found = materialise(slim.groupBy("g", "s").applyInPandas(leads, f"g {kind}, s long, first long, leads_to long, batches long"), "leads")

    def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, before, following = object(), 0, 0, (0, 0)
        for frame in batches:
            out = []
            for key, none, s, f, to, n in zip(frame["g"], frame["none"], frame["s"], frame["first"], frame["leads_to"], frame["batches"], strict=True):
                own = (none, None if none else key)
                if own != now:
                    now, following = own, (0, 0)
                if f == 0:  # every stretch has that row, first
                    first, before = following
                    out.append((None if none else key, s, first, before))
                if f == first:
                    following = (to, before + n)
            yield pd.DataFrame(out, columns=["g", "s", "first", "before"])

    in_order = found.withColumn("none", F.col("g").isNull()).repartition("g").sortWithinPartitions("g", "s", "first")
    entries = materialise(in_order.mapInPandas(followed, f"g {kind}, s long, first long, before long"), "entries")

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_no")
        own = int(frame["own"].sum())
        to = _starts(frame["n"].to_numpy(), max_items, room)
        begins, i = np.zeros(own, np.int64), int(frame["first"].iloc[0])
        while i < own:
            begins[i] = 1
            i = to[i]
        frame = frame.iloc[:own]
        return pd.DataFrame({"g": frame["g"], "_no": frame["_no"], "batch": frame["before"] + np.cumsum(begins)})

    e = entries.select(F.col("g").alias("_g"), F.col("s").alias("_s"), "first", "before")
    rows = slim.join(e, slim.g.eqNullSafe(e["_g"]) & (slim.s == e["_s"])).select("g", "s", "_no", "n", "own", "first", "before")
    numbers = materialise(rows.groupBy("g", "s").applyInPandas(cut, f"g {kind}, _no long, batch long"), "batches")
    numbers = numbers.select(F.col("g").alias("_g"), F.col("_no").alias("_n"), "batch")
    return places.join(numbers, places[group].eqNullSafe(numbers["_g"]) & (places["_no"] == numbers["_n"])).select(*tasks.columns, "batch")


def candidate_key(url: Column) -> Column:
    """What a search hit is a hit of: a post on X whatever the path, else the address."""
    post = x_post_id(url)
    return F.when(post.isNotNull(), F.concat(F.lit("x:"), post)).otherwise(F.nullif(evidence_url(url), F.lit("")))


def merged_candidates(hits: DataFrame) -> DataFrame:
    """Hits (url, provider, query) as one candidate per post or address; those that can't be shown go.

    A candidate is pending until its original is read: no hit verifies itself.
    """
    shown = hits.withColumn("_k", F.when(public_url(F.col("url")).isNotNull(), candidate_key(F.col("url")))).where("_k is not null")
    return shown.groupBy("_k").agg(
        F.min("url").alias("url"), F.array_sort(F.collect_set("url")).alias("aliases"), F.array_sort(F.collect_set("provider")).alias("providers"), F.count("*").alias("discoveries")
    ).select(F.concat(F.lit("SEARCH-"), F.upper(F.substring(F.sha2("_k", 256), 1, 16))).alias("candidate_id"), F.col("_k").alias("key"), "url", "aliases", "providers", "discoveries", F.lit("pending").alias("status"))


def search_progress(tasks: DataFrame, receipts: DataFrame) -> DataFrame:
    """``tasks`` with how far each came: searched or pending, and completed or incomplete."""
    found = receipts.groupBy("task_id").agg(F.bool_or("searched").alias("_searched"), F.bool_or(F.col("status").isin("ok", "no-results")).alias("_done"), F.array_sort(F.collect_list("status")).alias("statuses"))
    rows = tasks.join(found, "task_id", "left")
    return rows.withColumns({
        "execution": F.when(F.coalesce("_searched", F.lit(False)), "searched").otherwise("pending"), "discovery": F.when(F.coalesce("_done", F.lit(False)), "completed").otherwise("incomplete")
    }).drop("_searched", "_done")


def upstream_error(response: Column, depth: int = 4) -> Column:
    """The error that a provider's envelope reports within a successful answer; null for none."""
    found, v = F.lit(None).cast("string"), F.try_parse_json(response)
    for k in range(depth):
        at = "$" + ".data" * k
        code = F.coalesce(*[F.try_variant_get(v, f"{at}.{c}", "long") for c in ("code", "status_code", "statusCode")])
        failed = F.try_variant_get(v, f"{at}.success", "boolean") == F.lit(False)
        error = F.coalesce(F.to_json(F.try_variant_get(v, f"{at}.error", "variant")), F.to_json(F.try_variant_get(v, f"{at}.errors", "variant")))
        empty = error.isNull() | error.isin("null", '""', "[]", "{}", "false", "0")
        here = F.when(failed, "upstream_success_false").when(~code.isin(0, 200), "upstream_non_success_code").when(~empty, "upstream_error_payload")
        found = F.coalesce(found, here)
    return found


def verified_candidates(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """``candidates`` with the evidence that someone opened for them.

    ``evidence``: evidence_id, revision_id, url, original_text, supporting_quote, method, retracted.
    It must show the same post or address, have been opened, and hold its quote.
    """
    opened = evidence.where(
        F.col("method").isin("opened_page", "authorized_browser") & ~F.coalesce("retracted", F.lit(False)) & F.coalesce(F.col("original_text").contains(F.col("supporting_quote")), F.lit(False))
    )
    found = opened.withColumn("key", candidate_key(F.col("url"))).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("evidence_id", "revision_id"))).alias("verified_by"))
    return candidates.join(found, "key", "left").withColumn("verified", F.col("verified_by").isNotNull())


def fallbacks(requests: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Alternatives that may stand in for a request: same query group, scope and keyword, another source."""
    alt = alternatives.select(F.col("id").alias("fallback_id"), F.col("source").alias("fallback_source"), "query_group", "query_scope", "keyword")
    return requests.join(alt, ["query_group", "query_scope", "keyword"]).where(F.col("fallback_source") != F.col("source"))
