"""Registered queries of the evidence operators over the driver's tables, with their SQL.

The tables carry the semantics: ``events`` is an observation log (user: evidence, type: revision),
``documents`` and ``pages`` are bodies, ``labels`` reviews, ``conversations`` threads, ``orders`` and
``lineitem`` requests and attempts, ``part`` priced endpoints and candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import ids, text, times, urls
from lodestone.functions.shared import spread
from lodestone.operators import claims, coverage, funnel, ledger, library, needs, publish, quality, retrieval, state
from lodestone.plans import catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL it must equal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def moment(at: str) -> Column:
    """A literal that compares with the tables' times, and reaches the scan."""
    return F.lit(at).cast("timestamp_ntz")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("evidence_id"), F.col("event_type").alias("revision_id"), F.col("ts").alias("observed_at"), F.col("ts").alias("known_at"), F.col("event_id").alias("seq")
    )


SNAPSHOT = """(
  SELECT user_id AS evidence_id, max(event_type) FILTER (rn = 1) AS revision_id, max(ts) AS recorded_on,
    min(ts) AS first_observed_at, max(ts) AS last_observed_at, count(*) AS observations, count(DISTINCT event_type) AS revisions
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM events WHERE ts <= TIMESTAMP '{}')
  GROUP BY user_id)"""
MID, EARLY, LATE = "2024-01-15 23:59:59.999999", "2024-01-03 23:59:59.999999", "2024-01-20 23:59:59.999999"


@query(f"SELECT * FROM {SNAPSHOT.format(MID)}")
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = library.snapshot(event_log(spark, sf_dir), moment(MID))
    return found.select("evidence_id", "revision_id", "recorded_on", "first_observed_at", "last_observed_at", "observations", "revisions")


@query(f"""
SELECT a.evidence_id, CASE WHEN b.evidence_id IS NULL THEN 'added' WHEN b.revision_id <> a.revision_id THEN 'revised' ELSE 'reobserved' END AS change,
  b.revision_id AS before_revision_id, a.revision_id AS after_revision_id
FROM {SNAPSHOT.format(LATE)} a LEFT JOIN {SNAPSHOT.format(EARLY)} b USING (evidence_id)
WHERE b.evidence_id IS NULL OR b.revision_id <> a.revision_id OR b.last_observed_at <> a.last_observed_at""")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return library.delta(library.snapshot(log, moment(EARLY)), library.snapshot(log, moment(LATE)))


@query("SELECT event_type, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type")
def idempotent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    log = library.appended(library.distinct_events(events), events)
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("evidence_id"), F.lit("r1").alias("revision_id"), F.lit(date(2024, 1, 1)).alias("reviewed_at"), F.lit(date(2024, 1, 2)).alias("known_on"),
        F.col("doc_id").alias("seq"), F.when(F.col("quality") == 1, "relevant").otherwise("unrelated").alias("status"), F.when(F.col("toxic") == 1, "counter_evidence").otherwise("alternative").alias("evidence_role"),
    )


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_reviewed' WHEN quality = 1 THEN 'relevant' ELSE 'unrelated' END AS semantic_status,
  CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN toxic = 1 THEN 'counter_evidence' ELSE 'alternative' END END AS evidence_role
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.lit("r1").alias("revision_id"))
    found = library.reviewed(docs, library.latest_reviews(reviews(spark, sf_dir)))
    return found.select(F.col("evidence_id").alias("doc_id"), "semantic_status", "evidence_role")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY text")
def exact_dup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    found = quality.first_of_each(docs, [F.col("digest")], F.col("doc_id"), {"source": "sources"})
    return found.select("doc_id", "copies", F.array_join("sources", ",").alias("sources"))


URL_PARTS = r"""
  SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site,
    regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '#(.*)$', 1) AS frag,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '(?i)^(utm_.*|fbclid|gclid)$'))), '&') AS q
  FROM pages"""
WEAK = f"SELECT page_id, scheme || '://' || site || CASE path WHEN '' THEN '/' ELSE path END || CASE q WHEN '' THEN '' ELSE '?' || q END || CASE frag WHEN '' THEN '' ELSE '#' || frag END AS url FROM ({URL_PARTS})"


@query(rf"SELECT page_id, 'https://' || regexp_replace(site, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE q WHEN '' THEN '' ELSE '?' || q END AS url FROM ({URL_PARTS})")
def canonical_url_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.evidence_url(F.col("url")).alias("url"))


@query(WEAK)
def canonical_url_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.content_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, CASE WHEN page_id <> min(page_id) OVER (PARTITION BY url) THEN min(page_id) OVER (PARTITION BY url) END AS duplicate_of FROM ({WEAK})")
def repost_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reposts(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", "url").select("page_id", "duplicate_of")


TERMS = rf"""list_filter(list_distinct(regexp_extract_all(replace(lower(substr(trim(regexp_replace(regexp_replace(coalesce({{0}}, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 4000)), 'ß', 'ss'),
  '[\p{{{{L}}}}\p{{{{M}}}}\p{{{{N}}}}]+')), lambda t: t NOT IN ({quoted(text.STOP_WORDS)}))"""
QUERY_TERMS = rf"list_filter({TERMS}, lambda t: t NOT IN ({quoted(text.QUERY_STOP_WORDS)}) AND NOT regexp_matches(t, '^[0-9]+$'))"


def answered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the turn that answers them."""
    turns = table(spark, sf_dir, "conversations")
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.where("role = 'user'").join(reply, ["conv_id", "turn"])


@query(f"""
WITH t AS (
  SELECT u.conv_id, u.turn, {QUERY_TERMS.format("u.text")} AS want, {TERMS.format("r.text")} AS have
  FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1 AND u.role = 'user' AND r.role = 'assistant')
SELECT conv_id, turn, len(want)::BIGINT AS wanted, len(list_intersect(want, have))::BIGINT AS matched,
  CASE WHEN len(want) > 0 THEN round(len(list_intersect(want, have)) / len(want), 4) ELSE 0.0 END AS overlap
FROM t""".replace("{{", "{").replace("}}", "}"))
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answered_turns(spark, sf_dir).select("conv_id", "turn", text.query_terms(F.col("text")).alias("want"), text.terms(F.col("reply")).alias("have"))
    return rows.select(
        "conv_id", "turn", F.size("want").cast("long").alias("wanted"), F.size(F.array_intersect("want", "have")).cast("long").alias("matched"),
        quality.overlap(F.col("want"), F.col("have")).alias("overlap"),
    )


@query(f"""
WITH t AS (
  SELECT u.conv_id, u.turn, {QUERY_TERMS.format("u.text")} AS want, {TERMS.format("r.text")} AS have
  FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1 AND u.role = 'user' AND r.role = 'assistant'),
m AS (SELECT *, list_intersect(want, have) AS shared FROM t),
a AS (SELECT *, len(list_filter(shared, lambda x: x NOT IN ({quoted(text.BROAD_TERMS)}))) AS anchors, CASE WHEN len(want) > 0 THEN round(len(shared) / len(want), 4) ELSE 0.0 END AS score FROM m),
s AS (SELECT *, anchors > 0 AND ((len(want) = 1 AND len(shared) = 1) OR (len(shared) >= 2 AND score >= 0.35)) AS strong FROM a)
SELECT conv_id, turn, score AS local_relevance,
  CASE WHEN len(want) = 0 OR len(have) = 0 THEN 'unknown' WHEN strong THEN 'relevant' WHEN len(shared) > 0 THEN 'unknown' ELSE 'unrelated' END AS relevance_status,
  CASE WHEN len(want) = 0 OR len(have) = 0 THEN 'unassessable' WHEN strong THEN 'matched' WHEN len(shared) > 0 THEN 'weak_match' ELSE 'no_match' END AS lexical_status
FROM s""".replace("{{", "{").replace("}}", "}"))
def quality_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("date")
    window = times.research_window(date(2026, 7, 14))
    found = quality.assessed(spread(answered_turns(spark, sf_dir)), window, F.col("text"), F.col("reply"), none, none, none)
    return found.select("conv_id", "turn", "local_relevance", "relevance_status", "lexical_status")


@query("""
SELECT lang, CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[가-힯]') THEN 'ko' WHEN regexp_matches(text, '[㐀-鿿]') THEN 'zh' ELSE 'unknown' END AS guess,
  count(*) AS n, count(*) FILTER (NOT regexp_matches(text, '[^\\x00-\\x{24F}\\x{2000}-\\x{20CF}]')) AS latin FROM documents GROUP BY 1, 2""".replace("\\\\", "\\"))
def language_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", text.language(F.col("text")).alias("guess"), F.col("text").rlike(r"[^\x00-\x{24F}\x{2000}-\x{20CF}]").alias("other"))
    return docs.groupBy("lang", "guess").agg(F.count("*").alias("n"), F.count_if(~F.col("other")).alias("latin"))


@query("""
WITH s AS (SELECT source, count(*) AS n, sum(n_chars) AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY source),
r AS (
  SELECT source AS key, 0 AS stream, row_number() OVER (ORDER BY n DESC, source) AS rank FROM s UNION ALL
  SELECT source, 1, row_number() OVER (ORDER BY chars DESC, source) FROM s UNION ALL
  SELECT source, 2, row_number() OVER (ORDER BY langs DESC, source) FROM s WHERE langs > 1),
f AS (SELECT key, sum(1 / (60.0::DOUBLE + rank)) AS score, min(stream * 1000000 + rank) AS seen FROM r GROUP BY key)
SELECT key, row_number() OVER (ORDER BY round(score, 12) DESC, seen, key) AS position, round(score, 9) AS score FROM f""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"))
    streams = None
    for k, (rows, score) in enumerate([(s, "n"), (s, "chars"), (s.where("langs > 1"), "langs")]):
        part = funnel.ranked(rows, score, "source").select(F.lit(k).alias("stream"), F.col("rank"), F.col("source").alias("key"))
        streams = part if streams is None else streams.unionByName(part)
    found = retrieval.reciprocal_rank_fusion(streams)
    return found.select("key", F.col("position").cast("long").alias("position"), F.round("score", 9).alias("score"))


WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')"


@query(rf"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
c AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w),
p AS (SELECT doc_id, term, len(words) AS length, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS term FROM w) WHERE term IN ('the', 'license') GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
FROM p JOIN d USING (term), c GROUP BY doc_id HAVING count(*) = 2""")
def bm25_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n, mean = retrieval.looked_up(table(spark, sf_dir, "documents"), "doc_id", "text", ["the", "license"])
    found = retrieval.bm25(index, "doc_id", ["the", "license"], n, mean)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(rf"SELECT doc_id FROM documents WHERE list_contains({WORDS}, 'license') AND list_contains({WORDS}, 'version')")
def query_terms_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.all_terms(table(spark, sf_dir, "documents"), "text", ["license", "version"]).select("doc_id")


@query("""
SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
FROM documents WHERE lower(text) LIKE '%licens%' AND lower(text) LIKE '%under%'""")
def substring_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text", "source", F.col("n_chars").alias("last_observed_at"))
    found = retrieval.recency_order(retrieval.substring_match(docs, "text", ["licens", "under"]), ["source"])
    return found.select(F.col("evidence_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


STATUS = "CASE WHEN value < 2 THEN 'rate-limited' WHEN value < 20 THEN 'no-results' ELSE 'ok' END"


@query(f"""
SELECT user_id AS source, CASE WHEN bool_or(s = 'rate-limited') THEN CASE WHEN count(DISTINCT s) = 1 THEN min(s) ELSE 'partial' END
  WHEN bool_or(s = 'ok') THEN 'ok' ELSE 'no-results' END AS status
FROM (SELECT user_id, {STATUS} AS s FROM events) GROUP BY user_id""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.source_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.expr(STATUS).alias("status")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").withColumns({
        "actor": F.when(F.col("quality") == 1, "user").when(F.col("quality") == 0, "supplier"),
        "query_match": F.when(F.col("toxic") == 0, "direct").when(F.col("toxic") == 1, "unrelated"),
        "signal": F.when(F.col("quality") == 1, "task").when(F.col("quality") == 0, "promotion"),
        "window_status": F.when(F.col("n_chars") < 2000, "in_window").otherwise("out_of_window"),
    })


@query("""
SELECT source, lang, GROUPING(source, lang)::BIGINT AS level, count(*) AS material_count, count(quality) AS labeled_count, count(*) - count(quality) AS unlabeled_count,
  count(*) FILTER (quality = 1 AND toxic = 0) AS direct_user_signal_count, count(*) FILTER (quality = 1 AND toxic = 0 AND n_chars < 2000) AS recent_direct_user_signal_count,
  count(*) FILTER (quality = 0) AS supplier_count, count(*) FILTER (quality = 0) AS promotion_count, round(count(quality) / count(*), 4) AS label_coverage
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), (lang), ())""")
def label_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.label_statistics(labelled(spark, sf_dir), [["source"], ["lang"], []])
    return found.select(
        "source", "lang", F.col("grouping").cast("long").alias("level"), "material_count", "labeled_count", "unlabeled_count", "direct_user_signal_count",
        "recent_direct_user_signal_count", "supplier_count", "promotion_count", "label_coverage",
    )


@query("""
SELECT lang, count(*) FILTER (fresh) AS material_count, count(*) FILTER (NOT fresh) AS historical_evidence_count, count(*) FILTER (fresh AND quality IS NOT NULL) AS semantic_reviewed_count,
  count(*) FILTER (fresh AND quality = 1) AS semantic_related_count, count(*) FILTER (fresh AND quality IS NULL) AS unreviewed_evidence_count,
  count(*) FILTER (fresh AND n_chars < 2000) AS recent_evidence_count, count(*) FILTER (fresh AND quality = 1 AND toxic = 1) AS counter_evidence_count,
  array_to_string(list_filter(['recent_user_behavior', 'commercial_benchmark',
    CASE WHEN count(*) FILTER (fresh AND quality = 1 AND toxic = 0) = 0 THEN 'alternative' END, CASE WHEN count(*) FILTER (fresh AND quality = 1 AND toxic = 1) = 0 THEN 'counter_evidence' END,
    CASE WHEN count(*) FILTER (fresh AND quality IS NULL) > 0 THEN 'semantic_review' END], lambda x: x IS NOT NULL), ',') AS gaps,
  array_to_string(list_sort(list_distinct(list(source) FILTER (fresh))), ',') AS sources
FROM (SELECT *, n_chars >= 500 AS fresh FROM documents) LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def coverage_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumns({
        "object_key": F.col("doc_id"), "fresh": F.col("n_chars") >= 500, "relevance_status": F.lit("unknown"), "verified": F.lit(False),
        "semantic": F.when(F.col("quality") == 1, "relevant").when(F.col("quality") == 0, "unrelated").otherwise("not_reviewed"),
        "role": F.when(F.col("toxic") == 1, "counter_evidence").otherwise("alternative"),
    })
    counts = ["material_count", "historical_evidence_count", "semantic_reviewed_count", "semantic_related_count", "unreviewed_evidence_count", "recent_evidence_count", "counter_evidence_count"]
    return coverage.coverage(rows, ["lang"]).select("lang", *counts, F.array_join("review_gaps", ",").alias("gaps"), F.array_join("sources", ",").alias("sources"))


@query("""
SELECT count(*) FILTER (NOT h) AS current_evidence_count, count(*) FILTER (NOT h AND r) AS current_reviewed_evidence_count, count(*) FILTER (NOT h AND NOT r) AS current_unreviewed_evidence_count,
  count(*) FILTER (h) AS historical_evidence_count, count(*) FILTER (h AND r) AS historical_reviewed_evidence_count, count(*) FILTER (h AND NOT r) AS historical_unreviewed_evidence_count,
  count(*) FILTER (q) AS qualified_count, CASE WHEN count(*) FILTER (q) > 0 THEN NULL WHEN count(*) FILTER (NOT r) > 0 THEN 'coverage_or_evidence_incomplete' ELSE 'no_qualified_candidates_in_reviewed_material' END AS zero_result_reason
FROM (SELECT n_chars < 500 AS h, quality IS NOT NULL AS r, false AS q FROM documents LEFT JOIN labels USING (doc_id))""")
def zero_result_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select((F.col("n_chars") < 500).alias("historical"), F.col("quality").isNotNull().alias("reviewed"), F.lit(False).alias("qualified"))
    return coverage.research_quality(rows)


@query("""
SELECT CASE WHEN ts::DATE BETWEEN DATE '2024-01-11' AND DATE '2024-01-20' THEN 'in_window' ELSE 'out_of_window' END AS status, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def window_status_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("date")
    status = times.window_status(F.to_date("ts"), none, none, times.research_window(date(2024, 1, 20), 10))
    return table(spark, sf_dir, "events").groupBy(status.alias("status"), "event_type").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE WHEN a > b THEN 'unknown' WHEN a >= lo AND b <= hi THEN 'in_window' WHEN b < lo OR a > hi THEN 'out_of_window' ELSE 'uncertain' END AS by_interval,
  CASE WHEN (a BETWEEN lo AND hi) <> (b BETWEEN lo AND hi) THEN 'uncertain' WHEN a BETWEEN lo AND hi THEN 'in_window' ELSE 'out_of_window' END AS by_ends
FROM (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_custkey % 90)::INTEGER - 5 AS b, DATE '1997-06-01' AS lo, DATE '1997-06-30' AS hi FROM orders)""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    window, none = times.research_window(date(1997, 6, 30)), F.lit(None).cast("date")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 90 - 5).cast("int")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("o_orderkey", times.window_status(none, a, b, window).alias("by_interval"), times.coverage_window(none, a, b, window).alias("by_ends"))


@query("""
WITH d AS (SELECT user_id AS item_id, max(ts)::DATE AS s, CASE WHEN count(*) FILTER (event_type = 'signup') > 2 THEN max(ts) FILTER (event_type = 'signup')::DATE END AS m FROM events GROUP BY user_id),
v AS (SELECT item_id, CASE WHEN s IS NOT NULL AND m IS NOT NULL THEN least(s, m) END AS verified_on FROM d)
SELECT item_id, verified_on, verified_on + 30 AS due_on, CASE WHEN verified_on IS NULL THEN 'unknown' WHEN DATE '2024-02-23' > verified_on + 30 THEN 'overdue'
  WHEN DATE '2024-02-23' >= verified_on + 30 - 7 THEN 'due' ELSE 'fresh' END AS status FROM v""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    signup = F.col("event_type") == "signup"
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.to_date(F.max("ts")).alias("source_day"), F.when(F.count_if(signup) > 2, F.to_date(F.max(F.when(signup, F.col("ts"))))).alias("semantic_day")
    ).withColumn("revision_id", F.lit("r1"))
    items = days.select(F.col("id").alias("item_id"), F.array(F.struct("id", "revision_id")).alias("refs"))
    return publish.item_freshness(items, days, date(2024, 2, 23)).select("item_id", "freshness.*")


STATE = "CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'started' END"


@query(f"""
SELECT o_orderpriority AS source, count(*) AS attempts, count(*) FILTER (s = 'succeeded') AS succeeded, count(*) FILTER (s = 'failed') AS failed,
  count(*) FILTER (s = 'started') AS outcome_unknown, sum(l_extendedprice::DECIMAL(38,12))::DOUBLE AS list_cost
FROM (SELECT *, {STATE} AS s FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def attempt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_orderkey").alias("fingerprint"), F.expr(STATE).alias("state"),
        F.col("l_extendedprice").alias("list_cost_usd"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("estimated_cost_usd"),
    )
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderkey").alias("fingerprint"), F.col("o_orderpriority").alias("source"))
    joined = ledger.attempts_with_source(ledger.recovered(attempts), requests)
    return ledger.ledger(joined.where("source <> 'unknown'"), ["source"]).select("source", "attempts", "succeeded", "failed", "outcome_unknown", F.col("list_cost").cast("double").alias("list_cost"))


@query("""
SELECT count(*) AS entries, coalesce(sum(a) FILTER (d = DATE '1997-06-15'), 0)::DOUBLE AS daily_occupied, coalesce(sum(a) FILTER (strftime(d, '%Y-%m') = '1997-06'), 0)::DOUBLE AS monthly_occupied,
  sum(a)::DOUBLE AS total_occupied, greatest(0, 5000000 - coalesce(sum(a) FILTER (d = DATE '1997-06-15'), 0))::DOUBLE AS daily_remaining,
  greatest(0, 1000 - coalesce(sum(a) FILTER (strftime(d, '%Y-%m') = '1997-06'), 0))::DOUBLE AS monthly_remaining
FROM (SELECT o_orderdate::DATE AS d, o_totalprice::DECIMAL(38,12) AS a FROM orders)""")
def budget_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("list_cost_usd"))
    found = ledger.budget(entries, date(1997, 6, 15), {"daily": Decimal(5000000), "monthly": Decimal(1000), "total": None})
    return found.select("entries", *[F.col(c).cast("double").alias(c) for c in ("daily_occupied", "monthly_occupied", "total_occupied", "daily_remaining", "monthly_remaining")])


@query("""
WITH p AS (SELECT p_partkey AS endpoint, max(p_retailprice::DECIMAL(38,12)) AS cost, bool_and(p_size > 10) AS discount, bool_and(p_size > 25) AS credit FROM part GROUP BY 1)
SELECT l_returnflag AS source, count(*) AS requests, sum(cost)::DOUBLE AS list_cost, sum(CASE WHEN discount THEN cost * 0.8 ELSE cost END)::DOUBLE AS discounted_cost,
  sum(CASE WHEN credit THEN cost END)::DOUBLE AS credit_eligible, count(*) FILTER (cost IS NULL) AS unpriced
FROM lineitem LEFT JOIN p ON endpoint = l_partkey GROUP BY 1""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = ledger.pricing(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("endpoint"), F.col("p_retailprice").alias("cost"), (F.col("p_size") > 10).alias("allow_discount"), (F.col("p_size") > 25).alias("allow_free_credit")))
    requests = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("endpoint"), F.col("l_returnflag").alias("source"))
    found = ledger.cost_estimate(requests, prices, Decimal("0.8"))
    return found.select("source", "requests", *[F.col(c).cast("double").alias(c) for c in ("list_cost", "discounted_cost", "credit_eligible")], "unpriced")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal FROM lineitem")
def attempt_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("_o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return ledger.attempt_ordinals(rows, ["l_orderkey"], "_o").select("l_orderkey", "l_linenumber", "l_partkey", F.col("ordinal").cast("long").alias("ordinal"))


@query("""
WITH c AS (SELECT orders.*, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT c_mktsegment AS source, count(*) AS requests, count(*) FILTER (o_orderstatus = 'F') AS ok, sum(o_totalprice::DECIMAL(38,12))::DOUBLE AS cost,
  round(sum(o_totalprice::DECIMAL(38,12))::DOUBLE / count(DISTINCT o_custkey), 4) AS per_evidence FROM c GROUP BY 1""")
def cost_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("source")), "o_custkey")
    runs = joined.select("source", F.col("o_orderkey").alias("content_hash"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"), F.col("o_totalprice").alias("cost_usd"))
    found = ledger.cost_yield(runs, joined.select("source", F.col("o_custkey").alias("evidence_id"), F.lit(True).alias("linked")))
    return found.select("source", "requests", "ok", F.col("cost").cast("double").alias("cost"), F.round(F.col("cost").cast("double") / F.col("evidence"), 4).alias("per_evidence"))


FAMILY = "substr(sha256(trim(regexp_replace(lower(p_brand), '[^a-z0-9_]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(p_type), '[^a-z0-9_]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g'))), 1, 20)"
TIER = "CASE WHEN p_size < 3 THEN 'A' WHEN p_size < 25 THEN 'B' WHEN p_size < 40 THEN 'R' END"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size", "p_type", ids.fingerprint(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("family"), F.expr(TIER).alias("evidence_tier"))


@query(f"""
SELECT family, arg_min(p_partkey, l * 10000000 + p_partkey) AS p_partkey, arg_min(coalesce(t, '-'), l * 10000000 + p_partkey) AS tier, count(*) AS variants
FROM (SELECT {FAMILY} AS family, p_partkey, t, CASE t WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS l FROM (SELECT *, {TIER} AS t FROM part)) GROUP BY family""")
def family_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = funnel.families(candidates(spark, sf_dir), "family", "evidence_tier", "p_partkey")
    return found.select("family", "p_partkey", F.coalesce("evidence_tier", F.lit("-")).alias("tier"), "variants")


@query(f"""
SELECT p_partkey, coalesce(t, '-') AS tier, CASE WHEN (t = 'B' AND n > 40) OR (t = 'R' AND n > 80) THEN 'overflow' ELSE 'emitted' END AS bucket
FROM (SELECT p_partkey, t, row_number() OVER (PARTITION BY t ORDER BY p_partkey) AS n FROM (SELECT *, {TIER} AS t FROM part))""")
def tier_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.capped(candidates(spark, sf_dir), "evidence_tier", "p_partkey").select("p_partkey", F.coalesce("evidence_tier", F.lit("-")).alias("tier"), "bucket")


@query(f"""
SELECT count(*) AS families, count(*) FILTER (t = 'A') AS tier_a, least(count(*) FILTER (t = 'B'), 40) AS tier_b, least(count(*) FILTER (t = 'R'), 80) AS tier_r,
  count(*) FILTER (t = 'B') AS tier_b_qualified, count(*) FILTER (t = 'R') AS tier_r_qualified, count(*) FILTER (t IS NULL) AS rejected FROM (SELECT {TIER} AS t FROM part)""")
def tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.tier_summary(funnel.capped(candidates(spark, sf_dir), "evidence_tier", "p_partkey"))


SCORE_PARTS = {"demand": 11, "new_form": 10, "distribution": 9, "regional_gap": 8, "monetization": 7, "mvp_feasibility": 6, "evidence": 5}
SCORE_SQL = {track: " + ".join(f"{w} * (p_size % {SCORE_PARTS[f]})" for f, w in weights.items()) for track, weights in funnel.WEIGHTS.items()}
TRACK = "CASE p_type WHEN 'ECONOMY' THEN 'needle' WHEN 'STANDARD' THEN 'new_form' WHEN 'PROMO' THEN 'regional_gap' END"


@query(f"""
SELECT p_partkey, total_score, CASE WHEN total_score >= 75 THEN '推荐' WHEN total_score >= 60 THEN '重点观察' WHEN total_score IS NOT NULL THEN '早期信号' END AS recommendation,
  row_number() OVER (PARTITION BY p_type ORDER BY total_score DESC NULLS LAST, p_partkey) AS rank
FROM (SELECT p_partkey, p_type, CASE {TRACK} {" ".join(f"WHEN '{t}' THEN round(({s})::DOUBLE, 1)" for t, s in SCORE_SQL.items())} END AS total_score FROM part)""")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.create_map(*[x for f, n in SCORE_PARTS.items() for x in (F.lit(f), (F.col("p_size") % n).cast("double"))])
    rows = funnel.scored(candidates(spark, sf_dir).withColumns({"track": F.expr(TRACK), "scores": scores}))
    return funnel.ranked(rows, "total_score", "p_partkey", ["p_type"]).select("p_partkey", "total_score", "recommendation", F.col("rank").cast("long").alias("rank"))


@query(r"""
SELECT page_id, (instr(html, t) - 1)::BIGINT AS start_at, (instr(html, t) - 1 + length(t))::BIGINT AS end_at, CASE WHEN t = '' THEN 'no_quote' END AS problem
FROM (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages) WHERE t <> ''""")
def claim_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("evidence_id"), F.lit("r1").alias("revision_id"), F.col("html").alias("original_text"))
    quote = F.regexp_extract("original_text", "<title>([^<]*)</title>", 1)
    made = pages.where(quote != "").select(F.col("evidence_id").alias("claim_id"), F.array(F.struct("evidence_id", "revision_id", quote.alias("quote"))).alias("refs"))
    found = claims.located(made, pages)
    return found.select(F.col("claim_id").alias("page_id"), F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "problem")


@query("""
WITH h AS (SELECT DISTINCT source AS provider, text FROM documents), n AS (SELECT text, count(*) AS n FROM h GROUP BY text)
SELECT provider, count(*) AS unique_candidate_count, count(*) FILTER (n = 1) AS exclusive_candidate_count, count(*) FILTER (n > 1) AS overlap_candidate_count FROM h JOIN n USING (text) GROUP BY provider""")
def provider_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.provider_overlap(table(spark, sf_dir, "documents").select(F.col("source").alias("provider"), F.sha2("text", 256).alias("candidate_id")))


@query("SELECT user_id, count(DISTINCT ts::DATE) AS occurrences, min(ts)::DATE AS first_seen, max(ts)::DATE AS last_seen FROM events GROUP BY user_id")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.occurrences(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("""
SELECT evidence_id, revision_id, row_number() OVER w AS version, lag(revision_id) OVER w AS supersedes
FROM (SELECT user_id AS evidence_id, 'R' || event_id AS revision_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE p IS NULL OR p <> event_type WINDOW w AS (PARTITION BY evidence_id ORDER BY ts, event_id)""")
def revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("evidence_id"), F.concat(F.lit("R"), "event_id").alias("revision_id"), "ts", "event_id", "event_type")
    found = state.revision_chain(rows, "evidence_id", ["ts", "event_id"], "event_type")
    return found.select("evidence_id", "revision_id", F.col("version").cast("long").alias("version"), "supersedes")


@query(f"SELECT user_id AS source, arg_max({STATUS}, (ts, event_id)) AS status, max(ts) AS since_check, count(*) AS events, count(*) FILTER ({STATUS} <> 'ok') AS failures FROM events GROUP BY user_id")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source"), F.expr(STATUS).alias("status"), F.col("ts").alias("at"))
    return state.health(rows.union(rows))


KIND = "CASE WHEN event_type = 'error' THEN 'withhold' WHEN event_type = 'signup' THEN 'remove_scope' ELSE 'publish' END"


@query(f"""
SELECT user_id AS item_id, CASE arg_max(k, (ts, event_id)) WHEN 'publish' THEN 'published' WHEN 'withhold' THEN 'withdrawn' ELSE 'out_of_scope' END AS status,
  arg_max(event_id, (ts, event_id)) FILTER (k = 'publish') AS revision_id, max(ts::DATE) FILTER (k = 'publish') AS last_observed
FROM (SELECT *, {KIND} AS k FROM events) GROUP BY user_id HAVING bool_or(k = 'publish')""")
def site_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("run_order"), F.col("event_id").alias("seq"), F.expr(KIND).alias("kind"), F.col("event_id").alias("revision_id"), F.to_date("ts").alias("day"))
    return publish.catalogue(rows)


@query(f"""
SELECT ([{quoted(catalog.PAID)}])[1 + (date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 1) % {len(catalog.PAID)}] AS source, count(*) AS orders FROM orders GROUP BY 1""")
def source_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(catalog.source_of_day(day, list(catalog.PAID)).alias("source")).agg(F.count("*").alias("orders"))


@query("""
WITH t AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS slot, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
a AS (SELECT n_name, count(c_custkey) % 3 AS attempts FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT n_regionkey, n_name AS task FROM (
  SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY attempts, ((slot - (date_diff('day', DATE '0001-01-01', DATE '2024-01-15') + 1) % n) % n + n) % n) AS r FROM t JOIN a USING (n_name)) WHERE r = 1""")
def due_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    per = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a")).select("n_regionkey", F.size("a").alias("n_tasks"), F.posexplode("a").alias("slot", "x"))
    tried = customers.groupBy(F.col("c_nationkey").alias("k")).agg((F.count("*") % 3).alias("attempts"))
    tasks = per.withColumn("k", F.col("x.n_nationkey")).join(tried, "k", "left").select("n_regionkey", F.col("x.n_name").alias("task_id"), "slot", "n_tasks", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.lit(False).alias("has_gaps"), F.lit("").alias("last_attempt"))
    return catalog.due_task(tasks, "n_regionkey", date(2024, 1, 15)).withColumnRenamed("task_id", "task")


@query("""
SELECT c_mktsegment AS target_user, o_orderpriority AS task, o_orderstatus AS need, count(DISTINCT o_orderkey) AS observations, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS products
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice >= 1000 GROUP BY 1, 2, 3""")
def need_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    rows = table(spark, sf_dir, "orders").join(people, "o_custkey").select(
        F.col("c_mktsegment").alias("target_user"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("need"), F.array().cast("array<string>").alias("constraints"),
        F.array(F.struct(F.col("o_orderkey").cast("string").alias("evidence_id"), F.lit("r1").alias("revision_id"), F.lit("q").alias("quote"))).alias("evidence_refs"), F.array("n_name").alias("products"),
        F.array(F.lit("all")).alias("industry_ids"), F.array(F.lit("orders")).alias("sources"), (F.col("o_totalprice") < 1000).alias("is_demo"), F.lit("complaint").alias("feedback_type"),
    )
    found = needs.clusters(needs.identified(rows))
    return found.select("about.target_user", "about.task", "about.need", F.size("observation_ids").cast("long").alias("observations"), F.array_join("products", ",").alias("products"))


@query("""
WITH RECURSIVE e AS (
  SELECT o_custkey, o_orderkey, o_totalprice::DECIMAL(24,12) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (
  SELECT o_custkey, o_orderkey, i, a <= 600000 AS accepted, CASE WHEN a <= 600000 THEN a ELSE 0 END::DECIMAL(24,12) AS used FROM e WHERE i = 1 UNION ALL
  SELECT e.o_custkey, e.o_orderkey, e.i, used + a <= 600000, (used + CASE WHEN used + a <= 600000 THEN a ELSE 0 END)::DECIMAL(24,12) FROM f JOIN e ON e.o_custkey = f.o_custkey AND e.i = f.i + 1)
SELECT o_custkey, o_orderkey, accepted FROM f""")
def budget_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders fit their customer's budget in turn."""
    entries = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast(ledger.MONEY).alias("list_cost_usd"))
    return ledger.reservations(entries, "o_custkey", ["o_orderkey"], Decimal(600000)).select("o_custkey", "o_orderkey", "accepted")
