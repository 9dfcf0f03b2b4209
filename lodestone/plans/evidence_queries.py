"""Registered queries of selection, review, publication and search, in the manner of ``plans.queries``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import claims, coverage, discovery, funnel, needs, publish, retrieval, rules, state
from lodestone.plans.queries import moment, query, table


@query("""
SELECT doc_id, CASE WHEN s = e THEN 'zero_length' WHEN s >= 0 AND s < e AND e <= 90 THEN 'answer_span' ELSE 'unlocated' END AS range
FROM (SELECT doc_id, n_chars % 7 * 10 - 5 AS s, n_chars % 7 * 10 - 5 + n_chars % 3 * 40 AS e FROM documents)""")
def citation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("n_chars") % 7 * 10 - 5
    return table(spark, sf_dir, "documents").select("doc_id", coverage.citation_range(start, start + F.col("n_chars") % 3 * 40, F.lit(90)).alias("range"))


@query("""
WITH q AS (SELECT conv_id, turn, text, substr(text, 20, 6) AS a, substr(text, 150, 6) AS b FROM conversations),
p AS (SELECT *, CASE WHEN length(a) > 0 AND instr(text, a) > 0 THEN instr(text, a) - 1 END AS x, CASE WHEN length(b) > 0 AND instr(text, b) > 0 THEN instr(text, b) - 1 END AS y FROM q),
w AS (SELECT *, greatest(x - 60, 0) AS s1, least(x + length(a) + 60, length(text)) AS e1, greatest(y - 60, 0) AS s2, least(y + length(b) + 60, length(text)) AS e2 FROM p)
SELECT conv_id, turn,
  CASE WHEN x IS NULL AND y IS NULL THEN 0 WHEN x IS NULL OR y IS NULL THEN 1 WHEN greatest(s1, s2) <= least(e1, e2) THEN 1 ELSE 2 END::BIGINT AS windows,
  CASE WHEN x IS NULL AND y IS NULL THEN 0 WHEN y IS NULL THEN e1 - s1 WHEN x IS NULL THEN e2 - s2
    WHEN greatest(s1, s2) <= least(e1, e2) THEN greatest(e1, e2) - least(s1, s2) ELSE e1 - s1 + e2 - s2 END::BIGINT AS characters
FROM w""")
def quoted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = F.array(F.substring("text", 20, 6), F.substring("text", 150, 6))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.quote_windows(F.col("text"), quotes).alias("w"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select("conv_id", "turn", F.size("w").cast("long").alias("windows"), total.alias("characters"))


@query(r"""
WITH p AS (
  SELECT url, page_id % 3 AS provider, 'https://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') ||
    CASE q WHEN '' THEN '' ELSE '?' || q END AS key
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '(?i)^(utm_.*|fbclid|gclid)$'))), '&') AS q FROM pages))
SELECT 'SEARCH-' || upper(substr(sha256(key), 1, 16)) AS candidate_id, min(url) AS url, string_agg(DISTINCT provider::VARCHAR, ',' ORDER BY provider::VARCHAR) AS providers, count(*) AS discoveries
FROM p GROUP BY key""")
def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 3).cast("string").alias("provider"))
    return discovery.merged_candidates(hits).select("candidate_id", "url", F.array_join("providers", ",").alias("providers"), "discoveries")


@query("""
SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality = 1 AND lang = 'en' AND contains(lower(coalesce(text, '')), 'the')""")
def public_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    items = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 1, "published").otherwise("withheld").alias("status"), F.array("source", "lang").alias("industry_ids"), F.col("text").alias("title"),
        *[F.lit(None).cast("string").alias(c) for c in ("target_user", "problem", "summary")],
    )
    return publish.matching(items, "published", "en", "The").select("doc_id")


VALUES = {0: "TBD later", 1: "  ", 2: "未知", 3: " said "}


@query("""
SELECT event_id, event_id % 5 NOT IN (0, 1, 2) AS present, event_id % 4 <> 0 AND event_type <> 'error' AS active
FROM events""")
def standing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.lit("plain")
    for k, said in VALUES.items():
        value = F.when(F.col("event_id") % 5 == k, said).otherwise(value)
    retracted = F.when(F.col("event_id") % 4 == 0, True).when(F.col("event_id") % 4 == 1, False)
    status = F.when(F.col("event_type") == "error", "superseded")
    return table(spark, sf_dir, "events").select("event_id", text.present(value).alias("present"), funnel.active(retracted, status).alias("active"))


@query("""
WITH h AS (SELECT user_id, ts::DATE AS day, event_id, event_type FROM events),
seen AS (SELECT user_id, arg_max(event_type, (day, event_id)) AS event_type FROM h WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-16' GROUP BY user_id),
r AS (SELECT o_custkey AS user_id, min(o_orderdate::DATE) AS day FROM orders GROUP BY o_custkey)
SELECT * FROM seen UNION ALL SELECT user_id, NULL FROM r WHERE NOT EXISTS (FROM h WHERE h.user_id = r.user_id) AND day <= DATE '2024-01-16'""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by last event within a week; customers with orders who never had an event show as they are."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type")
    records = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min(F.to_date("o_orderdate")).alias("day")).withColumns({"event_id": F.lit(None).cast("long"), "event_type": F.lit(None).cast("string")})
    return state.window_view(events, records, "user_id", date(2024, 1, 16), 7, "event_id").select("user_id", "event_type")


@query(r"""
SELECT page_id // 5 AS bundle, count(DISTINCT regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '')) AS sources
FROM pages GROUP BY page_id // 5""")
def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    item = F.struct("url", none.alias("original_url"), none.alias("original_publisher"), F.lit(False).alias("retracted"), none.alias("status"))
    bundles = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 5).alias("bundle")).agg(F.collect_list(item).alias("evidence"))
    return bundles.select("bundle", funnel.independent_sources(F.col("evidence")).cast("long").alias("sources"))


@query("""
WITH t AS (SELECT doc_id, greatest(row_number() OVER (PARTITION BY source ORDER BY doc_id), row_number() OVER (PARTITION BY lang ORDER BY doc_id)) AS turn FROM documents),
p AS (SELECT *, row_number() OVER (ORDER BY turn, doc_id) AS position FROM t)
SELECT doc_id, turn, position, 'READ-' || lpad(((position - 1) // 15 + 1)::VARCHAR, greatest(4, length(((position - 1) // 15 + 1)::VARCHAR))::INTEGER, '0') AS batch_id FROM p""")
def reading_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.diversified(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id")
    return claims.reading_batches(rows, "position").select("doc_id", "turn", "position", "batch_id")


@query("""
SELECT doc_id FROM documents WHERE n_chars > 4000 UNION
SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION
SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE n_chars > 20000)""")
def context_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.lit("r1").alias("revision_id"), "source", "n_chars")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("evidence_id"))
    found = claims.context_union(rows.where("n_chars > 4000"), rows, {"evidence_id": toxic, "source": rows.where("n_chars > 20000")})
    return found.select(F.col("evidence_id").alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def unpacked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda rows: rows.select(F.col("doc_id").alias("evidence_id"), F.lit("r1").alias("revision_id"))
    packet = ids(table(spark, sf_dir, "labels").where("quality = 1"))
    return claims.without(ids(table(spark, sf_dir, "documents")), packet).select(F.col("evidence_id").alias("doc_id"))


@query("""
WITH r AS (SELECT o_custkey AS task_id, bool_or(o_orderstatus <> 'P') AS searched, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS done, count(*) AS receipts FROM orders GROUP BY o_custkey)
SELECT c_custkey AS task_id, CASE WHEN searched THEN 'searched' ELSE 'pending' END AS execution, CASE WHEN done THEN 'completed' ELSE 'incomplete' END AS discovery, coalesce(receipts, 0) AS receipts
FROM customer LEFT JOIN r ON task_id = c_custkey""")
def search_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("o_orderpriority") == "1-URGENT", "ok").when(F.col("o_orderpriority") == "2-HIGH", "no-results").otherwise("failed")
    receipts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), (F.col("o_orderstatus") != "P").alias("searched"), done.alias("status"))
    found = discovery.search_progress(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id")), receipts)
    return found.select("task_id", "execution", "discovery", F.coalesce(F.size("statuses"), F.lit(0)).cast("long").alias("receipts"))


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC, event_id DESC) AS r FROM events WHERE ts::DATE <= DATE '2024-01-18')
SELECT user_id AS experiment_id, event_id, event_type IN ('purchase', 'click') AND value > 5 AND event_id % 3 > 0 AS usable_for_priority FROM e WHERE r = 1""")
def experiment_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "stopped").otherwise("running")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("experiment_id"), "event_id", F.to_date("ts").alias("as_of"), F.col("event_id").alias("observed_at"), status.alias("status"),
        F.when(F.col("value") > 5, "sold").otherwise(" ").alias("outcome"), (F.col("event_id") % 3).alias("traceable_evidence"),
    )
    return state.experiments(rows, F.lit(date(2024, 1, 18))).select("experiment_id", "event_id", "usable_for_priority")


@query("""
SELECT 'SIG-' || p_partkey AS record_id, 'promoted' AS kind, 'OPP-' || p_partkey AS other_id FROM part WHERE p_size > 25 UNION ALL
SELECT 'OPP-' || p_partkey, 'opened', 'SIG-' || p_partkey FROM part WHERE p_size > 25""")
def signal_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("SIG-"), F.col("p_partkey").cast("string")).alias("signal_id"), (F.col("p_size") > 25).alias("promoted"), F.lit(date(2024, 1, 1)).alias("day"))
    return state.promotions(rows).select("record_id", "kind", "other_id")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id AS batch_id, CASE WHEN event_type = 'purchase' THEN 'committed' WHEN ts + INTERVAL 2 DAY <= TIMESTAMP '2024-01-30 00:00:00' THEN 'available' ELSE 'leased' END AS status
FROM l WHERE r = 1""")
def lease_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("batch_id"), F.col("ts").alias("claimed_at"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("committed"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires_at")
    )
    return state.lease_view(rows, moment("2024-01-30 00:00:00")).select("batch_id", "status")


@query("""
SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-20 00:00:00' OR (event_id % 2 = 0 AND ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-20 00:00:00') THEN 'future'
  WHEN event_id % 10 = 0 THEN 'missing_observation' ELSE 'visible' END AS visibility FROM events""")
def claim_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    observed = F.when(F.col("event_id") % 10 != 0, F.col("ts"))
    found = claims.visibility([F.col("ts"), later], observed, moment("2024-01-20 00:00:00"))
    return table(spark, sf_dir, "events").select("event_id", found.alias("visibility"))


@query("""
SELECT event_id, array_to_string(list_concat(CASE WHEN list_contains(k, 'z') THEN [] ELSE ['no z'] END, list_transform(list_sort(list_filter(k, lambda x: x NOT IN ('k', 'z'))), lambda x: 'unknown ' || x)), ',') AS problems
FROM (SELECT event_id, json_keys(props::JSON) AS k FROM events)""")
def contract_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.array_join(publish.contract_problems(F.col("props"), ["z"], ["k"]), ",").alias("problems"))


@query("SELECT doc_id AS item_id, 2 * doc_id + k AS id FROM documents, (VALUES (0), (1)) v(k) WHERE 2 * doc_id + k NOT IN (SELECT doc_id FROM labels)")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda k: F.struct((2 * F.col("doc_id") + k).alias("id"), F.lit("r1").alias("revision_id"))
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.array(ref(0), ref(1)).alias("refs"))
    return publish.dangling(items, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("r1").alias("revision_id"))).select("item_id", "id")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9_]+', '-', 'g'), '-') AS slug, CASE WHEN p_name = p_type THEN p_name ELSE p_name || ' ' || p_type END AS joined FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" / ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(name).alias("slug"), text.joined(F.col("p_name"), F.col("p_type")).alias("joined"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'upstream_non_success_code' WHEN 1 THEN 'upstream_success_false' WHEN 2 THEN 'upstream_error_payload' END AS error FROM events""")
def upstream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = {0: '{"code":500,"data":{}}', 1: '{"data":{"success":false}}', 2: '{"code":200,"data":{"data":{"error":"quota"}}}', 3: '{"code":0,"error":""}'}
    body = F.lit("no JSON")
    for k, said in bodies.items():
        body = F.when(F.col("event_id") % 5 == k, said).otherwise(body)
    return table(spark, sf_dir, "events").select("event_id", discovery.upstream_error(body).alias("error"))


@query("""
WITH c AS (
  SELECT n_nationkey AS pos, s, t, ch, ((si * 3 + ti) * 2 + ci) AS turn,
    'CAND-' || upper(substr(sha256('BENCH-' || n_nationkey || '|' || lower(s) || '|' || t || '|form|' || lower(n_name) || '|' || ch || '|'), 1, 10)) AS candidate_id
  FROM nation, (VALUES (0, 'Small shops'), (1, 'x')) a(si, s), (VALUES (0, 't1'), (1, 't2'), (2, 't3')) b(ti, t), (VALUES (0, 'c1'), (1, 'c2')) d(ci, ch)),
n AS (SELECT *, row_number() OVER (ORDER BY turn, pos) AS scan FROM c)
SELECT pos, s AS segment, t AS trigger, ch AS channel, candidate_id, scan FROM n WHERE scan <= 200""")
def axis_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as benchmarks, up to the report's 200 candidates; values that repeat another once normalised make no candidate."""
    texts = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("pos"), F.concat(F.lit("BENCH-"), F.col("n_nationkey").cast("string")).alias("benchmark_id"), texts("Small shops", "small-SHOPS", "x").alias("segments"), texts("t1", "t2", "t3").alias("triggers"),
        texts("form", "Form").alias("forms"), F.array("n_name").alias("regions"), texts("c1", "c2").alias("channels"), texts().alias("offers"),
    )
    return funnel.expanded(rows).select("pos", "segment", "trigger", "channel", "candidate_id", F.col("scan").cast("long").alias("scan"))


@query("SELECT doc_id AS evidence_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def recency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback order of a search; lengths stand for the times of last observation."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("n_chars").alias("last_observed_at"))
    return retrieval.recency_order(rows).select("evidence_id", "rank")


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY round(p_retailprice, 1) DESC, p_partkey) AS rank FROM part")
def stable_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round("p_retailprice", 1).alias("score"))
    return funnel.ranked(rows, "score", "id").select("id", "rank")


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 3 = doc_id % 4 THEN 'located' ELSE 'invalid' END AS reference_validation,
  array_to_string(list_filter([CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'rationale' END, CASE WHEN doc_id % 4 = 0 THEN 'evidence_refs' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents""")
def score_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = claims.basis(F.col("lang"), F.col("doc_id") % 4, F.col("doc_id") % 3)
    return table(spark, sf_dir, "documents").select("doc_id", found["reference_validation"].alias("reference_validation"), F.array_join(found["missing"], ",").alias("missing"))


@query("""
WITH i AS (SELECT conv_id, turn, text, length(text) AS n, sum(length(text) + 20) OVER (PARTITION BY conv_id) - 700 AS over FROM conversations),
g AS (SELECT *, over - coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY n DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM i),
c AS (SELECT *, CASE WHEN rest > 0 THEN least(n, greatest(rest, 100)) ELSE 0 END AS cut FROM g)
SELECT conv_id, turn, substr(text, 1, (n - cut)::BIGINT) AS text, cut > 0 AS text_truncated FROM c""")
def trimmed_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.length("text") + 20).alias("size"))
    return claims.trimmed(rows, ["conv_id"], "text", "turn", "size", 700).drop("size")


@query("""
WITH m AS (SELECT lang, count(*) FILTER (n_chars >= 500) AS material_count, count(*) FILTER (n_chars >= 500 AND doc_id % 9 <> 0 AND (quality = 1 OR toxic = 1)) AS related_evidence_count,
    count(*) FILTER (n_chars >= 500 AND doc_id % 9 <> 0 AND toxic = 1) AS verified_evidence_count, count(*) FILTER (n_chars < 500) AS historical_evidence_count
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang),
a AS (SELECT lang, count(DISTINCT (source, doc_id % 50)) AS request_count, count(DISTINCT CASE WHEN n_chars > 20000 THEN (source, doc_id % 50) END) AS failed_request_count
  FROM documents WHERE n_chars % 4 > 0 GROUP BY lang)
SELECT lang, coalesce(material_count, 0) AS material_count, coalesce(related_evidence_count, 0) AS related_evidence_count, coalesce(verified_evidence_count, 0) AS verified_evidence_count,
  coalesce(historical_evidence_count, 0) AS historical_evidence_count, coalesce(request_count, 0) AS request_count, coalesce(failed_request_count, 0) AS failed_request_count,
  CASE WHEN failed_request_count > 0 AND material_count > 0 THEN 'partial' WHEN verified_evidence_count > 0 THEN 'reviewed_evidence' WHEN related_evidence_count > 0 THEN 'related_material'
    WHEN material_count > 0 THEN 'needs_relevance_review' WHEN failed_request_count > 0 THEN 'collection_failed' WHEN request_count > 0 THEN 'no_results' WHEN scheduled THEN 'not_collected' ELSE 'not_scheduled' END AS status
FROM (SELECT DISTINCT lang, true AS scheduled FROM documents UNION ALL VALUES ('xx', true), ('yy', false)) t LEFT JOIN m USING (lang) LEFT JOIN a USING (lang) WHERE lang IS NOT NULL""")
def verified_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    topics = docs.where("lang is not null").select("lang").distinct().withColumn("scheduled", F.lit(True)).union(spark.createDataFrame([("xx", True), ("yy", False)], "lang string, scheduled boolean"))
    material = docs.select(
        "lang", F.col("doc_id").alias("object_key"), "source", (F.col("n_chars") >= 500).alias("fresh"), F.when(F.col("quality") == 1, "relevant").alias("relevance_status"), (F.col("toxic") == 1).alias("verified"), (F.col("doc_id") % 9 == 0).alias("is_demo")
    )
    status = F.when(F.col("n_chars") % 4 == 0, "skipped").when(F.col("n_chars") > 20000, "timeout").otherwise("ok")
    attempts = docs.select("lang", "source", (F.col("doc_id") % 50).alias("request_id"), status.alias("status"))
    return coverage.verified_coverage(topics, material, attempts, "lang").drop("scheduled")


@query("""
SELECT c_mktsegment AS target_user, o_orderpriority AS task, o_orderstatus AS need, c_nationkey::VARCHAR AS product, count(DISTINCT o_orderkey) AS observations
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3, 4""")
def product_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("product"))
    rows = table(spark, sf_dir, "orders").join(people, "o_custkey").select(
        F.col("c_mktsegment").alias("target_user"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("need"), "product", F.array(F.col("o_custkey").cast("string")).alias("constraints"),
        F.array(F.struct(F.col("o_orderkey").cast("string").alias("evidence_id"))).alias("evidence_refs"),
    )
    found = needs.identified(rows, "product").groupBy("cluster_id").agg(F.min(F.struct("target_user", "task", "need", "product")).alias("about"), F.count_distinct("observation_id").alias("observations"))
    return found.select("about.*", "observations")


@query("""
SELECT doc_id, list_filter([CASE WHEN n_chars > 1000 OR text IS NULL OR trim(text) = '' THEN 'text' END, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de') THEN 'lang' END], lambda x: x IS NOT NULL)::VARCHAR = '[]' AS strict
FROM documents""")
def strict_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"text": (F.length("text") <= 1000) & (F.trim("text") != ""), "lang": F.col("lang").isin("en", "de")}
    found = rules.violations(table(spark, sf_dir, "documents"), checks)
    return found.select("doc_id", (F.size("violations") == 0).alias("strict"))
