"""Registered queries of operators that no table shows as it is: the tables are put into responses, structs and JSON first."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import ids, text, times
from lodestone.functions.shared import dealt, new_path
from lodestone.operators import claims, coverage, derivations, discovery, funnel, ledger, library, needs, publish, quality, rules
from lodestone.plans import catalog
from lodestone.plans.queries import TIER, URL_PARTS, candidates, event_log, labelled, moment, query, quoted, table
from lodestone.sources import comments, readers, social

STRONG = rf"SELECT page_id, 'https://' || regexp_replace(site, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE q WHEN '' THEN '' ELSE '?' || q END AS url FROM ({URL_PARTS})"


@query("SELECT user_id AS evidence_id, event_type AS revision_id, count(DISTINCT value > 20) AS contents FROM events GROUP BY ALL HAVING count(DISTINCT value > 20) > 1")
def revision_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("value") > 20).alias("content_hash")), "seq")
    return library.revision_conflicts(log)


def responses(spark: SparkSession, sf_dir: str, source: str, field: str, item: dict) -> DataFrame:
    """The documents as recorded responses of a source, twenty items each."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("b"), F.struct(*[c.alias(n) for n, c in item.items()]).alias("i"))
    items = docs.groupBy("b").agg(F.sort_array(F.collect_list("i")).alias(field))  # twenty at most
    return items.select(F.lit(source).alias("source"), F.col("b").cast("string").alias("request_id"), F.lit("g").alias("query_group"), F.lit(date(2026, 7, 14)).alias("observed_at"), F.to_json(F.struct(field)).alias("response"))


@query("""
SELECT 'hackernews:' || doc_id AS id, source || ' in ' || lang AS title, 'note ' || doc_id AS original_text, source AS author, 'https://news.ycombinator.com/item?id=' || doc_id AS url,
  n_chars::DOUBLE AS points, CASE WHEN doc_id % 5 <> 0 THEN DATE '2023-11-14' + ((80000 + doc_id) // 86400)::INTEGER END AS day, CASE WHEN doc_id % 5 = 0 THEN 'no date' ELSE '' END AS warnings
FROM documents""")
def hackernews_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("doc_id") % 5 != 0, (F.lit(1699920000 + 80000) + F.col("doc_id")).cast("string"))
    item = {"objectID": F.col("doc_id").cast("string"), "title": F.concat_ws(" in ", "source", "lang"), "story_text": F.concat(F.lit("<p>note&nbsp;"), "doc_id"), "points": F.format_number("n_chars", 0), "author": F.col("source"), "created_at": at}
    found = social.normalised(responses(spark, sf_dir, "hackernews", "hits", item))
    return found.select("id", "title", "original_text", "author", "url", F.col("engagement")["points"].alias("points"), F.to_date("published_at").alias("day"), F.array_join("warnings", ",").alias("warnings"))


@query("""
SELECT 'twitter:' || doc_id AS id, 'post ' || doc_id AS original_text, lang AS language, 'https://x.com/' || source || '/status/' || doc_id AS url, n_chars::DOUBLE AS likes,
  DATE '2026-07-14' - (doc_id % 4)::INTEGER - 1 AS earliest, DATE '2026-07-14' - (doc_id % 4)::INTEGER AS latest FROM documents""")
def twitter_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = {"tweet_id": F.col("doc_id"), "text": F.concat(F.lit("post "), "doc_id"), "screen_name": F.col("source"), "lang": F.col("lang"), "favorites": F.col("n_chars"), "created_at": F.concat((F.col("doc_id") % 4).cast("string"), F.lit(" days ago"))}
    found = social.normalised(responses(spark, sf_dir, "twitter", "timeline", item))
    return found.select("id", "original_text", "language", "url", F.col("engagement")["likes"].alias("likes"), "published_at_interval.earliest", "published_at_interval.latest")


@query("""
WITH d AS (SELECT doc_id // 20 AS b, count(*) AS n, count(*) FILTER (doc_id % 7 <> 0) AS p FROM documents GROUP BY 1)
SELECT b::VARCHAR AS request_id, CASE WHEN b % 11 <> 3 THEN n END AS raw_items, CASE WHEN b % 11 <> 3 THEN p ELSE 0 END AS parsed_items,
  CASE WHEN b % 11 = 3 OR p = 0 THEN 'unrecognized_response' WHEN p = n THEN 'parsed' ELSE 'partial_parse' END AS parse_status FROM d""")
def parse_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = social.parse_status(github(spark, sf_dir))
    return found.select("request_id", *[F.col(c).cast("long").alias(c) for c in ("raw_items", "parsed_items")], "parse_status")


def github(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with items that lack an id, and some that aren't what the source sends."""
    rows = responses(spark, sf_dir, "github", "items", {"id": F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")), "title": F.col("source")})
    return rows.withColumn("response", F.when(F.col("request_id").cast("long") % 11 == 3, '{"other":[]}').otherwise(F.col("response")))


@query("""
WITH d AS (SELECT doc_id // 20 AS b, count(*) AS n, count(*) FILTER (doc_id % 7 <> 0) AS p FROM documents GROUP BY 1)
SELECT 'github' AS source, count(*) AS requests_seen, coalesce(sum(n) FILTER (b % 11 <> 3), 0)::BIGINT AS raw_items, coalesce(sum(p) FILTER (b % 11 <> 3), 0)::BIGINT AS parsed_items,
  count(*) FILTER (b % 11 = 3) AS requests_with_unknown_raw_count, count(*) FILTER (b % 11 <> 3 AND p < n AND p > 0) AS partial FROM d""")
def normaliser_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.normaliser_statistics(social.parse_status(github(spark, sf_dir)))
    return found.select("source", "requests_seen", *[F.col(c).cast("long").alias(c) for c in ("raw_items", "parsed_items")], "requests_with_unknown_raw_count", F.coalesce(F.col("parse_status")["partial_parse"], F.lit(0)).cast("long").alias("partial"))


def threads(spark: SparkSession, sf_dir: str, key: str, inner: str, outer: tuple[str, ...], mark: str) -> DataFrame:
    """User turns of chats, ten to a response, as comments, and their answers as replies within them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("has"))
    asked = turns.where("role = 'user'").join(reply, ["conv_id", "turn"], "left")
    one = lambda n, who: [n.cast("string").alias(key), F.concat(F.lit("turn "), n.cast("string")).alias("text"), F.lit(who).alias("author"), F.lit("2026-07-14").alias(mark)]
    below = F.array(F.struct(*one(F.col("turn") + 1, "assistant")))
    comment = F.struct("turn", *one(F.col("turn"), "user"), F.when(F.col("has"), below).alias(inner))
    page = asked.groupBy("conv_id", F.floor(F.col("turn") / 20).alias("p")).agg(F.sort_array(F.collect_list(comment)).alias("c"))
    body = F.transform("c", lambda c: c.dropFields("turn"))
    for name in reversed(outer):
        body = F.struct(body.alias(name))
    return page.select(F.concat_ws("-", "conv_id", "p").alias("post"), F.to_json(body).alias("response"))


ANSWERED = """
u AS (SELECT conv_id || '-' || (turn // 20) AS post, conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn // 20 ORDER BY turn) - 1 AS k FROM conversations WHERE role = 'user'),
r AS (SELECT u.* FROM u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.turn + 1 AND c.role = 'assistant')"""


@query(f"""
WITH {ANSWERED}
SELECT post AS payload_id, turn::VARCHAR AS id, NULL::VARCHAR AS parent_id, 1 AS depth, 'user' AS author FROM u UNION ALL
SELECT post, (turn + 1)::VARCHAR, turn::VARCHAR, 2, 'assistant' FROM r""")
def comment_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = threads(spark, sf_dir, "id", "children", ("children",), "created_at").withColumnRenamed("post", "payload_id")
    return social.comment_tree(spark, payloads, depth=4).select("payload_id", "id", "parent_id", F.col("depth").cast("int").alias("depth"), "author")


@query(f"""
WITH {ANSWERED}
SELECT post AS parent_item_id, turn::VARCHAR AS source_item_id, NULL::VARCHAR AS parent_comment_id, '/data/comments/' || k AS pointer, 'turn ' || turn AS original_text FROM u UNION ALL
SELECT post, (turn + 1)::VARCHAR, turn::VARCHAR, '/data/comments/' || k || '/reply_comment/0', 'turn ' || (turn + 1) FROM r""")
def nested_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = threads(spark, sf_dir, "cid", "reply_comment", ("data", "comments"), "create_time").select(F.lit("tiktok").alias("source"), F.col("post").alias("post_id"), "response")
    return comments.extracted(rows).select("parent_item_id", "source_item_id", "parent_comment_id", "pointer", "original_text")


@query("SELECT p_partkey, 'c' || p_partkey AS next_cursor, p_size % 2 = 0 AS has_more, p_size::BIGINT AS reported_total FROM part")
def comment_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string('{"data":{"data":{"cursor":"c%d","comments":[{"cursor":"no"}]},"has_more":%s},"total":%d}', "p_partkey", (F.col("p_size") % 2 == 0).cast("string"), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", comments.paging(body).alias("p")).select("p_partkey", "p.*")


@query("""
WITH p AS (SELECT o_custkey AS post_id, count(*) AS pages, count(DISTINCT o_orderkey % 5) AS requests, count(DISTINCT o_orderkey % 7) AS comments, max(o_orderkey) AS last FROM orders GROUP BY 1),
s AS (
  SELECT p.*, o_orderstatus = 'O' AS more, CASE WHEN last % 3 <> 0 THEN 'c' || last END AS cursor,
    EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = post_id AND e.o_orderkey < last AND e.o_orderkey % 7 = last % 7) AS old
  FROM p JOIN orders ON o_custkey = post_id AND o_orderkey = last),
t AS (SELECT *, CASE WHEN pages > requests THEN 'repeated_request' WHEN NOT more THEN 'complete' WHEN cursor IS NULL THEN 'no_cursor' WHEN old THEN 'no_new_comments' ELSE 'continue' END AS state FROM s)
SELECT post_id, pages, comments, state, CASE WHEN state = 'continue' THEN cursor END AS next_cursor FROM t""")
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("post_id"), k.alias("page"), (k % 5).cast("string").alias("fingerprint"), F.when(k % 3 != 0, F.concat(F.lit("c"), k)).alias("cursor"),
        (F.col("o_orderstatus") == "O").alias("has_more"), F.array((k % 7).cast("string")).alias("comment_ids"),
    )
    return comments.page_state(pages).select("post_id", "pages", F.col("comments").cast("long").alias("comments"), "state", "next_cursor")


@query("""
WITH p AS (SELECT o_orderpriority AS source, o_custkey AS post_id, count(DISTINCT o_orderkey % 9) AS pages, sum(o_custkey % 5) AS comments, arg_max(o_orderstatus = 'O', o_orderkey) AS open FROM orders GROUP BY 1, 2)
SELECT source, count(*) AS posts, sum(pages)::BIGINT AS pages, sum(comments)::BIGINT AS comments, count(*) FILTER (open) AS open_posts FROM p GROUP BY 1""")
def comment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("post_id"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 9).alias("fingerprint"), (F.col("o_custkey") % 5).alias("comments"), (F.col("o_orderstatus") == "O").alias("has_more"))
    return coverage.collection_coverage(rows)


EVIDENCE = ("evidence_id", "url", "original_url", "original_publisher", "retracted", "status", "is_demo", *funnel.FACT_FIELDS)


def evidence_struct(**given):
    kinds = {"retracted": "boolean", "is_demo": "boolean"}
    return F.struct(*[given.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in (*EVIDENCE, *[g for g in given if g not in EVIDENCE])])


@query("""
SELECT page_id, (page_id % 5 <> 0 AND page_id % 7 <> 1 AND page_id % 4 <> 2)::BIGINT + (page_id % 3 <> 0)::BIGINT AS qualifying,
  page_id % 5 <> 0 AND page_id % 7 <> 1 AND page_id % 4 <> 2 AS linked FROM pages""")
def qualifying_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    one = evidence_struct(evidence_id=k, url=F.col("url"), retracted=k % 5 == 0, status=F.when(k % 7 == 1, "withdrawn"), quote=F.when(k % 4 != 2, "says so"))
    two = evidence_struct(evidence_id=k, url=F.col("url"), is_demo=k % 3 == 0, fact=F.lit("shown"))
    nowhere = evidence_struct(evidence_id=k, url=F.lit("no address"), fact=F.lit("shown"))
    rows = table(spark, sf_dir, "pages").select("page_id", one.alias("one"), F.array(one, two, nowhere).alias("all"))
    return rows.select("page_id", F.size(funnel.qualifying(F.col("all"))).cast("long").alias("qualifying"), funnel.linked_fact(F.col("one")).alias("linked"))


@query("""
SELECT page_id, (page_id % 2 = 0)::BIGINT AS backed, page_id % 2 = 0 AND page_id % 3 = 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0 AS paid FROM pages""")
def local_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    seen = F.array(evidence_struct(evidence_id=k, url=F.col("url"), fact=F.lit("shown")))
    signal = evidence_struct(
        evidence_id=F.when(k % 2 == 0, k).otherwise(-1), url=F.col("url"), type=F.when(k % 3 == 0, "Paid Invoice").otherwise("complaint"),
        region=F.when(k % 7 == 0, "US").otherwise(" cn"), market=F.lit("CN"), payer=F.when(k % 5 != 0, "a shop"),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", seen.alias("e"), F.array(signal).alias("s"))
    return rows.select("page_id", F.size(funnel.backed(F.col("s"), F.col("e"))).cast("long").alias("backed"), funnel.local_payment(F.col("s"), F.col("e"), F.lit("CN")).alias("paid"))


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN lower(p_type) <> 'economy' THEN 'form' END, CASE WHEN p_size % 2 = 0 THEN 'payer' END], lambda x: x IS NOT NULL), ',') AS hypotheses,
  array_to_string(list_filter([CASE WHEN p_size % 3 <> 0 THEN 'brand' END, CASE WHEN p_size % 5 = 0 THEN 'region' END], lambda x: x IS NOT NULL), ',') AS unverified FROM part""")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = funnel.hypotheses({"form": (F.col("p_type"), F.lit(" Economy!"))}, {"payer": F.when(F.col("p_size") % 2 == 1, F.col("p_brand"))})
    changed = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("region"), F.when(F.col("p_size") % 5 != 0, "CN"))
    checked = F.create_map(F.lit("brand"), F.when(F.col("p_size") % 3 == 0, F.upper("p_brand")), F.lit("region"), F.lit("cn"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ",").alias("hypotheses"), F.array_join(rules.unverified(changed, checked), ",").alias("unverified"))


@query("SELECT o_orderkey, o_orderdate::DATE + 30 > DATE '1998-01-01' AS future FROM orders")
def future_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    nested = F.array(F.struct(day.alias("published_at")), F.struct(F.date_add(day, 30).alias("published_at")), F.struct(F.lit(None).cast("date").alias("published_at")))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.future_nested(nested, F.lit(date(1998, 1, 1))).alias("future"))


@query("""
SELECT p_partkey, p_size % 4 <> 0 AND p_size % 5 <> 0 AND (p_size % 3 = 0 OR (p_size % 3 = 1 AND p_size % 7 <> 0)) AS meaningful FROM part""")
def meaningful_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, base = F.col("p_size"), F.concat(F.lit("by hand: "), "p_name")
    refs = F.array(F.struct(F.lit("e").alias("evidence_id"), F.lit("r").alias("revision_id"), F.when(n % 7 != 0, "words").alias("quote")))
    value = F.struct(
        base.alias("baseline"), F.when(n % 4 == 0, F.upper(base)).otherwise(F.concat(F.lit("sorts "), "p_type")).alias("capability"), F.concat(F.lit("saves "), "p_brand").alias("user_benefit"),
        F.when(n % 5 == 0, "AI").otherwise(F.concat(F.lit("faster by "), n.cast("string"))).alias("incremental_advantage"), F.element_at(F.array(F.lit("hypothesis"), F.lit("supported"), F.lit("other")), (n % 3 + 1).cast("int")).alias("status"),
        F.struct(F.lit("a").alias("reviewer"), F.lit("b").alias("reviewed_at"), F.lit("c").alias("rationale")).alias("review"), refs.alias("evidence_refs"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("v")).select("p_partkey", rules.meaningful_value(F.col("v")).alias("meaningful"))


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 3 = 0 THEN 'no wedge' END, CASE WHEN p_size % 5 = 0 THEN 'industry not allowed' END, CASE WHEN p_size % 2 = 0 THEN 'lead_id malformed' END], lambda x: x IS NOT NULL), ',') AS broken FROM part""")
def lead_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("target_user"), F.col("p_type").alias("problem_or_desire"), F.when(n % 3 == 0, " ").otherwise("one step").alias("wedge"),
        F.array(F.when(n % 5 == 0, "elsewhere").otherwise("retail")).alias("industry_ids"), F.when(n % 2 == 0, "LEAD-x").when(n % 7 == 0, "LEAD-0123456789AB").alias("lead_id"),
    )
    return rules.violations(rows, rules.lead_rules(["retail", "care"])).select("p_partkey", F.array_join("violations", ",").alias("broken"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'demo' WHEN doc_id % 13 = 0 THEN 'retracted' WHEN quality IS NULL THEN 'not_reviewed' WHEN quality = 0 THEN 'review_outdated' WHEN n_chars < 500 THEN 'no_public_evidence' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)""")
def withheld_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    row = {"is_demo": k % 11 == 0, "retracted": F.when(k % 13 == 0, F.lit(True)), "review_hash": F.col("quality").cast("string"), "content_hash": F.lit("1"), "public_refs": F.when(F.col("n_chars") >= 500, 1)}
    return labelled(spark, sf_dir).select("doc_id", publish.withheld_reason(row).alias("reason"))


@query("SELECT page_id, substr(html, 1, 200) AS title, CASE WHEN page_id % 2 = 1 THEN url END AS text FROM pages")
def compact_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("title"), F.col("html").alias("original_text"), F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.col("url")).alias("text"), F.lit("x").alias("raw_file"))
    return claims.compact(rows).drop("original_text")


@query("SELECT d.doc_id AS item_id, l.doc_id AS id, quality FROM documents d JOIN labels l ON l.doc_id IN (d.doc_id, 2 * d.doc_id + 1)")
def items_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    items = table(spark, sf_dir, "documents").select(k.alias("item_id"), F.array(F.struct(k.alias("id"), F.lit("r1").alias("revision_id")), F.struct((2 * k + 1).alias("id"), F.lit("r1").alias("revision_id"))).alias("refs"))
    evidence = table(spark, sf_dir, "labels").select(k.alias("id"), F.lit("r1").alias("revision_id"), "quality")
    return publish.with_evidence(items, evidence).select("item_id", "id", "quality")


@query("""
WITH k AS (SELECT 'L' || doc_id AS key, 1 AS rank, doc_id FROM labels UNION ALL SELECT 'A' || doc_id % 700, 1, doc_id FROM labels UNION ALL SELECT 'u' || doc_id % 900, 3, doc_id FROM labels),
r AS (SELECT doc_id AS ref_id, CASE doc_id % 3 WHEN 0 THEN 'L' || doc_id WHEN 1 THEN 'A' || doc_id % 700 ELSE 'u' || doc_id % 900 END AS key, CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 3 END AS rank FROM documents),
f AS (SELECT ref_id, count(DISTINCT k.doc_id) AS n, min(k.doc_id) AS d FROM r LEFT JOIN k USING (key, rank) GROUP BY ref_id)
SELECT ref_id, CASE WHEN n = 1 THEN 'L' || d END AS match_evidence_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS problem FROM f""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    records = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("L"), k).alias("evidence_id"), F.lit("r1").alias("revision_id"), none.alias("object_key"), F.concat(F.lit("u"), k % 900).alias("url"), F.lit("text").alias("original_text"), F.array(F.concat(F.lit("A"), k % 700)).alias("aliases")
    )
    named = F.when(k % 3 == 0, F.concat(F.lit("L"), k)).when(k % 3 == 1, F.concat(F.lit("A"), k % 700))
    refs = table(spark, sf_dir, "documents").select(k.alias("ref_id"), named.alias("evidence_id"), none.alias("revision_id"), F.when(k % 3 == 2, F.concat(F.lit("u"), k % 900)).alias("url"), none.alias("quote"))
    return library.resolved(refs, records).select("ref_id", "match_evidence_id", "problem")


@query(f"""
WITH s AS ({STRONG}), o AS (SELECT DISTINCT s.url FROM s WHERE page_id % 3 = 0)
SELECT url AS key, url IN (SELECT url FROM o) AS verified FROM s GROUP BY url""")
def verified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = discovery.merged_candidates(pages.select("url", F.lit("p").alias("provider"), F.lit("q").alias("query")))
    opened = pages.select(
        F.col("page_id").alias("evidence_id"), F.lit("r1").alias("revision_id"), "url", F.col("html").alias("original_text"), F.substring("html", 1, 20).alias("supporting_quote"),
        F.when(F.col("page_id") % 3 == 0, "opened_page").otherwise("search").alias("method"), F.lit(None).cast("boolean").alias("retracted"),
    )
    return discovery.verified_candidates(found, opened).select("key", "verified")


@query("""
SELECT a.c_custkey AS id, b.c_custkey AS fallback_id FROM customer a JOIN customer b ON a.c_custkey % 2 = 0 AND b.c_custkey % 2 = 1 AND a.c_custkey // 8 = b.c_custkey // 8 AND a.c_nationkey % 3 = b.c_nationkey % 3 AND a.c_mktsegment <> b.c_mktsegment""")
def fallback_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("source"), (F.col("c_nationkey") % 3).alias("query_group"), F.lit("s").alias("query_scope"), F.floor(k / 8).alias("keyword"))
    return discovery.fallbacks(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).select("id", "fallback_id")


@query("""
SELECT c_custkey AS evidence_id, (SELECT string_agg(DISTINCT 'T' || o_orderkey % 4, ',' ORDER BY 'T' || o_orderkey % 4) FROM orders WHERE o_custkey = c_custkey) AS families FROM customer""")
def task_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "orders").select(F.concat(F.lit("T"), F.col("o_orderkey") % 4).alias("task_family_id"), F.array(F.struct(F.col("o_custkey").alias("evidence_id"))).alias("evidence_refs"))
    found = needs.with_families(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("evidence_id")), told)
    return found.select("evidence_id", F.array_join("task_family_ids", ",").alias("families"))


STATES = """
e AS (SELECT *, user_id || '/' || ts::DATE AS id FROM events),
s AS (SELECT id, count(DISTINCT event_type) AS n, arg_max(event_type, event_id) AS last, arg_max(value < 2, event_id) AS lastgone, bool_or(value < 2) AS anygone FROM e GROUP BY id),
c AS (SELECT id AS evidence_id, last AS current_revision_id, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'current' END AS status, CASE WHEN n > 1 THEN anygone ELSE lastgone END AS retracted FROM s)"""


def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a piece of evidence, so some have a single revision and some several."""
    rows = table(spark, sf_dir, "events").withColumn("evidence_id", F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    return derivations.current_state(rows.select("evidence_id", "event_id", F.col("event_type").alias("revision_id"), (F.col("value") < 2).alias("retracted")), "evidence_id", "event_id")


@query(f"WITH {STATES} SELECT * FROM c")
def current_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_states(spark, sf_dir)


@query(f"""
WITH {STATES},
r AS (SELECT user_id * 10 + day(ts) // 4 AS lead_id, user_id || '/' || (ts::DATE + 1) AS evidence_id, min(event_type) AS revision_id FROM events GROUP BY ALL),
i AS (
  SELECT lead_id, CASE WHEN c.evidence_id IS NULL THEN 'missing' WHEN retracted THEN 'withdrawn' WHEN status = 'ambiguous' THEN 'unsure' WHEN current_revision_id IS DISTINCT FROM revision_id THEN 'changed' END AS issue
  FROM r LEFT JOIN c USING (evidence_id))
SELECT lead_id, count(issue) AS issues, CASE WHEN count(issue) > 0 AND lead_id % 4 <> 0 THEN 'needs_review' WHEN lead_id % 4 = 0 THEN 'archived' ELSE 'observed_need' END AS research_status FROM i GROUP BY lead_id""")
def lead_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lead cites the day after each of a user's days, which may have no evidence."""
    day = F.to_date("ts")
    lead = (F.col("user_id") * 10 + F.floor(F.dayofmonth(day) / 4)).alias("lead_id")
    cited = table(spark, sf_dir, "events").groupBy(lead, F.concat_ws("/", F.col("user_id").cast("string"), F.date_add(day, 1).cast("string")).alias("evidence_id")).agg(F.min("event_type").alias("revision_id"))
    leads = cited.select("lead_id", F.when(F.col("lead_id") % 4 == 0, "archived").otherwise("observed_need").alias("research_status")).distinct()
    found = rules.lead_view(leads, cited, evidence_states(spark, sf_dir))
    return found.select("lead_id", F.coalesce(F.size("reference_issues"), F.lit(0)).cast("long").alias("issues"), "research_status")


@query("SELECT sha256(text) AS digest, count(*) AS count FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.duplicate_ids(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query("""
WITH RECURSIVE e AS (SELECT source, doc_id, n_chars AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (
  SELECT source, doc_id, i, x <= 18000 AS packed, (x <= 18000)::BIGINT AS n, CASE WHEN x <= 18000 THEN x ELSE 0 END AS used FROM e WHERE i = 1 UNION ALL
  SELECT e.source, e.doc_id, e.i, n < 30 AND used + x <= 18000, n + (n < 30 AND used + x <= 18000)::BIGINT, used + CASE WHEN n < 30 AND used + x <= 18000 THEN x ELSE 0 END FROM f JOIN e ON e.source = f.source AND e.i = f.i + 1)
SELECT doc_id, packed FROM f""")
def evidence_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return claims.budget_packets(docs, ["source"], ["doc_id"], "n_chars", 30, 18000).select("doc_id", "packed")


@query("""
WITH RECURSIVE p AS (SELECT p_brand, (max(p_size) / 10.0)::DECIMAL(24,12) AS cost FROM part WHERE p_brand NOT LIKE '%3' GROUP BY p_brand),
e AS (SELECT p_partkey, cost AS x, row_number() OVER (ORDER BY p_partkey) AS i FROM part JOIN p USING (p_brand)),
f AS (
  SELECT p_partkey, i, x <= 50 AS ok, (x <= 50)::BIGINT AS n, CASE WHEN x <= 50 THEN x ELSE 0 END::DECIMAL(24,12) AS used FROM e WHERE i = 1 UNION ALL
  SELECT e.p_partkey, e.i, used + x <= 50, n + (used + x <= 50)::BIGINT, (used + CASE WHEN used + x <= 50 THEN x ELSE 0 END)::DECIMAL(24,12) FROM f JOIN e ON e.i = f.i + 1)
SELECT part.p_partkey AS id, CASE WHEN f.i IS NULL THEN 'live_price_unavailable' WHEN NOT ok THEN 'budget_limit' WHEN n > 9 THEN 'batch_limit' ELSE 'selected' END AS decision FROM part LEFT JOIN f USING (p_partkey)""")
def affordable_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    prices = part.where("p_brand not like '%3'").groupBy(F.col("p_brand").alias("endpoint")).agg((F.max("p_size") / F.lit(Decimal(10))).cast(ledger.MONEY).alias("cost"))
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"), F.col("p_brand").alias("endpoint"))
    return discovery.affordable(rows, prices, Decimal(50), 9).select("id", "decision")


@query("""
SELECT doc_id AS evidence_id, coalesce(quality = 1, false) AS in_packet,
  CASE WHEN doc_id % 17 = 0 THEN 'derivation_review' WHEN quality IS NULL THEN 'semantic_review' WHEN quality <> 1 THEN 'not_in_packet' END AS review_reason FROM documents LEFT JOIN labels USING (doc_id)""")
def evidence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select(F.col("doc_id").alias("evidence_id"), F.lit("r1").alias("revision_id"), F.when(F.col("doc_id") % 17 == 0, "needs_review").otherwise("active").alias("derivation_status"), F.when(F.col("quality").isNull(), "not_reviewed").otherwise("reviewed").alias("semantic_status"))
    packet = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("evidence_id"), F.lit("r1").alias("revision_id"))
    return claims.evidence_index(rows, packet).select("evidence_id", "in_packet", "review_reason")


@query(r"SELECT doc_id, regexp_matches(text, '\p{L}') AND NOT regexp_matches(text, '[^\P{L}\p{Latin}]') AS english FROM documents")
def latin_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.only_latin(F.col("text")).alias("english"))


@query(f"""
SELECT c_custkey, 'see {text.PATH_GONE} and {text.CONTACT_GONE} or {text.CONTACT_GONE}; at https://h.org/' || c_custkey || ' not {text.LINK_GONE} nor {text.LINK_GONE} nor {text.LINK_GONE} (' || c_name || ')' AS told,
  'see {text.PATH_GONE}' AS short FROM customer""")
def redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    told = F.concat(F.lit("see /home/u"), k, F.lit("/x and a.b"), k, F.lit("@mail.org or +86 13812345678; at https://h.org/"), k, F.lit(" not http://shop.local:80/x nor http://box nor http://10.0.0."), k, F.lit("/y?z ("), "c_name", F.lit(")"))
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select("c_custkey", text.redacted(told).alias("told"), text.redacted(told, 4 + len(text.PATH_GONE)).alias("short"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'unknown source' END, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'other endpoint' END, CASE WHEN o_orderkey % 11 = 0 THEN 'method' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'secret in params' END], lambda x: x IS NOT NULL), ',') AS broken FROM orders""")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k, F.when(k % 5 == 0, "other").otherwise("reddit").alias("source"), F.when(k % 7 == 0, "/else").otherwise("/search").alias("endpoint"), F.when(k % 11 == 0, "PUT").otherwise("GET").alias("method"),
        F.create_map(F.lit("q"), F.lit("x"), F.when(k % 3 == 0, "Access_Token").otherwise("page"), F.lit("1")).alias("params"),
    )
    return rules.violations(rows, rules.request_rules({"reddit": "/search", "zhihu": "/find"})).select("o_orderkey", F.array_join("violations", ",").alias("broken"))


@query("""
SELECT o_orderkey, sha256('s|/e|GET|' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'page=' || o_orderkey || '&' END || 'q=' || o_orderpriority) AS request,
  sha256('{"a":"' || o_orderstatus || '","b":' || o_orderkey || '}') AS canonical, sha256('{"k":"a"}:"' || o_orderstatus || '",{"k":"b"}:' || o_orderkey) AS content,
  CASE WHEN o_orderkey % 4 = 0 THEN 'https://h.org/' || o_orderkey ELSE 'object:src:' || CASE WHEN o_orderkey % 2 = 0 THEN 'comment' ELSE 'post' END || ':' || o_orderkey END AS object FROM orders""")
def request_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    params = F.create_map(F.lit("q"), F.col("o_orderpriority"), F.lit("page"), F.when(k % 3 != 0, k.cast("string")))
    body = F.format_string('{ "b": %d, "a": "%s", "run_id": "r%d"}', k, "o_orderstatus", k)
    plain = F.format_string('{ "b": %d, "a": "%s"}', k, "o_orderstatus")
    key = ids.object_key(F.lit("SRC"), F.when(k % 2 == 0, "reply"), F.when(k % 4 != 0, k.cast("string")), F.concat(F.lit("http://www.h.org/"), k, F.lit("/?utm_source=x")), F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", ids.request_fingerprint(F.lit("s"), F.lit("/e"), F.lit("get"), params).alias("request"), ids.canonical_sha256(plain).alias("canonical"), ids.content_sha256(body, ["run_id"]).alias("content"), key.alias("object")
    )


@query("""
SELECT p_partkey, p_name || ' ' || p_type || ' alternatives' AS query, replace(p_brand, '#', '\\|') || ' x' AS cell FROM part""")
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = discovery.balanced_query([F.col("p_name"), F.concat(F.lit(" "), "p_type"), F.col("p_name")], F.lit("alternatives"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("query"), text.markdown_cell(F.concat(F.replace("p_brand", F.lit("#"), F.lit("|")), F.lit("\n x"))).alias("cell"))


@query("""
SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE END AS utc_day FROM orders""")
def stated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.to_date("o_orderdate")
    ends = F.datediff(at, F.lit(date(1970, 1, 1))).cast("long")
    said = (
        F.when(k % 5 == 0, (ends * 86400).cast("string")).when(k % 5 == 1, (ends * 86400000 + 5).cast("string")).when(k % 5 == 2, F.date_format(at, "yyyyMMdd"))
        .when(k % 5 == 3, F.concat(F.date_format(at, "EEE, d MMM yyyy"), F.lit(" 12:00:00 GMT"))).otherwise(F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T03:00:00+02:00")))
    )
    naive = F.when(k % 5 < 4, F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(" 23:59"))).otherwise("yesterday")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(times.any_date(said)).alias("day"), times.utc_day(naive).alias("utc_day"))


@query("""
SELECT s AS source, n_name || ' ' || w AS search_query, n_name AS product, l AS language
FROM nation, (VALUES ('twitter', 'review', 'en'), ('twitter', 'pricing', 'en'), ('douyin', '体验', 'zh'), ('douyin', '价格', 'zh')) v(s, w, l)""")
def product_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("use").alias("task"), F.array("n_name").alias("aliases"), F.array(F.lit("twitter"), F.lit("douyin")).alias("sources"))
    angles = spark.createDataFrame([("use", "体验", "review", "user"), ("price", "价格", "pricing", "official")], "angle string, zh string, en string, role string")
    return catalog.product_intents(products, angles).select("source", "search_query", "product", "language")


@query("""
SELECT user_id AS item_id, CASE WHEN DATE '2024-02-26' > day + 30 THEN 'overdue' WHEN DATE '2024-02-26' >= day + 23 THEN 'due' END AS reason, day + 30 AS due_on
FROM (SELECT user_id, max(ts)::DATE AS day FROM events GROUP BY user_id HAVING max(ts)::DATE + 23 <= DATE '2024-02-26') WHERE user_id % 3 <> 0""")
def refresh_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.to_date(F.max("ts")).alias("source_day")).withColumns({"semantic_day": F.col("source_day"), "revision_id": F.lit("r1")})
    items = days.select(F.col("id").alias("item_id"), F.array(F.struct("id", "revision_id")).alias("refs"), F.when(F.col("id") % 3 == 0, "withdrawn").otherwise("published").alias("publication_status"))
    return publish.refresh_tasks(publish.item_freshness(items, days, date(2024, 2, 26))).select("item_id", "reason", "due_on")


@query(f"""
WITH d AS (SELECT ([{quoted(catalog.PAID + catalog.COMMUNITY + catalog.MANUAL)}])[1 + doc_id % {len(catalog.PAID + catalog.COMMUNITY + catalog.MANUAL)}] AS source, lang FROM documents)
SELECT source, lang, count(*) AS n FROM d WHERE lang IS NOT NULL AND source NOT IN ({quoted(catalog.CHINESE)}) AND (source NOT IN ({quoted(catalog.COMMUNITY)}) OR lang = 'en') GROUP BY source, lang""")
def english_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt over the sources, and how many of them are of a language that their source is asked in."""
    names = catalog.PAID + catalog.COMMUNITY + catalog.MANUAL
    docs = table(spark, sf_dir, "documents").select(F.get(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % len(names)).cast("int")).alias("source"), "lang")
    asked = catalog.routed(docs.join(catalog.registry(spark), "source"), F.concat("lang", F.lit("-GB")))
    return asked.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-15 23:59:59.999999' OR event_id % 9 = 0 GROUP BY event_type")
def quarantined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.when(F.col("event_id") % 9 == 0, moment("2030-01-01 00:00:00"))
    rows = table(spark, sf_dir, "events").withColumn("published_at", far)
    return library.future_events(rows, moment("2024-01-15 23:59:59.999999"), ["ts", "published_at"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT n_name AS id, n_regionkey AS region, true AS single FROM nation")
def public_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "bundle")
    readers.public_bundle(table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("region"), F.lit("private").alias("note")), path, ["id", "region"])
    index = spark.read.schema("id string, region long, note string").json(f"{path}/index").where("note is null").drop("note")
    single = spark.read.option("basePath", f"{path}/items").json(f"{path}/items").groupBy(F.col("id").alias("of")).count()
    return index.join(single, index.id == single.of).select("id", "region", (F.col("count") == 1).alias("single"))


LABELLED = "SELECT lang, quality, CASE WHEN n_chars < 2000 THEN 'in_window' ELSE 'out_of_window' END AS w, toxic FROM documents LEFT JOIN labels USING (doc_id)"


@query(f"""
SELECT lang, count(*) FILTER (quality = 1) AS users, count(*) FILTER (quality = 0) AS suppliers, count(*) FILTER (toxic = 0) AS direct, count(*) FILTER (toxic = 1) AS unrelated, count(*) FILTER (quality = 1) AS tasks,
  count(*) FILTER (quality = 1 AND toxic = 0 AND w = 'in_window') AS recent, count(*) FILTER (quality = 1 AND toxic = 0 AND w = 'out_of_window') AS old FROM ({LABELLED}) GROUP BY lang""")
def label_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.label_statistics(labelled(spark, sf_dir), [["lang"]])
    of = lambda c, k, name: F.coalesce(F.col(c)[k], F.lit(0)).cast("long").alias(name)
    window = "direct_user_publication_window_counts"
    return found.select("lang", of("actor_counts", "user", "users"), of("actor_counts", "supplier", "suppliers"), of("query_match_counts", "direct", "direct"), of("query_match_counts", "unrelated", "unrelated"), of("signal_counts", "task", "tasks"), of(window, "in_window", "recent"), of(window, "out_of_window", "old"))


@query(f"""
WITH c AS (SELECT p_brand AS family, {TIER} AS t FROM part), q AS (SELECT * FROM c WHERE t IS NOT NULL),
n AS (SELECT count(*) AS qualified, count(DISTINCT family) AS families, count(DISTINCT family) FILTER (t IN ('A', 'B')) AS validated, count(DISTINCT family) FILTER (t = 'R') AS regional,
  least(count(*) FILTER (t = 'A'), 5) + least(count(*) FILTER (t = 'B'), 40) + least(count(*) FILTER (t = 'R'), 80) AS shown FROM q),
e AS (SELECT count(DISTINCT d.source || d.lang) AS known, count(DISTINCT d.source || d.lang) FILTER (l.quality = 1) AS used FROM documents d LEFT JOIN labels l USING (doc_id)),
x AS (SELECT sum(o_totalprice::DECIMAL(38,12)) AS cost, count(*) AS requests FROM orders)
SELECT qualified AS qualified_conclusion_count, families AS qualified_family_count, validated AS validated_opportunity_family_count, regional AS regional_hypothesis_family_count, shown AS suggested_report_display_count,
  qualified - shown AS additional_conclusion_count, known AS normalized_evidence_count, used AS used_normalized_evidence_count, round(100.0 * used / known, 2)::DOUBLE AS evidence_utilization_percent, requests AS paid_request_count,
  round((cost::DOUBLE / qualified), 2) AS per_conclusion, round((cost::DOUBLE / validated), 2) AS per_family FROM n, e, x""")
def run_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).drop("family").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("family")), "p_partkey")
    qualified = rows.where("evidence_tier is not null").select("family", F.col("evidence_tier").alias("tier"))
    material = labelled(spark, sf_dir).select(F.concat("source", "lang").alias("marker"), "quality")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("content_hash"), F.lit("ok").alias("status"), F.col("o_totalprice").alias("cost_usd"))
    found = ledger.digest(qualified, material, material.where("quality = 1"), runs)
    counts = ("qualified_conclusion_count", "qualified_family_count", "validated_opportunity_family_count", "regional_hypothesis_family_count", "suggested_report_display_count", "additional_conclusion_count", "normalized_evidence_count", "used_normalized_evidence_count")
    return found.select(*[F.col(c).cast("long").alias(c) for c in counts], "evidence_utilization_percent", "paid_request_count", F.round("cost_per_qualified_conclusion_usd", 2).alias("per_conclusion"), F.round("cost_per_validated_family_usd", 2).alias("per_family"))


@query("""
SELECT o_orderpriority AS source, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS reviewed, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS leased,
  count(*) FILTER (o_orderstatus <> 'F') AS unreviewed_count FROM orders GROUP BY 1""")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "reviewed").when(F.col("o_orderstatus") == "O", "pending").otherwise("leased")
    found = coverage.queue_summary(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), status.alias("status")), ["source"])
    return found.select("source", "total", "reviewed", "pending", "leased", "unreviewed_count")


@query("""
SELECT o_orderpriority AS source, count(*) AS requests, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS error, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS skipped,
  count(*) FILTER (o_orderkey % 3 = 0) AS reused, sum(1 + o_orderkey % 2)::BIGINT AS attempts, sum(o_totalprice::DECIMAL(38,12))::DOUBLE AS cost FROM orders GROUP BY 1""")
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "error").otherwise("skipped")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), status.alias("status"), (F.col("o_orderkey") % 3 == 0).alias("reused"), (1 + F.col("o_orderkey") % 2).alias("attempts"), F.col("o_totalprice").cast(ledger.MONEY).alias("cost_usd"))
    found = coverage.execution_summary(rows)
    return found.select("source", "requests", "ok", "error", "skipped", "reused", "attempts", F.col("estimated_attempted_cost_usd").cast("double").alias("cost"))


@query("""
WITH i AS (SELECT source, doc_id % 4 = 0 AS c, n_chars < 2000 AS r, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS dup FROM documents)
SELECT (SELECT count(*) FROM orders) AS requests, (SELECT sum(o_orderkey % 5)::BIGINT FROM orders) AS fetched, count(*) FILTER (r AND NOT c AND NOT dup) AS valid_items, count(*) FILTER (r AND c AND NOT dup) AS valid_comments,
  count(*) FILTER (dup) AS duplicates_removed, count(*) FILTER (NOT r AND NOT dup) AS out_of_window, count(DISTINCT source) FILTER (NOT dup) AS sources FROM i""")
def community_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("fetched"), *[F.lit(1).alias(c) for c in ("parsed", "relevant", "retained")])
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"), (F.col("n_chars") < 2000).alias("eligible"))
    first = quality.first_of_each(docs, [F.col("digest")], F.col("doc_id")).select("doc_id", F.lit(False).alias("duplicate"))
    items = docs.join(first, "doc_id", "left").select("source", F.when(F.col("doc_id") % 4 == 0, "comment").otherwise("evidence").alias("kind"), "eligible", F.when(F.col("eligible"), "in_window").otherwise("out_of_window").alias("window_status"), F.lit("unknown").alias("relevance_status"), F.coalesce("duplicate", F.lit(True)).alias("duplicate"))
    found = coverage.community_statistics(requests, items)
    return found.select("requests", "fetched", "valid_items", "valid_comments", "duplicates_removed", F.coalesce(F.col("window_status")["out_of_window"], F.lit(0)).cast("long").alias("out_of_window"), F.size("by_source").cast("long").alias("sources"))


#: A contract of the kind that a public catalogue has.
CONTRACT = {
    "type": "object", "required": ["id", "kind"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^P[0-9]+$"}, "kind": {"enum": ["ECONOMY", "STANDARD", "PROMO"]}, "size": {"$ref": "#/$defs/size"}, "version": {"const": "1.0"},
        "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string", "minLength": 2}}, "day": {"type": ["string", "null"], "format": "date"}, "link": {"format": "uri"},
        "price": {"oneOf": [{"type": "number", "minimum": 0}, {"type": "string", "maxLength": 3}]},
    },
    "$defs": {"size": {"type": "integer", "minimum": 3, "maximum": 40}},
}


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 13 = 0 THEN '$.id: pattern' END, CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN '$.kind: not in enum' END,
  CASE WHEN p_size < 3 OR p_size > 40 THEN '$.size: number out of range' END, CASE WHEN p_size % 11 = 0 THEN '$.version: not the constant' END, CASE WHEN p_size % 5 = 0 THEN '$.tags: repeated items' END,
  CASE WHEN p_size % 7 = 0 THEN '$.tags[1]: length of text' END, CASE WHEN p_size % 4 = 0 THEN '$.day: format' END, CASE WHEN p_size % 6 = 0 THEN '$.link: format' END,
  CASE WHEN p_size % 9 = 0 THEN '$.price: fits oneOf wrongly' END, CASE WHEN p_size % 8 = 0 THEN '$.zone: not allowed' END], lambda x: x IS NOT NULL), '; ') AS problems FROM part""")
def schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    tag = F.when(n % 5 == 0, "ab").when(n % 7 == 0, "c").otherwise("cd")
    tag = F.when((n % 5 == 0) & (n % 7 == 0), "c").otherwise(tag)
    body = F.struct(
        F.concat(F.when(n % 13 == 0, "Q").otherwise("P"), "p_partkey").alias("id"), F.col("p_type").alias("kind"), n.alias("size"), F.when(n % 11 == 0, "2").otherwise("1.0").alias("version"),
        F.when((n % 5 == 0) & (n % 7 == 0), F.array(F.lit("ab"), tag, F.lit("ab"))).otherwise(F.array(F.lit("ab"), tag)).alias("tags"),
        F.when(n % 4 == 0, "2026-02-30").otherwise("2026-07-14").alias("day"), F.when(n % 6 == 0, "https://u@h.org/").otherwise("https://h.org/a").alias("link"), F.when(n % 9 == 0, "long text").otherwise("abc").alias("price"), F.when(n % 8 == 0, "x").alias("zone"),
    )
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")).select("p_partkey", F.to_json(body).alias("d")).select("p_partkey", F.array_join(publish.schema_problems(F.col("d"), CONTRACT), "; ").alias("problems"))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'no ranking_query' END, CASE WHEN o_orderkey % 3 = 0 THEN 'id malformed' END, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown source' END,
  CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 THEN 'not in English' END, CASE WHEN o_orderkey % 11 = 0 THEN 'followup incomplete' END], lambda x: x IS NOT NULL), ',') AS broken FROM orders""")
def intent_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ref = F.array(F.struct(F.lit("e").alias("evidence_id"), F.lit("r").alias("revision_id")))
    rows = table(spark, sf_dir, "orders").select(
        k, F.when(k % 3 == 0, "Bad id-").otherwise("plan.1").alias("id"), F.lit("why").alias("question"), F.when(k % 5 == 0, "体验").otherwise("reviews").alias("search_query"), F.when(k % 2 == 1, "q").alias("ranking_query"),
        F.when(k % 7 == 0, "elsewhere").otherwise("github").alias("source"), F.lit("user_feedback").alias("evidence_type"), F.lit("en-US").alias("language"), F.array().cast("array<string>").alias("candidate_gaps"),
        F.when(k % 11 < 2, "TASK-1").alias("task_family_id"), F.lit("alternative").alias("purpose"), F.lit("key").alias("query_key"), F.array(F.lit("check")).alias("required_checks"), F.array(F.lit("OBS-1")).alias("source_observation_ids"),
        F.when(k % 11 != 0, ref).alias("source_evidence_refs"),
    )
    return rules.violations(rows, rules.intent_rules(["github", "reddit"], ["user_feedback"])).select("o_orderkey", F.array_join("violations", ",").alias("broken"))


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'no baseline' END, CASE WHEN p_size % 3 = 0 THEN 'planned_sample_size' END, CASE WHEN p_size % 5 = 0 THEN 'metric ids' END, CASE WHEN p_size % 7 = 0 AND p_size % 11 <> 0 THEN 'measurements' END], lambda x: x IS NOT NULL), ',') AS broken FROM part""")
def comparison_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    metric = lambda name: F.struct(name.alias("id"), F.lit("s").alias("unit"), F.lit("< 5").alias("acceptance_rule"))
    measured = F.struct(F.when(n % 7 == 0, "m9").otherwise("m1").alias("metric_id"), F.lit(1.0).alias("baseline_value"), F.lit(2.0).alias("ai_value"), F.lit(3).alias("sample_size"), F.lit("e").alias("evidence_ref"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(n % 2 == 1, "by hand").alias("baseline"), *[F.lit("said").alias(c) for c in ("ai_variant", "task_selection", "evaluation_method")], F.when(n % 3 == 0, 0).otherwise(9).alias("planned_sample_size"),
        F.array(metric(F.lit("m1")), metric(F.when(n % 5 == 0, "m1").otherwise("m2"))).alias("metrics"), F.when(n % 11 != 0, F.array(measured)).alias("measurements"),
    )
    return rules.violations(rows, rules.comparison_rules()).select("p_partkey", F.array_join("violations", ",").alias("broken"))


@query("""
SELECT 'T' || c_custkey AS task_family_id, 'workflow_artifact' AS purpose, 'task ' || c_custkey || ' a rush' AS query FROM customer UNION ALL
SELECT 'T' || c_custkey, 'alternative', 'task ' || c_custkey || ' ' || c_mktsegment || ' alternatives services' FROM customer UNION ALL
SELECT 'T' || c_custkey, 'non_adoption', 'task ' || c_custkey || ' a rush tried stopped using why' FROM customer""")
def followup_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, k = F.lit(None).cast("string"), F.col("c_custkey").cast("string")
    told = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T"), k).alias("task_family_id"), F.concat(F.lit("OBS-"), k).alias("observation_id"), F.concat(F.lit("task "), k).alias("task"), F.col("c_mktsegment").alias("need"),
        none.alias("artifact"), F.lit(" a  rush").alias("trigger"), none.alias("current_workaround"), none.alias("desired_outcome"), F.lit(None).cast("array<string>").alias("query_terms"), F.lit("en").alias("language"),
    )
    worse = told.withColumns({"observation_id": F.lit("OBS-0"), "trigger": none})  # says less, so it doesn't speak for the family
    return discovery.followups(told.union(worse)).select("task_family_id", "purpose", "query")


@query("""
WITH p AS (
  SELECT n_name, n_regionkey, ((row_number() OVER (ORDER BY n_name) - 1 - (date_diff('day', DATE '0001-01-01', DATE '2024-01-15') + 1) % (SELECT count(*) FROM nation)) % (SELECT count(*) FROM nation) + (SELECT count(*) FROM nation)) % (SELECT count(*) FROM nation) AS place FROM nation),
f AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY place) = 1 AS leads FROM p)
SELECT n_name AS task_family_id FROM f ORDER BY leads DESC, place LIMIT 8""")
def broad_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight families, as the operator is asked for: the first of each region in the day's order, then the others."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("task_family_id"), F.array(F.col("n_regionkey").cast("string")).alias("industry_ids"), F.array(F.lit("en")).alias("languages"))
    return spark.createDataFrame([(f,) for f in discovery.broad_families(rows, date(2024, 1, 15))], "task_family_id string")


@query("""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT source, n + 1 AS n, 'stated' AS side FROM c WHERE source LIKE '%3' UNION ALL SELECT source, n, 'computed' FROM c WHERE source LIKE '%3'""")
def report_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    computed = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    stated = computed.select("source", F.when(F.col("source").endswith("3"), F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return publish.report_differences(stated, computed)
