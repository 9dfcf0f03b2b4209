"""Registered queries of operators that no other query reaches, over real columns of the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import sql, times
from lodestone.functions.shared import new_path
from lodestone.functions.text import STOP_WORDS
from lodestone.operators import claims, ledger, needs, publish, quality, rules, state
from lodestone.plans.operator_queries import STRONG
from lodestone.plans.queries import WEAK, query, quoted, table
from lodestone.sources import comments, readers, recorded
from lodestone.streaming import ingest



@query("SELECT doc_id, lang, n_chars, source AS run_id, CASE WHEN doc_id % 3 = 0 THEN '2024-01-30' ELSE '2024-01-31' END AS as_of FROM documents")
def enveloped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines of envelopes, twenty of a source each, and read again as records; a line that is no JSON has none."""
    path, own = new_path(spark, "lines"), F.when(F.col("doc_id") % 3 == 0, "2024-01-30")
    record = F.struct("doc_id", "lang", "n_chars", own.alias("as_of"))
    lots = table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("doc_id") / 20).alias("lot")).agg(F.collect_list(record).alias("evidence"))  # twenty at most
    lines = lots.select(F.to_json(F.struct(F.col("source").alias("run_id"), F.lit("2024-01-31").alias("as_of"), "evidence")).alias("value"))
    lines.union(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    read = readers.lines(spark, path)
    found = readers.records(read.where("problem is null").select("file", "line_no", "text"))
    kept = F.from_json("record", "doc_id long, lang string, n_chars long")
    return found.where("not coalesce(run_conflict, false)").select(kept.alias("r"), "run_id", "as_of").select("r.*", "run_id", "as_of")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'R' THEN 10 * l_quantity::BIGINT END AS tenths,
  (l_quantity::BIGINT * 78125 // 10 + CASE WHEN l_quantity::BIGINT * 78125 % 10 > 5 OR l_quantity::BIGINT * 78125 % 10 = 5 AND (l_quantity::BIGINT * 78125 // 10) % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS micros
FROM lineitem""")
def money_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as amounts of text, negative where returned; and a 128th of them to six places, halves to even."""
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("-"), "l_quantity")).otherwise(F.col("l_quantity").cast("string"))
    part = ledger.rounded(F.col("l_quantity").cast("decimal(20,7)") * F.lit("0.0078125").cast("decimal(8,7)"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (ledger.money(text) * 10).cast("long").alias("tenths"), (part * 1_000_000).cast("long").alias("micros")
    )


@query("""
SELECT role, arg_min(conv_id, (conv_id, turn)) AS conv_id, arg_min(turn, (conv_id, turn)) AS turn, count(*) AS copies, string_agg(DISTINCT conv_id::VARCHAR, ',' ORDER BY conv_id::VARCHAR) AS chats
FROM conversations GROUP BY role, coalesce(text, '')""")
def evidence_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that say the same in the same role as one, the first, with the chats that say it."""
    rows = table(spark, sf_dir, "conversations").withColumn("chat", F.col("conv_id").cast("string"))
    same = quality.evidence_identity(F.col("role"), F.lit(" "), F.lit(None).cast("string"), F.col("text"))
    found = quality.first_of_each(rows, [same], F.struct("conv_id", "turn"), {"chat": "chats"})
    return found.select("role", "conv_id", "turn", "copies", F.array_join("chats", ",").alias("chats"))


@query(f"""
WITH k AS (SELECT page_id, w.url AS canonical, length(html) AS size FROM ({WEAK}) w JOIN pages USING (page_id))
SELECT canonical, min(page_id)::VARCHAR AS id, arg_max(size % 100, (size, -page_id))::VARCHAR AS quality, string_agg(DISTINCT (page_id % 5)::VARCHAR, ',' ORDER BY (page_id % 5)::VARCHAR) AS query_ids, count(*) AS copies FROM k GROUP BY canonical""")
def best_ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one address as one: the first, with what the longest says of quality."""
    size = F.length("html")
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("id"), "url", F.lit("").alias("original_text"), F.lit("").alias("author"), size.alias("size"), (size % 100).cast("string").alias("quality"), (F.col("page_id") % 5).cast("string").alias("query_id"))
    found = quality.best_rank_merge(rows, "url", F.col("size"), F.col("page_id"))
    return found.select("canonical", "first.id", "quality", F.array_join("query_ids", ",").alias("query_ids"), "copies")


KINDS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'complaint' WHEN '2-HIGH' THEN 'positive_behavior' WHEN '3-MEDIUM' THEN 'payment' ELSE 'official_pricing' END"
SEEN = f"""SELECT DISTINCT c_mktsegment AS person, o_orderpriority AS task, o_orderstatus AS need, c_nationkey AS place, o_custkey AS ref, {KINDS} AS kind, year(o_orderdate) = 1995 AS demo FROM orders JOIN customer ON c_custkey = o_custkey"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("target_user"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("need"), F.array(F.concat(F.lit("nation "), "c_nationkey")).alias("constraints"),
        F.array(F.struct(F.col("o_custkey").cast("string").alias("evidence_id"), F.lit("r1").alias("revision_id"), F.lit("q").alias("quote"))).alias("evidence_refs"), F.expr(KINDS).alias("feedback_type"),
        F.lit(None).cast("string").alias("behavior_type"), (F.year("o_orderdate") == 1995).alias("is_demo"), F.array(F.year("o_orderdate").cast("string")).alias("products"), F.array("o_orderstatus").alias("industry_ids"), F.array(F.month("o_orderdate").cast("string")).alias("query_terms"),
    )
    return needs.identified(rows)


@query(f"""
WITH s AS ({SEEN.replace('SELECT DISTINCT', 'SELECT')}), d AS (SELECT *, kind IN ('complaint', 'positive_behavior', 'payment') AND NOT demo AS direct FROM s)
SELECT count(*) AS observation_count, count(DISTINCT (person, task, need, place)) FILTER (direct) AS demand_cluster_count, count(DISTINCT (person, task, place)) FILTER (direct) AS task_family_count,
  count(*) FILTER (direct AND kind = 'positive_behavior') AS positive_behavior_count FROM d""")
def need_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as what their customers show: how many needs and tasks of which users they are."""
    return needs.summary(observed(spark, sf_dir))


@query("""
SELECT c_mktsegment AS target_user, o_orderpriority AS task, o_orderstatus AS need, o_custkey::VARCHAR AS customer, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS products,
  string_agg(DISTINCT month(o_orderdate)::VARCHAR, ',' ORDER BY month(o_orderdate)::VARCHAR) AS query_terms
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3, 4""")
def merged_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer shows again and again as one observation, with all years and months."""
    found = needs.merged(observed(spark, sf_dir))
    return found.select("target_user", "task", "need", F.col("evidence_refs")[0]["evidence_id"].alias("customer"), F.array_join("products", ",").alias("products"), F.array_join("query_terms", ",").alias("query_terms"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN n_chars > 4000 THEN 'long,en' ELSE 'en' END ELSE 'long' END AS industries FROM documents WHERE lang = 'en' OR n_chars > 4000")
def items_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array("source", F.when(F.col("n_chars") > 4000, "long").otherwise("short"), F.coalesce("lang", F.lit("?"))).alias("industry_ids"))
    return publish.in_scope(rows, ["en", "long"]).select("doc_id", F.array_join("industry_ids", ",").alias("industries"))


@query("""
WITH r AS (SELECT l_orderkey AS o, l_partkey AS p, count(*) AS version, max(l_quantity) > 45 AS gone, max(l_returnflag) AS rev, list_distinct(list(l_linestatus)) AS facts FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem JOIN r ON o = l_orderkey AND p = l_partkey
WHERE NOT (version > 1 OR gone) OR (NOT gone AND rev = l_returnflag AND list_contains(facts, l_linestatus))""")
def standing_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as signals on their order's parts: what was revised must be cited as it is now, what is withdrawn carries nothing."""
    lines = table(spark, sf_dir, "lineitem")
    now = lines.groupBy(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("evidence_id")).agg(F.count("*").alias("version"), (F.max("l_quantity") > 45).alias("retracted"), F.max("l_returnflag").alias("revision_id"), F.collect_set("l_linestatus").alias("facts"))
    signals = lines.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("signal_no"), F.col("l_partkey").alias("evidence_id"), F.col("l_returnflag").alias("evidence_revision_id"), F.array("l_linestatus").alias("facts"), "l_suppkey", "l_quantity")
    found = state.supported_signals(signals, now)
    return found.select(F.col("record_id").alias("l_orderkey"), F.col("signal_no").alias("l_linenumber"), F.col("evidence_id").alias("l_partkey"), "l_suppkey", "l_quantity")


@query("""
SELECT ts::DATE AS day, event_type, count(*) AS events, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events
WHERE ts IS NOT NULL GROUP BY 1, 2 HAVING ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of a stream of events that are closed when it ends, a day after their end."""
    base, schema = new_path(spark, "daily"), table(spark, sf_dir, "events").schema
    events = ingest.observations(spark, f"{sf_dir}/events.parquet*", schema).withColumn("at", F.col("ts").cast("timestamp"))
    days = ingest.daily(events, "at", "event_type")
    days.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(days.schema).parquet(f"{base}/out")
    return found.select("day", "event_type", "events", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


@query("""
WITH c AS (SELECT c_nationkey AS n, list_distinct(list(c_mktsegment)) AS own, count(*) AS people FROM customer GROUP BY 1)
SELECT n_nationkey, array_to_string(list_filter([CASE WHEN n_regionkey = 0 THEN 'id malformed' END, CASE WHEN n_regionkey = 1 THEN 'no audience' END, CASE WHEN coalesce(len(own), 0) = 0 OR n_regionkey = 2 AND people > len(own) THEN 'subtrack ids' END], lambda x: x IS NOT NULL), ',') AS violations
FROM nation LEFT JOIN c ON n = n_nationkey""")
def catalogue_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as industries and their customers' segments as tasks; what breaks a rule is said, and the rest passes the strict check."""
    task = F.struct(F.col("c_mktsegment").alias("id"))
    own = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(task).alias("every"), F.collect_set(task).alias("each"))
    rows = table(spark, sf_dir, "nation").join(own, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        "n_nationkey", F.when(F.col("n_regionkey") == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 1, " ").otherwise("all").alias("audience"),
        F.coalesce(F.when(F.col("n_regionkey") == 2, F.col("every")).otherwise(F.col("each")), F.array().cast("array<struct<id:string>>")).alias("subtracks"),
    )
    found = rules.violations(rows, rules.catalogue_rules())
    passed = rules.strict(found.where(F.size("violations") == 0).drop("violations"), rules.catalogue_rules()).select("n_nationkey", F.lit("").alias("violations"))
    return found.where(F.size("violations") > 0).select("n_nationkey", F.array_join("violations", ",").alias("violations")).union(passed)


@query("""
SELECT conv_id AS claim_id, count(text) AS refs, count(*) FILTER (text IS NOT NULL AND role = 'user') AS located,
  CASE WHEN count(text) > 0 AND count(text) = count(*) FILTER (text IS NOT NULL AND role = 'user') THEN 'verified' WHEN count(*) FILTER (text IS NOT NULL AND role = 'user') > 0 THEN 'incomplete' ELSE 'unsupported' END AS validation
FROM conversations GROUP BY conv_id""")
def claim_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats as claims that cite their turns, of which those of users are found."""
    refs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("claim_id"), F.when(F.col("text").isNotNull(), F.col("turn")).alias("evidence_id"), F.when(F.col("role") != "user", "no_quote").alias("problem"))
    return claims.claim_status(refs).select("claim_id", "refs", "located", "validation")


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN 'xiaohongshu' WHEN 'de' THEN 'zhihu' WHEN 'fr' THEN 'wechat_search' ELSE 'reddit' END AS source,
  CASE lang WHEN 'en' THEN CASE WHEN n_chars > 4000 THEN 'video_note' ELSE 'image_note' END WHEN 'de' THEN 'answer' WHEN 'fr' THEN 'article' END AS content_type
FROM documents WHERE CASE lang WHEN 'en' THEN n_chars > 200 WHEN 'de' THEN n_chars > 1000 WHEN 'fr' THEN n_chars > 2000 ELSE true END""")
def comment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of four sources, and what their comments can be asked as."""
    source = F.when(F.col("lang") == "en", "xiaohongshu").when(F.col("lang") == "de", "zhihu").when(F.col("lang") == "fr", "wechat_search").otherwise("reddit")
    note = F.when(F.col("n_chars") > 4000, "Video").when(F.col("n_chars") > 200, "normal").otherwise("poll")
    key = F.when((F.col("lang") == "de") & (F.col("n_chars") > 1000), "answer_id").when((F.col("lang") == "fr") & (F.col("n_chars") > 2000), "url").otherwise("id")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), source.alias("source"), F.lit("https://x.org").alias("url"), F.create_map(key, F.col("doc_id").cast("string"), F.lit("note_type"), note).alias("identifiers"))
    found = comments.candidates(items)
    return found.select(F.col("selected_item_id").cast("long").alias("doc_id"), "source", "content_type")


@query("""
SELECT o_orderkey, epoch(o_orderdate)::BIGINT - CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 7200 ELSE 28800 END AS at FROM orders WHERE o_orderpriority <> '5-LOW' UNION ALL
SELECT o_orderkey, NULL FROM orders WHERE o_orderpriority = '5-LOW'""")
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as texts of three zones, one unnamed; and texts that are no dates."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    zoned = F.when(F.col("o_orderstatus") == "F", F.concat(text, F.lit("Z"))).when(F.col("o_orderstatus") == "O", F.concat(text, F.lit("+02:00"))).otherwise(text)
    written = F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(zoned)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(times.instant(written)).alias("at"))


@query(r"""
WITH d AS (SELECT doc_id, replace(lower(coalesce(text, '')), 'ß', 'ss') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\p{L}\p{M}\p{N}]+')) AS term FROM d)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS times FROM w WHERE term NOT IN (""" + quoted(STOP_WORDS) + """) GROUP BY term""")
def sql_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of all documents, by a query in SQL alone."""
    sql.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("lodestone_documents")
    return spark.sql("SELECT term, count(*) AS documents, sum(n) AS times FROM lodestone_documents, LATERAL evidence_tokens(text, true) GROUP BY term")


@query(rf"SELECT url, count(*) AS pages FROM ({STRONG}) GROUP BY url")
def sql_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by canonical address, by a query in SQL alone."""
    sql.register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("lodestone_pages")
    return spark.sql("SELECT nfkc(canonical_url(url)) AS url, count(*) AS pages FROM lodestone_pages GROUP BY 1")


@query("SELECT lang AS source, count(*) AS responses, sum(n_chars)::BIGINT AS chars, sum(length(coalesce(text, '')))::BIGINT AS characters FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def recorded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents recorded as responses of their language, written as JSON lines and read by the data source, two sources alone."""
    path, docs = new_path(spark, "recorded"), table(spark, sf_dir, "documents")
    response = F.struct("n_chars", F.coalesce("text", F.lit("")).alias("text"))
    line = F.struct(F.col("lang").alias("source"), F.col("doc_id").cast("string").alias("request_id"), F.lit("2026-07-14").alias("observed_at"), response.alias("response"))
    docs.select(F.to_json(line).alias("value")).write.text(path)
    recorded.register(spark)
    found = spark.read.format("recorded_responses").option("path", path).option("split", 1 << 20).load().where(F.col("source").isin("en", "de"))
    value = F.from_json("response", "n_chars long, text string")
    return found.groupBy("source").agg(F.count("*").alias("responses"), F.sum(value["n_chars"]).alias("chars"), F.sum(F.length(value["text"])).cast("long").alias("characters"))
