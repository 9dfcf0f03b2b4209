"""Registered queries of streams: the tables as streams that end, with SQL for what they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.shared import new_path
from lodestone.plans.queries import moment, query, table
from lodestone.streaming import ingest, state


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, max(event_id) AS last FROM events WHERE ts <= TIMESTAMP '2024-01-25 00:00:00' GROUP BY event_type")
def exact_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events streamed into a bucketed log twice over, from the beginning each time; what a day is too late for is held back."""
    base, schema = new_path(spark, "exact"), table(spark, sf_dir, "events").schema
    late = F.col("ts") > moment("2024-01-25 00:00:00")
    for k in range(2):
        source = ingest.observations(spark, f"{sf_dir}/events.parquet*", schema)
        ingest.exact(source, f"{base}/log", f"{base}/late", f"{base}/state{k}", late, buckets=16).awaitTermination()
    log = spark.table(ingest.bucketed_log(spark, f"{base}/log", schema, buckets=16))
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.max("event_id").alias("last"))


KIND = "CASE event_type WHEN 'purchase' THEN 'submit' WHEN 'error' THEN 'release' ELSE 'claim' END"


@query(f"""
WITH RECURSIVE e AS (
  SELECT user_id AS b, (epoch_us(ts) // 1000) AS tm, event_id AS seq, {KIND} AS kind, 'w' || ((props ->> '$.k')::BIGINT // 34) AS worker, 1 + 600 * floor(value)::BIGINT AS seconds,
    row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events WHERE user_id IS NOT NULL),
f AS (
  SELECT DISTINCT b, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS holder, NULL::BIGINT AS expires, false AS done, NULL::BIGINT AS expired, NULL::VARCHAR AS loser, NULL::VARCHAR AS decision FROM e UNION ALL
  SELECT b, i, seq, CASE decision WHEN 'claimed' THEN worker WHEN 'released' THEN NULL WHEN 'committed' THEN NULL ELSE h END, CASE decision WHEN 'claimed' THEN tm + 1000 * seconds ELSE expires END,
    done OR decision = 'committed', expired, loser, decision
  FROM (
    SELECT *, CASE kind WHEN 'claim' THEN CASE WHEN done THEN 'refused: done' WHEN h IS NOT NULL THEN 'refused: leased' WHEN seconds > 86400 THEN 'refused: invalid' ELSE 'claimed' END
      WHEN 'submit' THEN CASE WHEN h = worker THEN 'committed' ELSE 'refused: no lease' END ELSE CASE WHEN h = worker THEN 'released' ELSE 'refused: no lease' END END AS decision
    FROM (
      SELECT f.b, e.i, e.seq, kind, worker, seconds, tm, f.expires, f.done, CASE WHEN f.holder IS NOT NULL AND f.expires > tm THEN f.holder END AS h,
        CASE WHEN f.holder IS NOT NULL AND f.expires <= tm THEN f.expires END AS expired, CASE WHEN f.holder IS NOT NULL AND f.expires <= tm THEN f.holder END AS loser
      FROM f JOIN e ON e.b = f.b AND e.i = f.i + 1))),
ended AS (SELECT b, arg_max(holder, i) AS holder, arg_max(coalesce(expires, -1), i) AS expires, arg_max((holder IS NULL), i) AS free FROM f GROUP BY b)
SELECT b::VARCHAR AS batch_id, seq, decision, NULL::BIGINT AS expired FROM f WHERE i > 0 UNION ALL
SELECT b::VARCHAR, NULL, loser, expired FROM f WHERE expired IS NOT NULL UNION ALL
SELECT b::VARCHAR, NULL, holder, expires FROM ended WHERE NOT free AND expires <= (SELECT max(tm) FROM e)""")
def review_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as claims, submissions and releases of a batch each, by three workers; and when leases expire."""
    base, schema = new_path(spark, "leases"), table(spark, sf_dir, "events").schema
    worker = F.concat(F.lit("w"), F.floor(F.get_json_object("props", "$.k").cast("long") / 34).cast("string"))
    events = ingest.observations(spark, f"{sf_dir}/events.parquet*", schema).select(
        F.col("user_id").cast("string").alias("batch_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.expr(KIND).alias("kind"), worker.alias("worker"), worker.alias("lease_id"),
        (1 + 600 * F.floor("value")).cast("long").alias("seconds"), F.col("event_id").cast("string").alias("submission_id"), F.col("event_type").alias("digest"),
    )
    found = state.finished(state.leases(events), f"{base}/out", f"{base}/state")
    gone = F.col("decision") == "expired"
    return found.select("batch_id", "seq", F.when(gone, F.col("worker")).otherwise(F.col("decision")).alias("decision"), F.when(gone, F.unix_millis("at")).alias("expired"))


@query("""
WITH p AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS ids, turn < max(turn) OVER (PARTITION BY conv_id) AS more FROM conversations),
w AS (SELECT conv_id, turn, unnest(ids) AS id FROM p),
n AS (SELECT conv_id, turn, count(*) AS added FROM (SELECT conv_id, id, min(turn) AS turn FROM w GROUP BY ALL) GROUP BY ALL),
c AS (SELECT p.*, coalesce(added, 0)::BIGINT AS added, sum(coalesce(added, 0)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS comments FROM p LEFT JOIN n USING (conv_id, turn)),
d AS (SELECT *, CASE WHEN len(ids) = 0 THEN CASE WHEN more THEN 'empty_or_unrecognized_page' ELSE 'empty_page' END WHEN comments >= 100 THEN 'comment_limit' WHEN NOT more THEN 'provider_end' WHEN turn >= 3 THEN 'page_limit'
  WHEN turn % 2 = 1 AND contains(ids::VARCHAR, 'z') THEN 'pagination_unknown' ELSE 'next_page_planned' END AS decision FROM c)
SELECT conv_id::VARCHAR AS post_id, turn AS page, added, comments, decision, CASE WHEN decision = 'next_page_planned' THEN 't' || (turn + 1) END AS next_cursor FROM d""")
def comment_page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as posts: turns are pages, words the comments; some odd turns lack a cursor."""
    base, chats = new_path(spark, "pages"), table(spark, sf_dir, "conversations")
    last = chats.groupBy("conv_id").agg(F.max("turn").alias("last"))
    words = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != ""))
    cursor = lambda n: F.concat(F.lit("t"), n.cast("string"))
    pages = chats.join(last, "conv_id").select(
        F.col("conv_id").cast("string").alias("post_id"), F.col("turn").alias("page"), F.col("turn").alias("seq"), F.when(F.col("turn") > 0, cursor(F.col("turn"))).alias("cursor"), words.alias("comment_ids"),
        (F.col("turn") < F.col("last")).alias("has_more"), F.when((F.col("turn") % 2 == 0) | ~F.array_join(words, " ").contains("z"), cursor(F.col("turn") + 1)).alias("next_cursor"),
    )
    pages.write.parquet(f"{base}/in")
    source = ingest.observations(spark, f"{base}/in", pages.schema)
    return state.finished(state.comment_pages(source), f"{base}/out", f"{base}/state")
