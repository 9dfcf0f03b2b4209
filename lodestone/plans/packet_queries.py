"""Registered queries of reading: packets of claims with what they cite, and the order in which evidence is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.shared import materialise, new_path
from lodestone.operators import discovery, graphs, packets, reading
from lodestone.plans.queries import ORACLE, moment, query, table
from lodestone.sources.fulltext import FullTextIndex

POLICY = packets.POLICY
MOST_ITEMS, MOST_CHARS = 30, 18_000


@query(rf"""
WITH RECURSIVE lines AS (
  SELECT c_nationkey AS nation, o_orderkey AS o, o_orderdate > TIMESTAMP '2001-01-01' AS future, p_brand, p_brand || ' ' || p_type AS id, p_partkey,
    l_linenumber, '{{"line":' || l_linenumber || ',"part":' || l_partkey || '}}' AS json, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
kinds AS (SELECT p_brand || ' ' || p_type AS id, p_brand, min(p_partkey) AS position, min(p_name) AS title FROM part GROUP BY ALL),
ev AS (
  SELECT DISTINCT nation, id, position, p_brand = 'Brand#7' AS old, '{{"evidence_id":' || to_json(id) || ',"title":' || to_json(title) || ',"text_refs":[]}}' AS json
  FROM lines JOIN kinds USING (id, p_brand)),
e AS (SELECT * FROM ev WHERE NOT old),
cl AS (
  SELECT nation, o AS position, 'order-' || o AS id, bool_or(lines.p_brand = 'Brand#7') AS bad,
    '{{"claim_id":"order-' || o || '","status":' || to_json(min(o_orderstatus)) || ',"text":' || to_json(min(o_orderpriority)) || '}}' AS json
  FROM lines WHERE NOT future GROUP BY nation, o),
ex AS (SELECT s_nationkey AS nation, s_suppkey AS position, 's' || s_suppkey AS id, '{{"experiment_id":"s' || s_suppkey || '","name":' || to_json(s_name) || '}}' AS json FROM supplier),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY nation ORDER BY phase, position, id) AS no
  FROM (SELECT nation, 0 AS phase, position, id, json FROM cl WHERE NOT bad UNION ALL SELECT nation, 1, position, id, json FROM ex UNION ALL SELECT nation, 2, position, id, json FROM e)),
refs AS (
  SELECT cand.nation, no, lines.id, lines.json, row_number() OVER (PARTITION BY cand.nation, no ORDER BY l_linenumber, p_partkey) AS ref_no
  FROM cand JOIN lines ON phase = 0 AND lines.o = cand.position AND lines.nation = cand.nation),
mem AS (
  SELECT DISTINCT nation, no, 'e:' || id AS key, length(e.json) AS chars, 1 AS items FROM refs JOIN e USING (nation, id) UNION
  SELECT DISTINCT nation, no, 'r:' || id || ' ' || json, length(json) + 1, 0 FROM refs UNION
  SELECT nation, no, 'e:' || id, length(json) + 1, 1 FROM cand WHERE phase = 2),
lists AS (SELECT nation, no, list({{'key': key, 'chars': chars, 'items': items}}) AS members FROM mem GROUP BY nation, no),
c AS (SELECT nation, no, phase, CASE WHEN phase = 2 THEN 0 ELSE length(json) + 1 END AS own, coalesce(members, []) AS members FROM cand LEFT JOIN lists USING (nation, no)),
nations AS (SELECT nation FROM lines UNION SELECT nation FROM ex),
g AS (
  SELECT nation, (SELECT count(*) FROM cand WHERE cand.nation = nations.nation AND phase = 0) AS claims, (SELECT count(*) FROM cand WHERE cand.nation = nations.nation AND phase = 1) AS experiments,
    (SELECT count(*) FROM cand WHERE cand.nation = nations.nation AND phase = 2) AS evidence, (SELECT count(*) FROM ev WHERE old AND ev.nation = nations.nation) AS superseded,
    (SELECT count(DISTINCT o) FROM lines WHERE future AND lines.nation = nations.nation) AS future, (SELECT count(*) FROM cl WHERE bad AND cl.nation = nations.nation) AS unavailable
  FROM nations),
f AS (
  SELECT nation, 0 AS no, []::VARCHAR[] AS have, 0 AS chars, 0 AS items, 0 AS n_c, 0 AS n_x, 0 AS n_e, false AS took FROM nations UNION ALL
  SELECT nation, no, CASE WHEN ok THEN have || list_transform(fresh, lambda m: m.key) ELSE have END, CASE WHEN ok THEN size ELSE chars END, CASE WHEN ok THEN held ELSE items END,
    CASE WHEN ok THEN t_c ELSE n_c END, CASE WHEN ok THEN t_x ELSE n_x END, CASE WHEN ok THEN t_e ELSE n_e END, ok
  FROM (
    SELECT *, held <= {MOST_ITEMS} AND base + length((base + length((base + length((base + 1)::VARCHAR))::VARCHAR))::VARCHAR) <= {MOST_CHARS} AND (phase < 2 OR len(fresh) > 0) AS ok
    FROM (
      SELECT *, {{fixed}} + length(superseded::VARCHAR) + length(future::VARCHAR) + length(unavailable::VARCHAR) + size - (t_c > 0)::INT - (t_x > 0)::INT - (t_e > 0)::INT
        + length((claims - t_c)::VARCHAR) + length((experiments - t_x)::VARCHAR) + length((evidence - t_e)::VARCHAR)
        + CASE WHEN greatest(superseded, future, unavailable, claims - t_c, experiments - t_x, evidence - t_e) > 0 THEN 4 ELSE 5 END AS base
      FROM (
        SELECT *, chars + own + coalesce(list_sum(list_transform(fresh, lambda m: m.chars)), 0)::BIGINT AS size, items + more + (phase = 1)::INT AS held,
          n_c + (phase = 0)::INT AS t_c, n_x + (phase = 1)::INT AS t_x, n_e + more AS t_e
        FROM (
          SELECT *, coalesce(list_sum(list_transform(fresh, lambda m: m.items)), 0)::BIGINT AS more
          FROM (SELECT f.*  EXCLUDE (no), c.no, phase, own, list_filter(members, lambda m: NOT list_contains(have, m.key)) AS fresh, g.* EXCLUDE (nation)
            FROM f JOIN c ON c.nation = f.nation AND c.no = f.no + 1 JOIN g ON g.nation = f.nation)))))),
taken AS (SELECT cand.* FROM cand JOIN f USING (nation, no) WHERE took),
once AS (SELECT nation, id, refs.json, min((no, ref_no)) AS place FROM refs SEMI JOIN taken USING (nation, no) GROUP BY nation, id, refs.json),
notes AS (SELECT nation, id, min(place) AS place, string_agg(json, ',' ORDER BY place) AS notes FROM once GROUP BY nation, id),
shown AS (
  SELECT nation, 2 AS phase, place, substr(e.json, 1, length(e.json) - 2) || notes || ']}}' AS json FROM e JOIN notes USING (nation, id) UNION ALL
  SELECT nation, phase, (no, 0), json FROM taken),
packed AS (
  SELECT nation, coalesce(string_agg(json, ',' ORDER BY place) FILTER (phase = 0), '') AS claims, coalesce(string_agg(json, ',' ORDER BY place) FILTER (phase = 1), '') AS experiments,
    coalesce(string_agg(json, ',' ORDER BY place) FILTER (phase = 2), '') AS evidence, count(*) FILTER (phase = 0) AS n_c, count(*) FILTER (phase = 1) AS n_x, count(*) FILTER (phase = 2) AS n_e
  FROM shown GROUP BY nation),
said AS (
  SELECT nation, '{{"schema_version":"3.0","as_of":"2001-01-01","run_id":"tables","evidence":[' || p.evidence || '],"claims":[' || p.claims || '],"experiments":[' || p.experiments
    || '],"omitted":{{"evidence_superseded":' || superseded || ',"claims_future":' || future || ',"claims_unavailable_evidence":' || unavailable || ',"evidence_budget":' || (g.evidence - n_e)
    || ',"claims_budget":' || (g.claims - n_c) || ',"experiments_budget":' || (g.experiments - n_x) || '}},"semantic_validation":"not_performed","truncated":'
    || (greatest(superseded, future, unavailable, g.claims - n_c, g.experiments - n_x, g.evidence - n_e) > 0) || ',"limits":{{"max_items":{MOST_ITEMS},"max_chars":{MOST_CHARS}}},"serialized_chars":' AS a,
    ',"selection_policy":"{POLICY}"}}' AS b
  FROM g JOIN packed p USING (nation)),
sized AS (SELECT nation, a, b, length(a) + length(b) + length((length(a) + length(b) + length((length(a) + length(b) + 1)::VARCHAR))::VARCHAR) AS n FROM said)
SELECT nation, a || n || b AS packet, n::BIGINT AS serialized_chars FROM sized""".replace("{fixed}", str(sum(map(len, packets._pieces("2001-01-01", "tables", ["evidence_superseded", "claims_future", "claims_unavailable_evidence"], MOST_ITEMS, MOST_CHARS))))))  # fmt: skip
def claim_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation's orders a packet: an order claims what its lines cite, kinds of parts, and suppliers are its experiments."""
    kind = F.concat_ws(" ", "p_brand", "p_type").alias("id")
    part = table(spark, sf_dir, "part")
    kinds = part.groupBy("p_brand", kind).agg(F.min("p_partkey").alias("position"), F.min("p_name").alias("title"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    orders = orders.select(F.col("c_nationkey").alias("nation"), "o_orderkey", (F.col("o_orderdate") > moment("2001-01-01 00:00:00")).alias("future"), "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").join(part.select("p_partkey", "p_brand", kind), F.col("p_partkey") == F.col("l_partkey"))
    ref = F.struct("l_linenumber", "p_partkey", "id", "p_brand", F.to_json(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))).alias("json"))
    # All else is made of orders with their lines, which are joined once.
    orders = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("nation", "o_orderkey", "future").agg(
        F.min("o_orderstatus").alias("status"), F.min("o_orderpriority").alias("text"), F.array_sort(F.collect_list(ref)).alias("refs")
    )
    orders = materialise(orders, "orders")
    shown = orders.select("nation", F.explode("refs").alias("ref")).select("nation", "ref.id", "ref.p_brand").distinct()
    shown = materialise(shown.join(kinds, ["id", "p_brand"]), "shown")
    text = F.to_json(F.struct(F.col("id").alias("evidence_id"), "title", F.array().cast("array<string>").alias("text_refs")))
    evidence = shown.where("p_brand <> 'Brand#7'").select("nation", "id", "position", text.alias("json"))
    name = F.concat(F.lit("order-"), "o_orderkey")
    claim = F.to_json(F.struct(name.alias("claim_id"), "status", "text"))
    claims = orders.where("not future").select("nation", name.alias("id"), F.col("o_orderkey").alias("position"), claim.alias("json"), "refs")
    supplier = F.concat(F.lit("s"), "s_suppkey")
    tests = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), supplier.alias("id"), F.col("s_suppkey").alias("position"), F.to_json(F.struct(supplier.alias("experiment_id"), F.col("s_name").alias("name"))).alias("json"))
    before = shown.where("p_brand = 'Brand#7'").groupBy("nation").agg(F.count("*").alias("evidence_superseded")).join(orders.where("future").groupBy("nation").agg(F.count("*").alias("claims_future")), "nation", "full").na.fill(0)
    return packets.packets(evidence, claims, tests, ["nation"], "2001-01-01", "tables", before, MOST_ITEMS, MOST_CHARS)


ROLES = (("quality = 1", "workflow_pain"), ("quality = 0 AND toxic = 0", "official_pricing"), ("toxic = 1", "counter_evidence"))
ROLE = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in ROLES) + " ELSE 'discovery' END"


@query(f"""
WITH RECURSIVE c AS (
  SELECT lang, doc_id, list_sort(list_distinct([source, CASE WHEN n_chars > 4000 THEN 'long' ELSE 'short' END])) AS own, [CASE WHEN contains(coalesce(text, ''), chr(10)) THEN 'lines' ELSE 'line' END] AS tasks,
    source, {ROLE} AS role, CASE WHEN quality = 1 THEN 'behavior' WHEN toxic = 1 THEN 'challenge' WHEN quality = 0 THEN 'commercial' ELSE 'unknown' END AS roles,
    CASE WHEN toxic = 1 THEN 3 WHEN n_chars < 100 THEN 2 WHEN quality = 1 THEN 0 ELSE 1 END AS grade
  FROM documents LEFT JOIN labels USING (doc_id)),
f AS (
  SELECT lang, 0 AS position, []::BIGINT[] AS ids, []::VARCHAR[] AS i, []::VARCHAR[] AS g, []::VARCHAR[] AS t, []::VARCHAR[] AS s, []::VARCHAR[] AS r FROM (SELECT DISTINCT lang FROM documents) UNION ALL
  SELECT lang, position + 1, list_append(ids, x.doc_id), i || x.own, list_append(g, x.roles), t || x.tasks, list_append(s, x.source), list_append(r, x.role)
  FROM (
    SELECT f.lang, position, ids, i, g, t, s, r, arg_min({{'doc_id': doc_id, 'own': own, 'roles': roles, 'tasks': tasks, 'source': source, 'role': role}}, (
      grade >= 2, list_min(list_transform(own, lambda o: len(list_filter(i, lambda z: z = o)))), len(list_filter(g, lambda z: z = roles)), list_min(list_transform(tasks, lambda o: len(list_filter(t, lambda z: z = o)))),
      len(list_filter(s, lambda z: z = source)), len(list_filter(r, lambda z: z = role)), grade, doc_id)) AS x
    FROM f JOIN c ON c.lang IS NOT DISTINCT FROM f.lang WHERE position < 15 AND NOT list_contains(ids, doc_id) GROUP BY ALL))
SELECT lang, ids[position] AS doc_id, position::INT AS position FROM f WHERE position > 0""")
def fair_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen documents to read of each language, by turns of source, length, label and form."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    role = F.lit("discovery")
    for condition, name in reversed(ROLES):
        role = F.when(F.expr(condition), name).otherwise(role)
    semantic = F.when(F.col("quality") == 1, "relevant").when(F.col("toxic") == 1, "unrelated")
    rows = docs.select(
        "lang", "doc_id", "source", role.alias("evidence_role"), F.array("source", F.when(F.col("n_chars") > 4000, "long").otherwise("short")).alias("industry_ids"),
        F.array(F.when(F.coalesce("text", F.lit("")).contains("\n"), "lines").otherwise("line")).alias("task_family_ids"),
        reading.quality(semantic, F.col("toxic") == 1, F.when(F.col("n_chars") < 100, "unrelated")).alias("quality"),
    )
    return reading.fair_order(rows, 15, ["lang"], "doc_id").select("lang", "doc_id", "position")


FIRST_LAST = "SELECT doc_id, unnest(list_distinct(['first:' || l[1], 'last:' || l[-1]])) AS key FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')"


@query(f"""
WITH RECURSIVE k AS ({FIRST_LAST}), e AS (SELECT DISTINCT a.doc_id AS a, b.b FROM k a JOIN (SELECT key, min(doc_id) AS b FROM k GROUP BY key) b USING (key)),
pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM (SELECT DISTINCT doc_id FROM k) UNION SELECT r.a, pairs.b FROM r JOIN pairs ON pairs.a = r.b)
SELECT a AS doc_id, min(b) AS "group" FROM r GROUP BY a""")
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that begin or end with the same line, directly or by way of others."""
    lines = F.split("text", "\n")
    keys = F.array_distinct(F.array(F.concat(F.lit("first:"), F.element_at(lines, 1)), F.concat(F.lit("last:"), F.element_at(lines, -1))))
    rows = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.explode(keys).alias("key"))
    return graphs.groups(rows, "doc_id", "key")


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, min(page_id) OVER (PARTITION BY host) AS source_group FROM p""")
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by independent source: none names a publisher, so their hosts stand for them."""
    none = F.lit(None).cast("string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", none.alias("original_url"), none.alias("original_publisher"), F.lit(False).alias("retracted"), none.alias("status"))
    return graphs.independent_sources(pages, "page_id")


@query(ORACLE["bm25_match"])
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bm25_match`` from a stored index, to which documents were added in three lots by source, the last with all again, and merged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    index = FullTextIndex(spark, new_path(spark, "index"), ["doc_id"])
    middle = docs.agg(F.percentile_approx(F.crc32("source"), 0.5)).first()[0]
    for lot in (docs.where(F.crc32("source") < middle), docs.where(F.crc32("source") >= middle), docs):
        index.add(lot, "text")
    index.merge(2)
    return index.search(["the", "license"]).select("doc_id", F.round("score", 6).alias("score"))


@query("""
WITH RECURSIVE t AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
f AS (
  SELECT lang, doc_id, i, 1::BIGINT AS batch, 1 AS n, 1000 + n_chars AS used FROM t WHERE i = 1 UNION ALL
  SELECT lang, doc_id, i, batch + ends::BIGINT, CASE WHEN ends THEN 1 ELSE n + 1 END, CASE WHEN ends THEN 1000 + x ELSE used + x END
  FROM (SELECT f.lang, t.doc_id, t.i, batch, n, used, n_chars AS x, n >= 16 OR used + n_chars > 18000 AS ends FROM f JOIN t ON t.lang IS NOT DISTINCT FROM f.lang AND t.i = f.i + 1))
SELECT doc_id, batch FROM f""")
def review_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language in batches to review, by what a reader can take at once."""
    return discovery.review_batches(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "lang", ["doc_id"], "n_chars").select("doc_id", "batch")
