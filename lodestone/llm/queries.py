"""The registered query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import (
    audit,
    langid,
    lexical,
    license_scan,
    maxent,
    media,
    mixing,
    more_queries,
    packing,
    quality,
    sharding,
    simhash,
    toolcalls,
    warc,
)
from lodestone.llm.common import new_path, words

#: The language model learns from keys of the other remainders (fixed value).
FOLDS, HELD_OUT = 4, 2
#: So does the model of words, of seven (fixed value).
LM_FOLDS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % FOLDS


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source, language and hundreds of ids; ``documents`` has no paths.

    Those that speak of a licence are the licence files of directories at all three depths (by
    a hash of the id), so that files inherit from their own directory and from those above.
    """
    speaks = F.coalesce(F.col("text").rlike(r"(?i)licen[cs]e"), F.lit(False))
    folders = F.array(F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 100).cast("string"))
    depth = F.when(speaks, F.pmod(F.xxhash64("doc_id"), F.lit(3)) + 1).otherwise(3).cast("int")
    name = F.when(speaks, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    path = F.concat_ws("/", F.slice(F.transform(folders, lambda x: F.coalesce(x, F.lit("none"))), 1, depth), name)
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold() != HELD_OUT))
    return langid.with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals by ranges of doc_id, compacted; every document with the shard that holds it.

    A shard is named by the version, the job and the task that wrote it, so that reruns agree.
    """
    docs = table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    bounds = [low + (high - low + 1) * k // 4 for k in range(1, 4)] if low is not None else []
    key, store = F.col("doc_id"), sharding.ShardStore(spark, new_path(spark, "shards"), target=32 << 20)
    for k in range(len(bounds) + 1):
        after = key >= bounds[k - 1] if k else F.lit(True)
        before = key < bounds[k] if k < len(bounds) else F.lit(True)
        late = (after & before) if k else (key.isNull() | before)
        store.append(docs.where(late))
    store.compact()
    store.vacuum()
    nth = F.regexp_replace("shard", r".*-(\d+)/part-(\d+).*", "$1-$2")
    shards = store.manifest().withColumn("name", F.concat(F.lit("v"), "added", F.lit("/"), nth))
    rows = store.read()
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return rows.join(shards, rows._shard == shards.shard).select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text).alias("text_crc32"), F.col("name").alias("shard"), "tier", F.col("added").alias("version")
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json
    return packing.pack(docs, ranks, public_tokenizers.PATTERN, whole=public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.measured(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(rows).select("doc.doc_id", *counts)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = toolcalls.chat_messages(table(spark, sf_dir, "conversations"))
    return toolcalls.linked(chats, toolcalls.REPLY).withColumnRenamed("conv", "conv_id")


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % LM_FOLDS == HELD_OUT
    return maxent.scored(table(spark, sf_dir, "documents"), held)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters: A few words, B few distinct words, C upper case, D symbols, E a lesser id's text."""
    text, w = F.coalesce("text", F.lit("")), words(F.col("text"))
    filters = {
        "A": F.size(w) < 200,
        "B": 100 * F.size(F.array_distinct(w)) < 50 * F.size(w),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), filters, "E")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_warc,
        op3_language_id,
        op4_sharding,
        op5_best_fit_packing,
        op6_quality_rules,
        op7_simhash,
        op8_tool_calls,
        op9_media_chunks,
        op10_mixing,
        op11_lm_scores,
        op12_lexical_search,
        op13_filter_audit,
    )
} | more_queries.QUERIES

WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE: dict[str, str] = {
    "op2_warc": """
WITH d AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS owner FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform([1, 11, 21, 31], lambda k: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, k, 10))::BIGINT >> s) & 31), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM h
""",
    "op10_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size AS top, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
p AS (
  SELECT sum(top) OVER o AS held, sum(weight) OVER o AS used, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    lead(ratio) OVER (ORDER BY ratio, source) AS next, min(ratio) OVER () AS first, row_number() OVER (ORDER BY ratio, source) AS k
  FROM r WINDOW o AS (ORDER BY ratio, source ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT 0 AS k, total / weights AS level, first AS next FROM p UNION
  SELECT k, (total - held) / (weights - used), next FROM p WHERE weights > used),
t AS (SELECT source, source_size, least(top, weight * (SELECT arg_min(level, k) FROM l WHERE next IS NULL OR next > level)) AS target FROM r),
m AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('20:' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) * size)::BIGINT AS taken FROM m
""",
    "op12_lexical_search": rf"""
WITH words AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)),
tf AS (SELECT doc_id, row, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, row, term),
size AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), total),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM benchmark),
scores AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN w USING (term) JOIN size USING (row), total GROUP BY item_id, row, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
""",
    "op13_filter_audit": rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || e.letter || g.letter AS filter_order, [a.bit, b.bit, c.bit, e.bit, g.bit] AS bits
  FROM x a, x b, x c, x e, x g
  WHERE a.bit | b.bit | c.bit | e.bit | g.bit = 31),
s AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS before
  FROM o, range(1, 6) AS r(step)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
""",
    "op8_tool_calls": """
WITH users AS (
  SELECT conv_id, turn, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run
  FROM conversations WHERE role = 'user'),
calls AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS depth FROM users),
turns AS (
  SELECT m.conv_id, m.turn, text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN m.turn WHEN 'assistant' THEN m.turn - 1 END AS ref
  FROM conversations m),
named AS (SELECT *, 'call-' || conv_id || '-' || ref AS id FROM turns),
answered AS (SELECT conv_id, ref, count(*) AS n FROM named WHERE kind = 'result' GROUP BY conv_id, ref)
SELECT n.conv_id, n.turn, n.kind, n.id, 2 * c.depth + (n.kind = 'result')::BIGINT AS step,
  CASE n.kind WHEN 'result' THEN CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'linked' END
    WHEN 'message' THEN 'message' ELSE CASE WHEN a.n > 0 THEN 'answered' ELSE 'unanswered' END END AS status,
  CASE n.kind
    WHEN 'call' THEN '{"arguments":' || to_json('{"prompt":' || to_json(text) || ',"turn":' || n.turn || '}')
      || ',"id":' || to_json(n.id) || ',"kind":"call","tool":"reply"}'
    WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":' || to_json(n.id) || ',"kind":"result"}'
    ELSE '{"content":' || to_json(text) || ',"kind":"message"}' END AS json
FROM named n
LEFT JOIN calls c ON c.conv_id = n.conv_id AND c.turn = n.ref
LEFT JOIN answered a ON a.conv_id = n.conv_id AND a.ref = n.ref
""",
    "op6_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, t, trim(regexp_replace(lower(x), '[ 	-
]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, t, unnest(l) AS x FROM d)),
hosts AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
frequent AS (
  SELECT source, line
  FROM (SELECT source, line, count(DISTINCT t) AS n FROM lines GROUP BY source, line)
  JOIN hosts USING (source) WHERE n > 10 AND n > 0.2 * docs),
gone AS (
  SELECT doc_id, sum(len(regexp_extract_all(line, '{WORD}'))) AS n
  FROM lines JOIN frequent USING (source, line) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0) AS n_gone
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_gone <= 0.5 * n_words AS kept
FROM counted
""",
} | more_queries.ORACLE
