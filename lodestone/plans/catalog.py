"""Sources, topics and the order in which they are searched."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.times import ordinal_day

#: Sources by kind (fixed values).
PAID = ("tiktok", "instagram", "linkedin", "threads", "twitter", "youtube", "reddit", "douyin", "xiaohongshu", "bilibili", "zhihu", "wechat_search")
COMMUNITY = ("hackernews", "github")
MANUAL = ("web", "producthunt", "indiehackers", "appstore", "googleplay", "chrome_web_store", "g2", "capterra", "trustpilot", "v2ex", "steam", "shopify_app_store", "etsy")
CHINESE = ("douyin", "xiaohongshu", "bilibili", "zhihu", "wechat_search")


#: What sources of a kind share (fixed values): provider, cost, capabilities, languages, default_enabled, credential_required.
KINDS = (
    ("paid", PAID, "paid", "paid_live_quote_required", ("search", "detail", "top_level_comments"), ("multilingual",), True, True),
    ("community", COMMUNITY, "community-public", "free_public_api", ("search", "detail", "top_level_comments"), ("en",), True, False),
    ("manual", MANUAL, "host-verified-web", "no_network_import", ("import",), ("multilingual",), False, False),
)
#: What evidence any source may give (fixed values).
EVIDENCE_ROLES = (
    "official_pricing", "product_update", "product_review", "hiring", "outsourcing", "payment", "workflow_pain", "alternative", "regional_gap", "counter_evidence",
    "usage_behavior", "creative_output", "learning_progress", "social_sharing",
)
#: Sources that can be searched by region (fixed values).
BY_REGION = ("tiktok", "youtube")
#: What single sources have beside or instead (fixed values).
MORE_CAPABILITIES = (("xiaohongshu", ("comment_pagination", "comment_replies")), ("douyin", ("comment_pagination", "comment_replies")), ("twitter", ("comment_pagination", "latest_comments")))


def registry(spark: SparkSession, credentials: dict[str, list[str]] | None = None) -> DataFrame:
    """The dimension table of sources: 27 rows, from the tables of kinds, sources and exceptions.

    ``credentials`` names what a caller configures for a source, or for all of a kind (paid,
    community, manual); a source's own names come first. Health is what nobody has checked yet.
    """
    given = credentials or {}
    texts = "array<string>"
    kinds = spark.createDataFrame([(k[0], *k[2:]) for k in KINDS], f"kind string, provider string, cost string, shared {texts}, usual {texts}, default_enabled boolean, credential_required boolean")
    sources = spark.createDataFrame([(name, k[0], list(given.get(name, given.get(k[0], [])))) for k in KINDS for name in k[1]], f"source string, kind string, credentials {texts}")
    more = spark.createDataFrame(MORE_CAPABILITIES, f"source string, more {texts}")
    spoken = spark.createDataFrame([(name, ["zh"]) for name in CHINESE], f"source string, own {texts}")
    return sources.join(kinds, "kind").join(more, "source", "left").join(spoken, "source", "left").select(
        "source", "provider", "cost", F.concat("shared", F.coalesce("more", F.array().cast(texts))).alias("capabilities"),
        F.coalesce("own", "usual").alias("preferred_languages"), "default_enabled", "credential_required",
        F.col("source").alias("platform"), F.array(F.lit("global")).alias("regions"), F.col("source").isin(*BY_REGION).alias("region_filter"), (F.col("kind") == "manual").alias("manual_import_only"),
        "credentials", F.array(*[F.lit(r) for r in EVIDENCE_ROLES]).alias("evidence_roles"), F.lit("not_checked").alias("live_health"),
    )


def routed(sources: DataFrame, language: Column) -> DataFrame:
    """Sources that a query's language goes to by default."""
    base = F.substring_index(language, "-", 1)
    return sources.where(F.array_contains("preferred_languages", "multilingual") | F.array_contains(F.col("preferred_languages"), base))


def diagnosed(sources: DataFrame, configured: Column) -> DataFrame:
    """``sources`` with configuration_status; ``configured`` says whether credentials are set."""
    status = F.when(F.array_contains("capabilities", "import"), "manual_import_only").when(F.col("credential_required") & ~configured, "missing_required_config")
    return sources.withColumn("configuration_status", status.otherwise("configuration_ready"))


def configured(sources: DataFrame, names: list[str]) -> DataFrame:
    """``sources`` diagnosed by the names of credentials that are set, and which of theirs are.

    Only names are asked for, never values; a source without credentials has all of them.
    """
    present = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    rows = diagnosed(sources, F.size(F.array_except("credentials", present)) == 0)
    return rows.withColumn("credentials_set", F.map_from_arrays("credentials", F.transform("credentials", lambda c: F.array_contains(present, c))))


def interleaved(tasks: DataFrame, topic: str) -> DataFrame:
    """``tasks`` (topic, list: entry or subtrack, n from 0) with ``slot``: entries and subtracks in turns."""
    turn = F.struct("n", F.when(F.col("list") == "entry", 0).otherwise(1).alias("side"))
    before = F.array_sort(F.collect_list(F.struct("n", F.when(F.col("list") == "entry", 0).otherwise(1).alias("side"), "task_id")))
    ordered = tasks.groupBy(topic).agg(before.alias("o")).select(topic, F.posexplode("o").alias("slot", "x")).select(topic, F.col("x.task_id").alias("task_id"), "slot")
    return tasks.withColumn("_turn", turn).drop("_turn").join(ordered, [topic, "task_id"])


def due_task(tasks: DataFrame, topic: str, as_of: date, offset: Column | None = None) -> DataFrame:
    """The task of each topic that is due: one follow-up of a gap first, then what was tried least,
    longest ago, and next in the day's rotation.

    ``tasks``: topic, task_id, slot, n_tasks, attempts, has_gaps, last_attempt.
    """
    turn = (ordinal_day(F.lit(as_of)) + (F.lit(0) if offset is None else offset)) % F.col("n_tasks")
    followup = (F.col("attempts") == 1) & F.col("has_gaps")
    order = F.struct((~followup).alias("a"), F.col("attempts").alias("b"), F.coalesce("last_attempt", F.lit("")).alias("c"), F.pmod(F.col("slot") - turn, F.col("n_tasks")).alias("d"))
    return tasks.groupBy(topic).agg(F.min_by("task_id", order).alias("task_id"))


def source_of_day(day: Column, sources: list[str], index: Column | None = None) -> Column:
    """The source whose turn it is on a day."""
    at = (ordinal_day(day) + (F.lit(0) if index is None else index)) % len(sources)
    return F.get(F.array(*[F.lit(s) for s in sources]), at.cast("int"))


def product_intents(products: DataFrame, angles: DataFrame) -> DataFrame:
    """Search intents of every product name and alias on every source from every angle.

    ``products``: name, task, aliases, sources; ``angles``: angle, zh, en, role, at most a few.
    X is searched in English, the others in Chinese; a keyword is asked once per source.
    """
    names = products.select("name", "task", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias_no", "alias"), "sources")
    each = names.select("name", "task", "alias_no", "alias", F.explode("sources").alias("source"))
    options = angles.agg(F.collect_list(F.struct("angle", "zh", "en", "role")).alias("_all"))
    rows = each.join(F.broadcast(options)).select("*", F.explode("_all").alias("a"))  # one row on the right
    english = F.col("source") == "twitter"
    keyword = F.concat_ws(" ", "alias", F.when(english, F.col("a.en")).otherwise(F.col("a.zh")))
    rows = rows.withColumn("search_query", keyword)
    return rows.groupBy("source", "search_query").agg(F.min(F.struct("name", "alias_no", "task", F.col("a.angle").alias("angle"), F.col("a.role").alias("role"))).alias("i")).select(
        F.concat(F.lit("product-"), F.substring(F.sha2(F.concat_ws("|", "source", "search_query"), 256), 1, 20)).alias("id"),
        "source", "search_query", F.col("i.name").alias("product"), F.concat_ws(" ", "i.name", "i.task").alias("ranking_query"), F.col("i.angle").alias("angle"), F.col("i.role").alias("evidence_type"),
        F.when(F.col("source") == "twitter", "en").otherwise("zh").alias("language"),
    )
