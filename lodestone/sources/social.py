"""Search responses of social sources as rows of evidence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean_text, language
from lodestone.functions.times import any_date, relative_interval
from lodestone.functions.urls import evidence_url


@dataclass(frozen=True)
class Format:
    """Where a source keeps its items and their fields; of several paths the first with a value counts."""

    lists: tuple[str, ...]
    items: tuple[str, ...] = ("$",)
    id: tuple[str, ...] = ("$.id",)
    title: tuple[str, ...] = ("$.title",)
    text: tuple[str, ...] = ("$.text",)
    author: tuple[str, ...] = ("$.author",)
    date: tuple[str, ...] = ("$.created_at",)
    language: tuple[str, ...] = ("$.language",)
    url: tuple[str, ...] = ("$.url",)
    link: str = ""
    noise: str = ""
    counts: dict[str, tuple[str, ...]] = field(default_factory=dict)


#: Response formats by source (fixed values).
FORMATS = {
    "tiktok": Format(
        ("$.search_item_list",), ("$.aweme_info",), ("$.aweme_id",), ("$.item_title", "$.preview_title"), ("$.desc", "$.search_desc", "$.content_desc"),
        ("$.author.unique_id", "$.author.nickname"), ("$.create_time",), ("$.desc_language",), ("$.share_url", "$.share_info.share_url"),
        counts={"likes": ("$.statistics.digg_count",), "comments": ("$.statistics.comment_count",), "shares": ("$.statistics.share_count",), "views": ("$.statistics.play_count",), "saves": ("$.statistics.collect_count",)},
    ),
    "douyin": Format(
        ("$.business_data",), ("$.data.aweme_info",), ("$.aweme_id",), ("$.item_title", "$.preview_title"), ("$.desc", "$.search_desc", "$.content_desc"),
        ("$.author.unique_id", "$.author.nickname"), ("$.create_time",), ("$.desc_language",), ("$.share_url", "$.share_info.share_url"),
        counts={"likes": ("$.statistics.digg_count",), "comments": ("$.statistics.comment_count",), "shares": ("$.statistics.share_count",), "views": ("$.statistics.play_count",), "saves": ("$.statistics.collect_count",)},
    ),
    "instagram": Format(
        ("$.data.items",), id=("$.id", "$.code"), text=("$.caption.text", "$.caption"), author=("$.user.username", "$.user.full_name"), date=("$.taken_at", "$.taken_at_date"),
        language=("$.language", "$.text_language", "$.video_subtitles_locale"), url=(), link="https://www.instagram.com/p/{$.code}/",
        counts={"likes": ("$.like_count",), "comments": ("$.comment_count",), "shares": ("$.share_count",), "views": ("$.play_count", "$.view_count"), "reposts": ("$.repost_count",)},
    ),
    "linkedin": Format(
        ("$.data",), title=(), text=("$.title",), author=("$.author.name", "$.author"),
        counts={"likes": ("$.activity.numLikes", "$.activity.likes", "$.activity.like_count"), "comments": ("$.activity.numComments", "$.activity.comments", "$.activity.comment_count"), "shares": ("$.activity.numShares", "$.activity.shares", "$.activity.share_count")},
    ),
    "threads": Format(
        ("$.searchResults.edges",), ("$.node", "$.thread_items[0].post", "$"), ("$.id", "$.pk"), (), ("$.text", "$.caption.text", "$.caption"), ("$.user.username", "$.username"),
        ("$.taken_at", "$.created_at"), ("$.text_language",), ("$.url", "$.permalink"), "https://www.threads.net/@{$.user.username}/post/{$.id}",
        counts={"likes": ("$.like_count", "$.likes"), "comments": ("$.reply_count", "$.comment_count"), "reposts": ("$.repost_count",), "quotes": ("$.quote_count",)},
    ),
    "twitter": Format(
        ("$.timeline",), id=("$.tweet_id",), title=(), author=("$.screen_name",), language=("$.lang",), url=(), link="https://x.com/{$.screen_name}/status/{$.tweet_id}",
        counts={"likes": ("$.favorites",), "comments": ("$.replies",), "reposts": ("$.retweets",), "quotes": ("$.quotes",), "views": ("$.views",), "saves": ("$.bookmarks",)},
    ),
    "youtube": Format(
        ("$.videos",), id=("$.video_id",), text=("$.description",), date=("$.published_at", "$.published_time", "$.publishedTimeText", "$.published_time_text", "$.publishedTime"),
        url=(), link="https://www.youtube.com/watch?v={$.video_id}", counts={"views": ("$.number_of_views",)},
    ),
    "reddit": Format(
        ("$.search.dynamic.components.main.edges",), ("$.node", "$.post", "$.data"), ("$.id", "$.name"), ("$.title", "$.postTitle"), ("$.selftext", "$.body", "$.content.markdown"),
        ("$.author.name", "$.author"), ("$.created_utc", "$.created", "$.createdAt"), ("$.lang",), ("$.url",), "https://www.reddit.com{$.permalink}", "$.presentation.type",
        {"likes": ("$.score", "$.ups"), "comments": ("$.num_comments",), "shares": ("$.num_crossposts",)},
    ),
    "xiaohongshu": Format(
        ("$.data.items",), ("$.note",), text=("$.desc",), author=("$.user.nickname", "$.user.name", "$.user.user_id"), date=("$.timestamp", "$.time"),
        url=(), link="https://www.xiaohongshu.com/explore/{$.id}",
        counts={"likes": ("$.liked_count",), "comments": ("$.comments_count",), "shares": ("$.shared_count",), "saves": ("$.collected_count",)},
    ),
    "bilibili": Format(
        ("$.result", "$.data.result"), id=("$.bvid", "$.bv_id", "$.aid"), text=("$.description", "$.desc"), author=("$.author", "$.up_name"), date=("$.pubdate", "$.created"),
        url=("$.arcurl",), link="https://www.bilibili.com/video/{$.bvid}",
        counts={"views": ("$.play", "$.view"), "likes": ("$.like",), "comments": ("$.review", "$.comment"), "shares": ("$.share",), "saves": ("$.favorites",)},
    ),
    "zhihu": Format(
        ("$.data",), ("$.object",), title=("$.title", "$.question.title"), text=("$.excerpt", "$.description", "$.content"), author=("$.author.name", "$.author.headline"),
        date=("$.created_time",), noise="$.query_list", counts={"likes": ("$.voteup_count",), "comments": ("$.comment_count",), "saves": ("$.favorites_count",), "views": ("$.visits_count",)},
    ),
    "wechat_search": Format(("$.items",), id=("$.docID", "$.id"), text=("$.desc",), author=("$.source",), date=("$.timestamp", "$.date"), url=("$.doc_url", "$.url")),
    "hackernews": Format(
        ("$.hits",), id=("$.objectID",), text=("$.story_text", "$.title"), link="https://news.ycombinator.com/item?id={$.objectID}",
        counts={"points": ("$.points",), "comments": ("$.num_comments",)},
    ),
    "github": Format(
        ("$.items",), text=("$.body", "$.title"), author=("$.user.login",), url=("$.html_url",), counts={"comments": ("$.comments",), "reactions": ("$.reactions.total_count",)},
    ),
}


def first_text(item: Column, paths: tuple[str, ...]) -> Column:
    """The first of several paths that holds a non-blank scalar."""
    found = [F.nullif(F.trim(F.try_variant_get(item, p, "string")), F.lit("")) for p in paths]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def number(item: Column, paths: tuple[str, ...]) -> Column:
    """A count that may be text with thousands separators; null for anything else."""
    return F.regexp_replace(first_text(item, paths), ",", "").try_cast("double")


def link(item: Column, template: str) -> Column:
    """An address of fixed text and fields in braces; null if any field is missing."""
    parts, rest = [], template
    while rest:
        text, _, rest = rest.partition("{")
        path, _, rest = rest.partition("}")
        parts += [F.lit(text), *([first_text(item, (path,))] if path else [])]
    return F.concat(*parts) if parts else F.lit(None).cast("string")


def listed(responses: DataFrame, source: str) -> DataFrame:
    """Each list entry of a source's responses; ``recognised`` responses have a known list."""
    f = FORMATS[source]
    v = F.try_parse_json("response")
    rows = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in f.lists])
    return responses.where(F.col("source") == source).withColumn("_rows", rows)


def normalised(responses: DataFrame) -> DataFrame:
    """Rows of evidence of all responses.

    ``responses``: source, request_id, query_group, observed_at (day), response (JSON text).
    Dates that are relative give an interval of days instead of a time; items without text and
    title, or without an id, come with a warning and are kept.
    """
    parts = []
    for source, f in FORMATS.items():
        entries = listed(responses, source).select("source", "request_id", "query_group", "observed_at", F.posexplode("_rows").alias("item_no", "e"))
        item = F.coalesce(*[F.try_variant_get("e", p, "variant") for p in f.items])
        rows = entries.withColumn("i", item).where("i is not null")
        i, raw = F.col("i"), first_text(F.col("i"), f.date)
        key = first_text(i, f.id)
        key = F.regexp_replace(key, "^t3_", "") if source == "reddit" else key
        url = F.coalesce(first_text(i, f.url), link(i, f.link)) if source != "reddit" else F.coalesce(link(i, f.link), first_text(i, f.url))
        counts = [F.struct(F.lit(n).alias("k"), number(i, p).alias("v")) for n, p in f.counts.items()]
        engagement = F.map_from_entries(F.filter(F.array(*counts), lambda x: x["v"].isNotNull())) if counts else F.create_map().cast("map<string,double>")
        title, text = clean_text(first_text(i, f.title), 500), clean_text(first_text(i, f.text), 4000)
        parts.append(
            rows.select(
                F.concat_ws(":", "source", key).alias("id"), "source", key.alias("source_item_id"), "request_id", "query_group", "item_no",
                F.nullif(title, F.lit("")).alias("title"), F.coalesce(F.nullif(text, F.lit("")), F.nullif(title, F.lit(""))).alias("original_text"),
                first_text(i, f.author).alias("author"), url.alias("url"), language(F.concat_ws(" ", title, text), first_text(i, f.language)).alias("language"),
                any_date(raw).alias("published_at"), F.when(any_date(raw).isNull(), relative_interval(raw, F.col("observed_at"))).alias("published_at_interval"),
                engagement.cast("map<string,double>").alias("engagement"),
            )
        )
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    warnings = F.array_compact(F.array(
        F.when(F.col("source_item_id").isNull(), "no id"), F.when(F.col("original_text").isNull(), "no text"),
        F.when(evidence_url(F.col("url")) == "", "no address"), F.when(F.col("published_at").isNull() & F.col("published_at_interval").isNull(), "no date"),
    ))
    return found.withColumn("warnings", warnings)


def _counts(f: Format) -> tuple[Column, Column]:
    """Of an array ``_rows``: entries with an id, and entries that hold no content by design."""

    def item(e: Column) -> Column:
        return F.coalesce(*[F.try_variant_get(e, p, "variant") for p in f.items])

    def parsed(e: Column) -> Column:
        return item(e).isNotNull() & first_text(item(e), f.id).isNotNull()

    def noise(e: Column) -> Column:
        return F.try_variant_get(e, f.noise, "variant").isNotNull() & item(e).isNull()

    none = F.lit(0)
    skipped = F.coalesce(F.size(F.filter("_rows", noise)), none) if f.noise else none
    return F.coalesce(F.size(F.filter("_rows", parsed)), none), skipped


def parse_status(responses: DataFrame) -> DataFrame:
    """By request: raw and parsed items and parsed, partial_parse, empty_result or unrecognized_response."""
    parts = []
    for source, f in FORMATS.items():
        parsed, skipped = _counts(f)
        known = F.col("_rows").isNotNull().alias("known")
        size = F.coalesce(F.size("_rows"), F.lit(0)).alias("all")
        parts.append(listed(responses, source).select("source", "request_id", known, size, parsed.alias("parsed_items"), skipped.alias("skipped_items")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    raw = F.when(F.col("known"), F.col("all") - F.col("skipped_items"))
    n = F.when(F.col("known"), F.col("parsed_items")).otherwise(0)
    status = F.when((n > 0) & (n >= raw), "parsed").when(n > 0, "partial_parse").when(F.col("known") & (raw == 0), "empty_result").otherwise("unrecognized_response")
    return found.select("source", "request_id", raw.alias("raw_items"), n.alias("parsed_items"), F.when(F.col("known"), F.col("skipped_items")).otherwise(0).alias("skipped_items"), status.alias("parse_status"))


def comment_tree(spark, payloads: DataFrame, depth: int = 24) -> DataFrame:
    """Nested comments as rows: payload_id, id, parent_id, depth, text, author, created_at.

    ``payloads``: payload_id, response (JSON with nested ``children``). Each level is one explode
    of the level before; dead and deleted comments go, their replies stay.
    """
    level = payloads.select("payload_id", F.lit(None).cast("string").alias("parent_id"), F.explode(F.try_variant_get(F.try_parse_json("response"), "$.children", "array<variant>")).alias("c"))
    parts = []
    for d in range(1, depth + 1):
        key = F.try_variant_get("c", "$.id", "string")
        parts.append(level.select(
            "payload_id", key.alias("id"), "parent_id", F.lit(d).alias("depth"), clean_text(F.try_variant_get("c", "$.text", "string")).alias("text"),
            F.try_variant_get("c", "$.author", "string").alias("author"), any_date(F.try_variant_get("c", "$.created_at", "string")).alias("created_at"),
            F.coalesce(F.try_variant_get("c", "$.deleted", "boolean"), F.try_variant_get("c", "$.dead", "boolean"), F.lit(False)).alias("gone"),
        ))
        level = level.select("payload_id", key.alias("parent_id"), F.explode(F.try_variant_get("c", "$.children", "array<variant>")).alias("c"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.where(~F.col("gone") & F.col("id").isNotNull() & (F.col("text") != "")).drop("gone")
