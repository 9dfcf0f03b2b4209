"""Stable identifiers and digests as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import identity_text
from lodestone.functions.urls import evidence_url


def canonical_json(document: Column) -> Column:
    """JSON with sorted keys and no blanks; nulls stay. For documents without fractions."""
    return F.to_json(F.try_parse_json(document))


def canonical_sha256(document: Column) -> Column:
    return F.sha2(canonical_json(document), 256)


def content_sha256(document: Column, metadata: list[str]) -> Column:
    """Digest of a JSON object without its metadata keys, whatever the order of keys."""
    fields = F.from_json(document, "map<string, variant>")
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*metadata))
    text = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws(":", F.to_json(F.struct(e["key"].alias("k"))), F.coalesce(F.to_json(e["value"]), F.lit("null")))))
    return F.sha2(F.array_join(text, ","), 256)


def request_fingerprint(source: Column, endpoint: Column, method: Column, params: Column) -> Column:
    """Digest of a request; ``params`` is map<string,string>, and null values count as absent."""
    known = F.array_sort(F.map_entries(F.map_filter(params, lambda _, v: v.isNotNull())))
    text = F.array_join(F.transform(known, lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    return F.sha2(F.concat_ws("|", source, endpoint, F.upper(method), text), 256)


def fingerprint(*parts: Column) -> Column:
    """The first 20 digits of the digest of normalised parts; blank parts are left out."""
    texts = F.array_compact(F.array(*[F.nullif(identity_text(p), F.lit("")) for p in parts]))
    return F.substring(F.sha2(F.array_join(texts, "|"), 256), 1, 20)


def prefixed(prefix: str, key: Column, digits: int = 10) -> Column:
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(key, 256), 1, digits)))


def object_key(source: Column, kind: Column, native: Column, url: Column, original: Column) -> Column:
    """The key of what a record shows: its native object, else its address; null if neither.

    A repost that names another original address is keyed by that address.
    """
    repost = (evidence_url(original) != "") & (evidence_url(original) != evidence_url(url))
    shown = F.lower(F.coalesce(kind, F.lit("")))
    kind_ = F.when(shown.isin("comment", "reply"), "comment").when(shown.isin("", "post_detail"), "post").otherwise(shown)
    by_object = F.concat_ws(":", F.lit("object"), F.lower(source), kind_, native)
    named = native.isNotNull() & (native != "") & source.isNotNull() & (source != "")
    return F.when(named & ~repost, by_object).otherwise(F.nullif(evidence_url(F.coalesce(original, url)), F.lit("")))


def version_key(version: Column) -> Column:
    """``1.2`` as a sortable array of four numbers; null if it is no version."""
    parts = F.transform(F.split(version, r"\."), lambda p: p.cast("int"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)
    return F.when(version.rlike(r"^\d+(\.\d+){0,3}$"), padded)
