"""Addresses as columns. Two canonical forms exist, and they don't stand for each other."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Query parameters that track and identify nothing (fixed values).
TRACKING = r"(?i)^(utm_.*|fbclid|gclid)$"
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where there is none."""
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), PARTS, group)


def form_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def form_encode(text: Column) -> Column:
    """Percent-encoding of a query part, with ``~`` plain and ``*`` encoded."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def sorted_query(query: Column) -> Column:
    """The parameters that identify content, sorted and encoded alike; blank values stay."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(form_decode(F.substring_index(p, "=", 1)).alias("k"), form_decode(F.regexp_extract(p, "=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"]))), "&")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(part(url, 2), "^.*@", ""), r"^([^:]*)", 1))


def evidence_url(url: Column) -> Column:
    """The address of evidence: https, no www, default port, fragment, last slash or tracking.

    Empty for what is no web address.
    """
    port = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    shown = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    query = sorted_query(part(url, 4))
    whole = F.concat(
        F.lit("https://"),
        F.regexp_replace(host(url), r"^www\.", ""),
        shown,
        F.regexp_replace(part(url, 3), "/+$", ""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(F.lower(part(url, 1)).isin("http", "https") & (host(url) != ""), whole).otherwise("")


def content_url(url: Column) -> Column:
    """The weaker form: keeps scheme, www, port and fragment, and drops tracking alone."""
    query = sorted_query(part(url, 4))
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    whole = F.concat(
        F.lower(part(url, 1)),
        F.lit("://"),
        F.lower(part(url, 2)),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise(""),
    )
    return F.when(part(url, 1) != "", whole).otherwise(F.coalesce(url, F.lit("")))


def x_post_id(url: Column) -> Column:
    """The post that an address on x.com or twitter.com names; null for others."""
    site = F.regexp_replace(host(url), r"^(www|mobile|m)\.", "")
    found = F.regexp_extract(part(url, 3), r"^/(?:i/web|i|[A-Za-z0-9_]{1,15})/status(?:es)?/(\d+)", 1)
    return F.when(site.isin("x.com", "twitter.com") & (found != ""), found)


@F.pandas_udf(BooleanType())
def _global_host(hosts: pd.Series) -> pd.Series:
    def ok(name: str | None) -> bool:
        try:
            return ipaddress.ip_address((name or "").strip("[]")).is_global
        except ValueError:
            return bool(name) and "." in name and not name.endswith((".local", ".internal", ".localhost", ".lan"))

    return hosts.map(ok)


def public_url(url: Column) -> Column:
    """``url`` if it can be shown: web, no credentials, a public host; else null."""
    web = F.lower(part(url, 1)).isin("http", "https") & ~part(url, 2).contains("@")
    return F.when(web & _global_host(host(url)), F.trim(url))


def source_key(url: Column, publisher: Column) -> Column:
    """Who stands behind an address: the publisher if named, else the host."""
    return F.when(publisher != "", F.concat(F.lit("publisher:"), publisher)).otherwise(F.concat(F.lit("host:"), F.regexp_replace(host(url), r"^www\.", "")))


def is_url(text: str) -> bool:
    """Driver-side check of one address."""
    return urlsplit(text).scheme in ("http", "https")
