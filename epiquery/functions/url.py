"""URL rules: where a link leads and how it is to be fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.when(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1) != "", F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_value(url: Column, name: str) -> Column:
    got = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(got != "", F.try_url_decode(got))


def valid_host(url: Column) -> Column:
    """A host with a dot that is followed by something other than digits."""
    return F.coalesce(host(url).rlike(r"^.+\.\D+"), F.lit(False))


def unwrapped(url: Column) -> Column:
    """The target of a news search link, else the link itself."""
    return F.when(F.contains(host(url), F.lit("news.google.com")), F.coalesce(query_value(url, "url"), url)).otherwise(url)


def followed(url: Column, redirects: Column, most: int = 3) -> Column:
    """Where a link leads: the last of its redirects, and out of news search links, up to `most` of them one inside another."""
    out = F.coalesce(F.get(redirects, F.size(redirects) - 1)["url"], url)
    for _ in range(most):
        out = unwrapped(out)
    return out


def route(url: Column) -> Column:
    """How a link is fetched; the rules apply in this order."""
    h = host(url)
    return (
        F.when(url.isNull(), "none")
        .when(path(url).endswith(".pdf"), "unscrapable")
        .when(h.isNull(), "unscrapable")
        .when(h.contains("promed"), "post")
        .when(h.contains("empres-i.fao.org") | h.contains("twitter.com"), "unscrapable")
        .when(h.contains("news.google.com"), "unwrap")
        .otherwise("fetch")
    )


def post_id(url: Column) -> Column:
    got = F.regexp_extract(url, r"(id=|/post/)(\d+\.?\d*)", 2)
    return F.when(got != "", got)
