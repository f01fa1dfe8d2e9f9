"""URL expressions, written with regular expressions so that malformed input never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.arrays import let


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Network location as written, port included (the `domain` of a page)."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-cased host without user info and port."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def apex(host_name: Column) -> Column:
    """Lower case without a leading `www.`."""
    return F.regexp_replace(F.lower(host_name), r"^www\.", "")


def without_query(url: Column) -> Column:
    """Reference-list key: no query, no fragment, trailing slash kept."""
    return F.regexp_replace(url, r"[?#].*$", "")


def base_url(url: Column) -> Column:
    """Result-dedup key: no query, no fragment, no trailing slash."""
    return F.regexp_replace(without_query(url), r"/+$", "")


def slash_variant(url: Column) -> Column:
    """The same key with the trailing slash toggled."""
    return F.when(url.endswith("/"), F.regexp_replace(url, r"/$", "")).otherwise(F.concat(url, F.lit("/")))


def host_suffixes(host_name: Column) -> Column:
    """`a.b.c` -> [a.b.c, b.c, c]: every name a suffix rule could be written for."""
    def suffixes(labels: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )

    return let(F.split(host_name, r"\."), suffixes)


def host_matches(host_name: Column, domain: Column) -> Column:
    """Host equals the domain or lies below it."""
    return (host_name == domain) | host_name.endswith(F.concat(F.lit("."), domain))
