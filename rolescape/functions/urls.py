"""URL column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolescape.functions.text import text

#: Query parameters that only track.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(text(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    """Host with port and user, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(text(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(text(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(text(url), r"^[^?#]*\?([^#]*)", 1)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def encoded(c: Column) -> Column:
    """Form encoding in which * is escaped and ~ is not."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, trailing slash or tracking parameters, query sorted and re-encoded."""
    u = F.trim(text(url))
    pairs = F.transform(
        F.filter(F.split(query(u), "&"), lambda p: p.contains("=") | (p != "")),
        lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), decoded(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING) & ~F.lower(p["k"]).startswith("utm_")))
    q = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    p = F.rtrim(path(u), F.lit("/"))
    body = F.concat(scheme(u), F.lit("://"), authority(u), F.when(p == "", "/").otherwise(p))
    return F.when(u == "", "").otherwise(F.when(q == "", body).otherwise(F.concat(body, F.lit("?"), q)))


def identity(url: Column) -> Column:
    """The URL without fragment and trailing slashes."""
    return F.rtrim(F.substring_index(text(url), "#", 1), F.lit("/"))


def is_web(url: Column) -> Column:
    """http or https with a host."""
    return scheme(url).isin("http", "https") & (host(url) != "")


def in_domains(url: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one; no domains, no URL passes."""
    h, found = host(url), F.lit(False)
    for d in domains:
        d = d.lower().strip(".")
        found = found | (h == d) | h.endswith("." + d)
    return found


def is_public(url: Column) -> Column:
    """https, no credentials, and no local or private address as host."""
    h = host(url)
    private = h.rlike(r"^(localhost|.*\.local|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|0\..*|\[.*\])$")
    return (scheme(url) == "https") & (h != "") & ~authority(url).contains("@") & ~private


def first_url(c: Column) -> Column:
    """The first web URL of a text, trailing punctuation dropped."""
    return F.regexp_replace(F.regexp_extract(text(c), r"https?://[^\s<>\"']+", 0), r"[.,);\]]+$", "")


def unwrapped(url: Column) -> Column:
    """The target of a search-engine redirect (parameters q or url), else the URL."""
    param = lambda name: F.nullif(decoded(F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]*)", 1)), F.lit(""))
    wrapped = host(url).rlike(r"(^|\.)google\.[a-z.]+$") & (path(url) == "/url")
    return F.when(wrapped, F.coalesce(param("q"), param("url"), url)).otherwise(url)


def matches_pattern(url: Column, patterns: Sequence[str]) -> Column:
    """Any pattern as substring, ignoring case; no patterns pass all."""
    found = F.lit(not patterns)
    for p in patterns:
        found = found | F.lower(text(url)).contains(p.lower())
    return found
