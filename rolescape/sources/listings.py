"""Listing scans over landed pages: job links with the facts that their texts tell, and the robots gate over landed rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescape import schemas
from rolescape.functions import notices
from rolescape.functions.text import collapse, first_filled, text
from rolescape.functions.urls import host, in_domains, is_web, matches_pattern, origin
from rolescape.operators.dedup import first_seen
from rolescape.sources.html import links as page_links

#: The kinds of employment that end a listing's text.
JOB_TYPES = ("Full Time", "Part Time", "Contract", "Temporary")


def title(c: Column) -> Column:
    """The listing's text before its job number."""
    return F.trim(F.element_at(F.split(text(c), r"(?i)\bJob ID\s*:"), 1))


def location(c: Column) -> Column:
    """What stands between the job number and the kind of employment at the end."""
    return F.trim(F.regexp_extract(text(c), rf"(?i)Job ID\s*:\s*#?\S+\s+(.+?)\s+(?:{'|'.join(JOB_TYPES)})$", 1))


def job_type(c: Column) -> Column:
    """The first kind of employment, in their order, that the text names."""
    found = F.lit("")
    for kind in reversed(JOB_TYPES):
        found = F.when(text(c).rlike(rf"(?i)\b{kind}\b"), kind).otherwise(found)
    return found


def absolute(base: Column, href: Column) -> Column:
    """A link resolved against its page."""

    @F.pandas_udf("string")
    def joined(b, h):
        return h.combine(b, lambda x, y: _joined(y, x))

    return joined(text(base), text(href))


def _joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return ""


def scan(pages: DataFrame, key: str, url: str, markup: str, link_patterns: Sequence[str], domains: Sequence[str] = (), include: Sequence[str] = (), required: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    """key, position, url, anchor of a listing's job links, each URL of a page once.

    A link counts on an allowed host (without domains: the page's own), with one of the patterns in its URL, and with a
    text that passes the anchor filters. Other schemes and links that can't be resolved are left out.
    """
    found = page_links(pages, key, markup).join(pages.select(key, F.col(url).alias("_page")), key)
    found = found.withColumn("url", F.substring_index(absolute(F.col("_page"), F.col("href")), "#", 1))
    own = in_domains(F.col("url"), domains) if domains else host(F.col("url")) == host(F.col("_page"))
    kept = found.where(is_web(F.col("url")) & own & matches_pattern(F.col("url"), link_patterns) & notices.anchor_passes(F.col("anchor"), include, required, excluded))
    return first_seen(kept, [key, "url"], "position").select(key, "position", "url", "anchor")


def jobs(found: DataFrame, source_name: str, company: str, details: DataFrame | None = None) -> DataFrame:
    """Postings of listed links; a detail row (url and job columns) comes first, the listing's text fills what it lacks."""
    a = F.col("anchor")
    told = {"title": title(a), "location": location(a), "job_type": job_type(a), "description": collapse(a)}
    df = found if details is None else found.join(details.select(F.col("url"), *[F.col(c).alias(f"_{c}") for c in told if c in details.columns]), "url", "left")
    named = {c: first_filled(F.col(f"_{c}"), x) if f"_{c}" in df.columns else x for c, x in told.items()}
    named |= {"company": F.lit(company), "source_name": F.lit(source_name), "apply_url": F.col("url"), "source_url": F.col("url")}
    return schemas.conform(df.select(*[c.alias(n) for n, c in named.items()]).where("title <> ''"), schemas.JOB)


def permitted(requests: DataFrame, url: str, robots: DataFrame, agent: str, deny_on_error: bool = True) -> DataFrame:
    """requests whose URL the landed robots.txt of its origin permits (robots: origin, status_code, body).

    A status of 404 permits all; any other failure, and an origin whose file hasn't landed, is denied or permitted as
    deny_on_error says.
    """
    rules = robots.groupBy("origin").agg(F.max_by(F.struct("status_code", "body"), "status_code").alias("r")).select(F.col("origin").alias("_origin"), F.col("r.status_code").alias("_status"), F.col("r.body").alias("_body"))
    joined = requests.withColumn("_at", origin(F.col(url))).join(rules, F.col("_at") == F.col("_origin"), "left").drop("_at", "_origin")

    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, RobotFileParser] = {}
        for batch in batches:
            keep = []
            for u, status, body in zip(*(batch.column(c).to_pylist() for c in (url, "_status", "_body")), strict=True):
                if status == 200:
                    if body not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[body] = RobotFileParser()
                        known[body].parse((body or "").splitlines())
                    keep.append(known[body].can_fetch(agent, u or ""))
                else:
                    keep.append(status == 404 or not deny_on_error)
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return joined.mapInArrow(run, requests.schema)
