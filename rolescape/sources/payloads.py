"""Landed JSON, XML and HTML payloads of job boards as job rows.

Each reader takes a DataFrame with a payload column (one response body a row), source_name and company. The network
is no part of the engine: whatever fetches responses lands them, and a run can be repeated over the same bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescape import schemas
from rolescape.functions.dates import rfc822, utc_text
from rolescape.functions.text import first_filled, join_trimmed, salary
from rolescape.sources.html import html_text


def pick(v: Column, *paths: str) -> Column:
    """The first filled value of a variant at some paths, as trimmed text."""
    return first_filled(*[F.trim(F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))) for p in paths])


def items(df: DataFrame, path: str) -> DataFrame:
    """A row for each element of the array at a path of the payload; a malformed payload has none."""
    parsed = F.try_variant_get(F.try_parse_json("payload"), path, "array<variant>")
    keep = [c for c in df.columns if c != "payload"]
    return df.select(*keep, F.posexplode(parsed).alias("item_at", "v"))


def names(v: Column, path: str, key: str) -> Column:
    """The texts under a key of the objects in an array, as an array."""
    return F.transform(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(F.try_variant_get(x, key, "string"), F.lit("")))


def rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Job rows from expressions, those without a title dropped."""
    given = {"source_name": df["source_name"], "company": df["company"]} | columns
    return schemas.conform(df.select(*[c.alias(n) for n, c in given.items()]).where("title <> ''"), schemas.JOB)


def greenhouse(df: DataFrame) -> DataFrame:
    d = items(df, "$.jobs")
    v = d["v"]
    meta = F.transform(F.coalesce(F.try_variant_get(v, "$.metadata", "array<variant>"), F.array().cast("array<variant>")), lambda x: join_trimmed(F.array(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$.value", "string")), ": "))
    url = pick(v, "$.absolute_url")
    return rows(d, {"title": pick(v, "$.title"), "company": first_filled(pick(v, "$.company_name"), d["company"]), "location": pick(v, "$.location.name"), "description": html_text(pick(v, "$.content")), "apply_url": url, "source_url": url, "published_at": pick(v, "$.first_published", "$.updated_at"), "skills_text": join_trimmed(F.concat(names(v, "$.departments", "$.name"), names(v, "$.offices", "$.name"), meta), "; ")})


def lever(df: DataFrame) -> DataFrame:
    d = items(df, "$")
    v = d["v"]
    places = join_trimmed(F.coalesce(F.try_variant_get(v, "$.categories.allLocations", "array<string>"), F.array().cast("array<string>")))
    hosted = pick(v, "$.hostedUrl")
    low, high = F.try_variant_get(v, "$.salaryRange.min", "string"), F.try_variant_get(v, "$.salaryRange.max", "string")
    return rows(d, {"title": pick(v, "$.text"), "location": first_filled(places, pick(v, "$.categories.location")), "description": first_filled(pick(v, "$.descriptionPlain"), html_text(pick(v, "$.description"))), "apply_url": first_filled(pick(v, "$.applyUrl"), hosted), "source_url": hosted, "job_type": join_trimmed(F.array(pick(v, "$.categories.commitment"), pick(v, "$.workplaceType")), "; "), "salary_text": salary(low, high, pick(v, "$.salaryRange.currency"), pick(v, "$.salaryRange.interval")), "skills_text": join_trimmed(F.array(pick(v, "$.categories.team"), pick(v, "$.categories.department")), "; ")})


def smartrecruiters(df: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """List pages, and detail payloads (id, payload) whose values come first."""
    d = items(df, "$.content").withColumn("id", pick(F.col("v"), "$.id"))
    if details is not None:
        d = d.join(details.select(details["id"], F.try_parse_json(details["payload"]).alias("detail")), "id", "left")
    else:
        d = d.withColumn("detail", F.col("v"))
    v, x = d["v"], d["detail"]
    both = lambda *paths: first_filled(pick(x, *paths), pick(v, *paths))
    place = first_filled(both("$.location.fullLocation"), join_trimmed(F.array(both("$.location.city"), both("$.location.region"), both("$.location.country"))))
    posting = both("$.postingUrl", "$.ref")
    sections = F.array(*[pick(x, f"$.jobAd.sections.{s}.text") for s in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")])
    return rows(d, {"title": both("$.name"), "company": first_filled(both("$.company.name"), d["company"]), "location": place, "description": html_text(join_trimmed(sections, "\n")), "apply_url": first_filled(both("$.applyUrl"), posting), "source_url": posting, "published_at": both("$.releasedDate"), "job_type": pick(x, "$.typeOfEmployment.label"), "experience_text": pick(x, "$.experienceLevel.label"), "skills_text": join_trimmed(F.array(pick(x, "$.department.label"), pick(x, "$.function.label")), "; ")})


def oracle_hcm(df: DataFrame) -> DataFrame:
    d = items(df, "$.items[0].requisitionList")
    v = d["v"]
    return rows(d, {"title": pick(v, "$.Title"), "location": pick(v, "$.PrimaryLocation"), "description": html_text(pick(v, "$.ShortDescriptionStr")), "published_at": pick(v, "$.PostedDate"), "closing_at": pick(v, "$.PostingEndDate"), "job_type": pick(v, "$.JobType"), "skills_text": join_trimmed(F.array(pick(v, "$.JobFamily"), pick(v, "$.JobFunction")), "; "), "experience_text": pick(v, "$.Id")})


def workday(df: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Search pages and detail payloads (externalPath, payload); a path found by several searches counts once."""
    d = items(df, "$.jobPostings").withColumn("externalPath", pick(F.col("v"), "$.externalPath"))
    d = d.dropDuplicates(["source_name", "externalPath"])
    if details is not None:
        d = d.join(details.select("externalPath", F.try_variant_get(F.try_parse_json("payload"), "$.jobPostingInfo", "variant").alias("detail")), "externalPath", "left")
    else:
        d = d.withColumn("detail", F.try_parse_json(F.lit("{}")))
    v, x = d["v"], d["detail"]
    number = first_filled(pick(x, "$.jobReqId", "$.jobRequisitionId"), join_trimmed(F.coalesce(F.try_variant_get(v, "$.bulletFields", "array<string>"), F.array().cast("array<string>")), "; "))
    return rows(d, {"title": first_filled(pick(x, "$.title"), pick(v, "$.title")), "location": first_filled(pick(x, "$.location", "$.locationText"), pick(v, "$.locationsText")), "description": html_text(pick(x, "$.jobDescription", "$.description")), "apply_url": first_filled(pick(x, "$.externalUrl", "$.jobPostingUrl"), d["externalPath"]), "source_url": d["externalPath"], "published_at": first_filled(pick(x, "$.startDate", "$.postedOn"), pick(v, "$.postedOn")), "closing_at": pick(x, "$.endDate"), "job_type": join_trimmed(F.array(pick(x, "$.timeType"), pick(x, "$.remoteType"), pick(x, "$.workerType")), "; "), "employment_type": pick(x, "$.timeType"), "experience_text": number, "skills_text": join_trimmed(F.array(pick(x, "$.jobFamily"), pick(x, "$.jobCategory"), number), "; ")})


def rss(df: DataFrame) -> DataFrame:
    """Items of RSS payloads and entries of Atom payloads."""
    keep = [c for c in df.columns if c != "payload"]
    parts = df.select(*keep, F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))).alias("item"))
    one = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{tag}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1), "&amp;", "&"))
    tags = F.regexp_extract_all("item", F.lit(r"(?s)<category\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</category>"), F.lit(1))
    # Atom: terms of categories, links by attribute (the alternate one, else the first), dates as they stand
    terms = F.regexp_extract_all("item", F.lit(r"<category\b[^>]*\bterm=[\"']([^\"']*)"), F.lit(1))
    href = lambda kind: F.replace(F.regexp_extract("item", rf"<link\b(?=[^>]*{kind})[^>]*\bhref=[\"']([^\"']*)", 1), F.lit("&amp;"), F.lit("&"))
    link = first_filled(one("link"), href("rel=[\"']alternate"), href(""))
    return rows(parts, {"title": one("title"), "description": html_text(first_filled(one("summary"), one("description"))), "apply_url": link, "source_url": link, "published_at": first_filled(utc_text(rfc822(one("pubDate"))), one("published"), one("updated")), "skills_text": join_trimmed(F.concat(tags, terms), "; ")})


def sitemap_urls(df: DataFrame) -> DataFrame:
    """Locations of sitemap payloads, and whether the payload is an index of further sitemaps."""
    keep = [c for c in df.columns if c != "payload"]
    return df.select(*keep, F.col("payload").contains("<sitemapindex").alias("is_index"), F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("loc")).distinct()


READERS: dict[str, Callable[..., DataFrame]] = {"greenhouse": greenhouse, "lever": lever, "smartrecruiters": smartrecruiters, "oracle_hcm": oracle_hcm, "workday": workday, "rss": rss}


def read(kind: str, landed: DataFrame, **options: DataFrame) -> DataFrame:
    """Job rows of landed payloads of a registered kind."""
    if kind not in READERS:
        raise ValueError(f"unknown source kind {kind!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](landed, **options)

