"""Discovery of sources: candidate links, identities of sources, and what is new among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescape.functions.text import contains_any, folded, text
from rolescape.functions.urls import host, is_web, path, path_parts
from rolescape.operators.dedup import first_seen

#: Hosts of recruiting systems, hints of posting URLs, and hints of pages that hold contacts.
ATS_HOSTS = ("greenhouse.io", "lever.co", "smartrecruiters.com", "myworkdayjobs.com", "oraclecloud.com")
JOB_URL_HINTS = ("/job/", "/jobs/", "/career/", "/careers/", "jobid=", "job_id=")
#: The fields that identify a source of each type; the others are known by URL or id.
IDENTITY = {"greenhouse": ("board_token",), "lever": ("region", "site"), "smartrecruiters": ("company_identifier",), "workday": ("base_url", "tenant", "site"), "oracle_hcm": ("base_url", "site_number"), "sitemap": ("url",)}


def is_candidate(url: Column) -> Column:
    """A web link to a recruiting system's host, or one that looks like a posting."""
    return is_web(url) & (contains_any(host(url), ATS_HOSTS) | contains_any(F.lower(text(url)), JOB_URL_HINTS))


def candidates(links: DataFrame, url: str, page: str, order: str, limit: int = 120) -> DataFrame:
    """The first `limit` distinct candidate links of each page, without fragments, in order."""
    from pyspark.sql import Window

    found = links.where(is_candidate(F.col(url))).withColumn(url, F.substring_index(url, "#", 1))
    once = first_seen(found, [page, url], order)
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy(order))).where(F.col("_n") <= limit).drop("_n")


def is_hinted(url: Column, anchor: Column, hints: tuple[str, ...]) -> Column:
    """A web link whose path or text holds a hint, or a PDF; no mail, phone or script links."""
    told = F.lower(F.concat_ws(" ", path(url), text(anchor)))
    return is_web(url) & (contains_any(told, hints) | F.lower(path(url)).endswith(".pdf"))


def source_identity(sources: DataFrame) -> Column:
    """The identity of a source row (type and fields as columns), as type and lower-cased key with a line break between."""
    field = lambda c: text(F.col(c)) if c in sources.columns else F.lit("")
    kind = field("type")
    key = None
    for name, fields in IDENTITY.items():
        parts = [F.coalesce(F.nullif(field(c), F.lit("")), F.lit("global")) if (name, c) == ("lever", "region") else field(c) for c in fields]
        made = F.concat_ws(":", *parts)
        key = F.when(kind == name, made) if key is None else key.when(kind == name, made)
    rest = F.coalesce(F.nullif(field("url"), F.lit("")), field("id"))
    return F.concat_ws("\n", kind, F.lower(key.otherwise(rest)))


def new_sources(found: DataFrame, known: DataFrame, covered: DataFrame, order: str) -> DataFrame:
    """Found sources (identity, company) whose identity isn't known and whose company isn't covered; each identity once."""
    name = folded(F.col("company"))
    fresh = found.join(known.select("identity").distinct(), "identity", "left_anti").withColumn("_c", name)
    return first_seen(fresh.join(covered.select(name.alias("_c")).distinct(), "_c", "left_anti").drop("_c"), ["identity"], order)


def totals(records: DataFrame) -> DataFrame:
    """Detected and verified sources, and the postings that probes saw."""
    return records.agg(F.count("*").alias("detected"), F.count_if(F.col("probe_status") == "verified").alias("verified"), F.coalesce(F.sum("probe_jobs"), F.lit(0)).cast("long").alias("probe_jobs"))


def detected(url: Column) -> Column:
    """struct(type, board_token, region, site, company_identifier, base_url, tenant, site_number) of the recruiting system
    that a URL belongs to; an empty type for other URLs."""
    h, parts = host(url), path_parts(url)
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    localized = at(0).rlike("^[a-z]{2}(-[A-Z]{2})?$")
    board = F.when(localized, at(1)).otherwise(at(0))
    company = F.when(h == "api.smartrecruiters.com", F.regexp_extract(path(url), "/v1/companies/([^/]+)/postings", 1)).otherwise(at(0))
    oracle = F.regexp_extract(path(url), "/sites/([^/?#]+)", 1)
    kind = (
        F.when(h.isin("boards.greenhouse.io", "job-boards.greenhouse.io") & (at(0) != ""), "greenhouse")
        .when(h.isin("jobs.lever.co", "jobs.eu.lever.co") & (at(0) != ""), "lever")
        .when(h.isin("jobs.smartrecruiters.com", "api.smartrecruiters.com") & (company != ""), "smartrecruiters")
        .when(h.endswith(".myworkdayjobs.com") & (board != ""), "workday")
        .when(h.endswith(".oraclecloud.com") & (oracle != ""), "oracle_hcm")
        .otherwise("")
    )
    only = lambda name, c: F.when(kind == name, c).otherwise("")
    return F.struct(
        kind.alias("type"), only("greenhouse", at(0)).alias("board_token"), only("lever", F.when(h.startswith("jobs.eu."), "eu").otherwise("global")).alias("region"),
        F.when(kind == "lever", at(0)).when(kind == "workday", board).otherwise("").alias("site"), only("smartrecruiters", company).alias("company_identifier"),
        F.when(kind.isin("workday", "oracle_hcm"), F.concat(F.lit("https://"), h)).otherwise("").alias("base_url"), only("workday", F.substring_index(h, ".", 1)).alias("tenant"), only("oracle_hcm", oracle).alias("site_number"),
    )


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all discovery reports below a folder (JSON objects with a list "records"), with their defaults;
    files that are no such JSON give none."""
    v = F.try_parse_json("value")
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(folder)
    rows = rows.select(F.explode(F.try_variant_get(v, "$.records", "array<variant>")).alias("r")).where(F.schema_of_variant("r").startswith("OBJECT"))
    one = lambda name, default="": F.coalesce(F.try_variant_get("r", f"$.{name}", "string"), F.lit(default)).alias(name)
    source = F.coalesce(F.to_json(F.try_variant_get("r", "$.source", "variant")), F.lit("{}")).alias("source")
    return rows.select(one("company"), one("platform"), one("evidence_url"), source, one("confidence", "candidate"), one("probe_status", "not_probed"), F.coalesce(F.try_variant_get("r", "$.probe_jobs", "int"), F.lit(0)).alias("probe_jobs"), one("error"))
