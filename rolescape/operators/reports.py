"""Recency reports: shortlist, 48-hour report, daily metrics, digest, recent export, views of the ledger."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolescape.config import Taxonomy
from rolescape.functions.dates import REPORT_FORMATS, iso, parsed, publication_status, since, utc_text
from rolescape.functions.text import collapse, contains_any, first_filled, hits, once, text
from rolescape.functions.urls import identity, is_web
from rolescape.operators.dedup import best_per, best_rows, duplicate_group, group_sizes
from rolescape.operators.matching import city

#: The shortlist's title and closing patterns and excluded statuses.
ROLE = r"(?i)\b(piping|pipe layout|plant layout|e3d|pdms|sp3d|smartplant 3d)\b"
OTHER_ROLE = r"(?i)\b(electrical|civil|structural|instrumentation|software|sales|recruiter|accountant)\b"
CLOSED = r"(?i)position has been closed|job is no longer available|no longer accepting applications|vacancy has been filled|applications are closed|vacancy has now expired|job has expired|position is no longer available|deadline\s+passed"
GONE = ("closed", "expired", "withdrawn", "rejected")
#: The 48-hour report's terms of urgency and seniority.
URGENT = ("urgent", "urgently", "immediate", "immediately", "asap", "join immediately", "immediate joiner", "immediate joining", "short notice", "mobilization", "mobilisation", "walk-in", "walk in", "hiring now", "priority hiring", "hot job", "start immediately", "available immediately")
SENIOR = ("lead", "senior", "sr.", "sr ", "principal", "manager", "head", "area lead", "discipline lead", "checker", "coordinator")
RELEVANT = ("piping", "pipe layout", "plant layout", "e3d", "aveva e3d", "pdms", "sp3d", "smartplant 3d", "smart 3d", "piping designer", "piping engineer", "piping checker", "piping lead", "pipe support", "piping stress", "3d model coordinator")


#: Confidences of a contact that need a look.
UNCERTAIN = ("PUBLIC_UNVERIFIED", "PATTERN_SUGGESTION", "ALERT_SUPPLIED")


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("application_status").isin("expired", "rejected"))


def with_status(jobs: DataFrame, status: str) -> DataFrame:
    return jobs.where(F.col("application_status") == status)


def new_today(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.where(F.startswith(text(F.col("found_at")), F.date_format(as_of, "yyyy-MM-dd")))


def high_priority(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("priority").isin("critical", "high"))


def manual_review(jobs: DataFrame, imports: DataFrame) -> DataFrame:
    """Uncertain contact, flagged for review, or imported from something that needs it."""
    waiting = imports.where("review_required = 1 AND job_key <> ''").select(F.col("job_key").alias("k")).distinct().withColumn("w", F.lit(True))
    return jobs.join(waiting, F.col("job_key") == F.col("k"), "left").where(F.col("contact_confidence").isin(*UNCERTAIN) | (F.col("application_status") == "review_required") | F.col("w")).drop("k", "w")


def direct_contacts(contacts: DataFrame, fallback: DataFrame) -> DataFrame:
    """Contacts with an address; if there is none at all, the fallback's rows."""
    direct = contacts.where(text(F.col("email")) != "")
    there = direct.agg((F.count("*") > 0).alias("there"))
    # one row: whether there is any
    none = fallback.withColumn("_one", F.lit(1)).join(F.broadcast(there.where("NOT there").select(F.lit(1).alias("_one"))), "_one", "left_semi").drop("_one")
    return direct.unionByName(none, allowMissingColumns=True)


def split_places(location: Column) -> Column:
    """The whole text and its parts between / ; | and "and"."""
    return F.concat(F.array(location), F.split(location, r"(?i)\s*(?:/|;|\||\band\b)\s*"))


def shortlist(jobs: DataFrame, taxonomy: Taxonomy, targets: Sequence[str], as_of: Column) -> DataFrame:
    """Open listings of the wanted role in the target cities, one for each URL, newest sighting first to stay."""
    location = first_filled(jobs["location"], jobs["city"])
    url = first_filled(jobs["apply_url"], jobs["source_url"])
    closing, published = parsed(jobs["closing_at"]), parsed(jobs["published_at"])
    cities = F.array_sort(F.array_distinct(F.filter(F.transform(split_places(F.col("location")), lambda p: city(p, taxonomy)), lambda c: c.isin(*targets))))
    status = publication_status(published, as_of)
    wanted = jobs["title"].rlike(ROLE) & ~jobs["title"].rlike(OTHER_ROLE) & ~text(jobs["description"]).rlike(CLOSED) & ~F.lower(text(jobs["application_status"])).isin(*GONE) & (closing.isNull() | (F.to_date(closing) >= F.to_date(as_of))) & is_web(url)
    rows = jobs.where(wanted).select("company", "title", location.alias("location"), text(jobs["published_at"]).alias("published_at"), status.alias("publication_status"), text(jobs["last_seen_at"]).alias("last_seen_at"), F.coalesce(jobs["match_score"].cast("int"), F.lit(0)).alias("match_score"), url.alias("apply_url"), "source_name", F.lit("collected_listing_recheck_before_applying").alias("availability"), identity(first_filled(jobs["canonical_url"], url) if "canonical_url" in jobs.columns else url).alias("identity"), jobs["job_key"])
    # the cities of what the cheap filters keep, once for each row
    rows = once(rows, target_cities=cities)
    best = best_per(rows.where(F.size("target_cities") > 0), "identity", F.desc_nulls_last(parsed(F.col("last_seen_at"))), F.desc("match_score"), "company", "title", "job_key")
    best = best.select("company", "title", "location", "target_cities", *[c for c in best.columns if c not in ("company", "title", "location", "target_cities", "identity", "job_key")])
    return best.orderBy(F.col("publication_status") != "last_30_days", F.desc("match_score"), "company", "title")


def classify(jobs: DataFrame, as_of: Column, hours: int = 48, relevant: Sequence[str] = RELEVANT) -> DataFrame:
    """Relevant rows with date status, urgency, the terms that hit, and seniority."""
    fields = [c for c in ("title", "normalized_role", "description", "experience_text", "skills_text", "software_text", "sector") if c in jobs.columns]
    body = F.lower(F.concat_ws(" ", *[collapse(jobs[c]) for c in fields]))
    published = parsed(jobs["published_at"], REPORT_FORMATS)
    in_window = F.coalesce(published.between(as_of - F.make_interval(hours=F.lit(hours)), as_of + F.make_interval(hours=F.lit(6))), F.lit(False))
    url = first_filled(collapse(jobs["apply_url"]), collapse(jobs["source_url"]))
    # the body is joined once for each row, and the terms looked up once for each relevant one
    rows = once(jobs, _body=body)
    body = F.col("_body")
    rows = once(rows.where(contains_any(body, relevant)), urgent_hits=hits(body, URGENT), relevant_hits=hits(body, relevant), senior_hits=hits(body, SENIOR)).drop("_body")
    return rows.withColumns({
        "identity": first_filled(collapse(jobs["canonical_url"]) if "canonical_url" in jobs.columns else F.lit(""), url, jobs["job_key"]), "url": url,
        "published_iso": utc_text(published), "date_status": F.when(in_window, f"confirmed_{hours}h").when(published.isNull(), "date_unknown").otherwise("older"),
        "urgency": F.when(F.size("urgent_hits") > 0, "urgent").otherwise("normal"),
        "senior_fit": (F.size("senior_hits") > 0) | (F.coalesce(jobs["match_score"], F.lit(0)) >= 70),
    })


def report(classified: DataFrame, hours: int = 48) -> DataFrame:
    """One row of each identity, the confirmed, urgent, best scored and dated first; sorted for the report."""
    confirmed, urgent = F.col("date_status") == f"confirmed_{hours}h", F.col("urgency") == "urgent"
    best = best_per(classified, "identity", F.desc(confirmed), F.desc(urgent), F.desc("match_score"), F.desc(F.col("published_iso") != ""), "company", "title", "job_key")
    return best.orderBy(F.col("urgency") != "urgent", F.col("date_status") != f"confirmed_{hours}h", F.desc("match_score"), "published_iso", "company", "title")


def report_metrics(rows: DataFrame, hours: int = 48) -> DataFrame:
    confirmed, urgent = F.col("date_status") == f"confirmed_{hours}h", F.col("urgency") == "urgent"
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(text(F.col(c))), F.lit("")))), "; ")
    return rows.agg(F.count("*").alias("relevant"), F.count_if(confirmed).alias("confirmed"), F.count_if(confirmed & urgent).alias("confirmed_urgent"), F.count_if((F.col("date_status") == "date_unknown") & urgent).alias("urgent_unknown"), names("country").alias("countries"), names("location").alias("locations"))


def daily_metrics(jobs: DataFrame, health: DataFrame, imports: DataFrame, contacts: DataFrame, messages: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """The 23 metrics as rows (metric, value), each table aggregated on its own.

    Metrics of active jobs count one representative of each duplicate group. messages need a status, companies
    coverage_active and whether they are a gap (coverage_gap).
    """
    live = active(jobs).withColumn("duplicate_group", duplicate_group(jobs))
    sizes, best = group_sizes(live), best_rows(live)
    filled = lambda c: F.nullif(text(F.col(c)), F.lit(""))
    status = F.col("application_status")
    mail = text(F.col("status"))
    parts = [
        jobs.agg(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("generated_at"), F.count("*").alias("raw_source_rows"), *[F.count_if(status == s).alias(s) for s in ("applied", "follow_up", "rejected", "expired")]),
        best.agg(F.count_if(F.startswith(text(F.col("found_at")), F.date_format(as_of, "yyyy-MM-dd"))).alias("new_today"), F.count_if(F.col("priority").isin("critical", "high")).alias("high_priority"), F.count_distinct(filled("country")).alias("countries"), F.count_distinct(filled("company")).alias("companies")),
        sizes.agg(F.count("*").alias("worldwide_deduplicated_jobs"), F.coalesce(F.sum(F.when(F.col("source_count") > 1, F.col("source_count"))), F.lit(0)).alias("duplicate_variant_rows")),
        manual_review(jobs, imports).agg(F.count("*").alias("manual_review")),
        contacts.agg(F.count("*").alias("recruiter_contacts")),
        health.agg(F.count("*").alias("sources_total"), F.count_if(F.col("status").isin("pass", "pass_with_warnings")).alias("sources_passing"), F.count_if(F.col("status") == "fail").alias("sources_failing")),
        messages.agg(F.count("*").alias("gmail_messages"), F.count_if(mail.startswith("complete")).alias("gmail_complete"), F.count_if(mail == "failed").alias("gmail_failed")),
        companies.agg(F.count("*").alias("target_companies"), F.count_if("coverage_active").alias("active_company_coverage"), F.count_if("coverage_gap").alias("company_coverage_gaps")),
    ]
    rows = [df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("string") for c in df.columns]))).alias("metric", "value")) for df in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def top_jobs(jobs: DataFrame, n: int = 100, minimum: int = 0) -> DataFrame:
    return jobs.where(F.col("match_score") >= minimum).orderBy(F.desc("match_score"), F.desc("published_at"), "company", "title", "job_key").limit(n)


def top_names(jobs: DataFrame, column: str, n: int = 5, minimum: int = 80) -> DataFrame:
    """The first n distinct values in score order."""
    best = jobs.where((F.col("match_score") >= minimum) & (text(F.col(column)) != "")).groupBy(column).agg(F.max(F.struct("match_score", "published_at")).alias("r"))
    return best.orderBy(F.desc("r.match_score"), F.desc("r.published_at"), column).limit(n).select(column)


#: The headings of the recent export.
HEADINGS = {"title": "Job Title", "company": "Company", "location": "Location", "country": "Country", "published_at": "Published", "match_score": "Match Score", "priority": "Priority", "apply_url": "Apply URL"}


def recent_export(jobs: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """Rows found or seen in the last days, newest and best first, under the export's headings."""
    rows = jobs.where(since(iso(jobs["found_at"]), as_of, days) | since(iso(jobs["last_seen_at"]), as_of, days)).orderBy(F.desc("found_at"), F.desc("match_score"))
    return rows.select(*[F.col(c).alias(h) for c, h in HEADINGS.items() if c in jobs.columns])


def column_widths(df: DataFrame, rows: int = 200, least: int = 10, most: int = 60) -> DataFrame:
    """The export's column widths, from the headings and the first rows."""
    head = df.limit(rows)
    sizes = head.agg(*[F.max(F.length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.least(F.lit(most), F.greatest(F.lit(least), F.greatest(F.coalesce(F.col(f"`{c}`"), F.lit(0)), F.lit(len(c))) + 2)).alias("width")) for c in df.columns])
    return sizes.select(F.inline(cells))


def pattern(terms: Sequence[str]) -> str:
    return "(?i)\\b(" + "|".join(map(re.escape, terms)) + ")\\b"


def head_per(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The first n rows of each key in an order: a source's head limit."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order, as reports list them."""
    return rows.orderBy(*order).limit(n)
