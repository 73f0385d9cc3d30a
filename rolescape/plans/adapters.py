"""The driver's tables in the shapes of the engine, and the same shapes as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescape import schemas
from rolescape.config import Profile, Taxonomy
from rolescape.operators.coverage import STATUSES

AS_OF = "2001-07-15 00:00:00"
EVENTS_AS_OF = "2024-01-20 00:00:00"

#: A dictionary for the invented prose of `documents`: license words as roles, frequent syllable words as the rest.
TAXONOMY = Taxonomy(
    roles=(("Free software", ("general public license", "mit license")), ("Apache", ("apache license", "apache license version")), ("Reserved", ("all rights reserved", "rights reserved"))),
    software=(("The", ("the",)), ("Of the", ("of the", "of  the")), ("Und", ("und",)), ("Que", ("que", "de que")), ("Les", ("les",))),
    sectors=(("Latin", ("de la", "que")), ("Germanic", ("der", "die", "und", "of the"))),
    employment=(("Permanent", ("to the",)), ("Contract", ("that",))),
    cities=(("Essen", "Germany", ("de",)), ("Lyon", "France", ("fr",))),
    countries=(("Spain", ("es",)),),
    regions=(("Worldwide", ("en",)),),
    negative_roles=("the", "und"),
)
PROFILE = Profile(
    weights={"target_role": 25, "e3d_pdms": 20, "piping_layout": 15, "sector": 10, "experience": 10, "preferred_location": 10, "site_offshore": 5, "diploma_eligible": 5, "recent_posting": 5},
    terms={"target_role": ("license", "reserved"), "e3d_pdms": ("thing", "ung"), "piping_layout": ("tion", "ment"), "sector": ("over", "ein"), "experience": ("lead", "est"), "preferred_location": ("es", "fr"), "site_offshore": ("$$$", "!!"), "diploma_eligible": ("and",), "mandatory_degree": ("und",)},
    recent_days=14,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings of their customers. customer and nation are dimensions; Spark broadcasts them by their size."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    df = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    score = (df["o_totalprice"].cast("long") % 101).cast("int")
    status = F.when(df["o_orderstatus"] == "F", "applied").when(df["o_orderstatus"] == "O", "new").when(df["o_orderkey"] % 3 == 0, "expired").otherwise("follow_up")
    found = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00+00:00"))
    return df.select(
        F.col("o_orderkey").cast("string").alias("job_key"), F.col("c_name").alias("company"), F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("title"),
        F.col("c_mktsegment").alias("location"), F.lit("").alias("city"), F.lit("").alias("normalized_role"), F.lit("").alias("description"), F.col("n_name").alias("country"),
        F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("published_at"), found.alias("found_at"), found.alias("last_seen_at"), score.alias("match_score"),
        F.when(score >= 85, "critical").when(score >= 70, "high").when(score >= 50, "normal").otherwise("low").alias("priority"), status.alias("application_status"),
        F.concat(F.lit("src"), (F.col("o_orderkey") % 7).cast("string")).alias("source_name"), F.concat(F.lit("https://jobs.example.com/"), (F.col("o_orderkey") % 5000).cast("string")).alias("apply_url"),
        F.lit("unique").alias("duplicate_status"),
    )


JOBS_SQL = """jobs AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_key, c_name AS company, c_mktsegment || ' ' || o_orderpriority AS title, c_mktsegment AS location, n_name AS country,
 strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS published_at, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00+00:00' AS found_at, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00+00:00' AS last_seen_at, o_orderdate AS found_ts,
 CAST(CAST(trunc(o_totalprice) AS BIGINT) % 101 AS INTEGER) AS match_score,
 CASE WHEN CAST(trunc(o_totalprice) AS BIGINT) % 101 >= 85 THEN 'critical' WHEN CAST(trunc(o_totalprice) AS BIGINT) % 101 >= 70 THEN 'high' WHEN CAST(trunc(o_totalprice) AS BIGINT) % 101 >= 50 THEN 'normal' ELSE 'low' END AS priority,
 CASE WHEN o_orderstatus = 'F' THEN 'applied' WHEN o_orderstatus = 'O' THEN 'new' WHEN o_orderkey % 3 = 0 THEN 'expired' ELSE 'follow_up' END AS application_status,
 'src' || (o_orderkey % 7) AS source_name, 'https://jobs.example.com/' || (o_orderkey % 5000) AS apply_url
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def doc_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the first line as title, the text as description."""
    d = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    df = d.select(F.col("doc_id").cast("string").alias("job_key"), F.left(F.substring_index(body, "\n", 1), F.lit(80)).alias("title"), body.alias("description"), F.col("source").alias("company"), F.col("lang").alias("location"), F.concat(F.lit("https://example.com/jobs/"), F.col("doc_id").cast("string")).alias("apply_url"))
    return schemas.conform(df, schemas.JOB)


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts of sources."""
    e = table(spark, sf_dir, "events")
    status = F.when(e["event_type"] == "error", "fail").when(e["event_type"] == "purchase", "pass_with_warnings").otherwise("pass")
    return e.select(e["user_id"].cast("string").alias("source_id"), F.concat(F.lit("Source "), e["user_id"].cast("string")).alias("source_name"), e["ts"].alias("at"), status.alias("status"), F.floor("value").cast("int").alias("records_found"), F.when(e["event_type"] == "error", e["props"]).otherwise("").alias("error_message"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as target companies; each names a customer of its number as alias and two sources."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    df = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    k = F.col("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (k % 7 + 1).cast("int"))
    key = k.cast("string")
    return df.select(
        key.alias("company_id"), F.col("s_name").alias("company"), F.col("n_name").alias("country"), F.array("r_name").alias("regions"), F.array(F.upper("s_name"), F.concat(F.lit("Entity "), key)).alias("local_entities"),
        F.array(F.concat(F.lit("Customer#"), F.lpad(key, 9, "0")), F.concat(F.lit("CUSTOMER#"), F.lpad(key, 9, "0"))).alias("company_aliases"), F.array(key, (k + 50).cast("string")).alias("source_ids"),
        F.concat(F.lit("ats"), (k % 5).cast("string")).alias("ats_family"), F.element_at(F.array(*map(F.lit, ("direct", "gmail_alert", "public_notice", "manual_import"))), (k % 4 + 1).cast("int")).alias("source_mode"),
        status.alias("status"), F.lit("").alias("last_success_at"), F.lit("").alias("last_job_seen_at"), (k % 2 == 0).alias("alert_supported"), (k % 3 + 1).cast("int").alias("priority"), F.concat(F.lit("https://careers"), key, F.lit(".example.com")).alias("official_careers_url"),
    )


REGISTRY_SQL = """registry AS (SELECT CAST(s_suppkey AS VARCHAR) AS company_id, s_suppkey AS k, s_name AS company, n_name AS country, 'ats' || (s_suppkey % 5) AS ats_family,
 ['direct', 'gmail_alert', 'public_notice', 'manual_import'][s_suppkey % 4 + 1] AS source_mode,
 ['ACTIVE_DIRECT', 'ACTIVE_GMAIL_ALERT', 'ACTIVE_PUBLIC_NOTICE', 'ACTIVE_MANUAL_IMPORT', 'STAGED_NEEDS_LIVE_PROOF', 'BLOCKED_RESTRICTED', 'NO_SOURCE_FOUND'][s_suppkey % 7 + 1] AS status,
 CAST(s_suppkey % 3 + 1 AS INTEGER) AS priority, s_suppkey % 2 = 0 AS alert_supported
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

HEALTH_SQL = """attempts AS (SELECT CAST(user_id AS VARCHAR) AS source_id, 'Source ' || user_id AS source_name, ts AS tried, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'purchase' THEN 'pass_with_warnings' ELSE 'pass' END AS status,
 CAST(floor(value) AS INTEGER) AS records_found, CASE WHEN event_type = 'error' THEN props ELSE '' END AS error_message FROM events),
health AS (SELECT source_id, arg_max(source_name, (tried, status)) AS source_name, max(tried) AS last_attempt_at, max(CASE WHEN status IN ('pass', 'pass_with_warnings') THEN tried END) AS last_success_at, arg_max(status, (tried, status)) AS status, arg_max(records_found, (tried, status)) AS records_found, left(arg_max(error_message, (tried, status)), 1000) AS error_message FROM attempts GROUP BY source_id)"""

PROVEN_SQL = f"""{REGISTRY_SQL}, {JOBS_SQL}, {HEALTH_SQL},
aliases AS (SELECT DISTINCT company_id, lower(a) AS alias FROM (SELECT company_id, company AS a FROM registry UNION ALL SELECT company_id, 'Customer#' || lpad(company_id, 9, '0') FROM registry UNION ALL SELECT company_id, 'Entity ' || company_id FROM registry)),
counted AS (SELECT company_id, count(*) FILTER (WHERE CAST(found_ts AS DATE) = DATE '2001-07-15') AS jobs_found_today, count(*) FILTER (WHERE found_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS jobs_found_30d, max(last_seen_at) AS seen FROM aliases JOIN jobs ON lower(jobs.company) = alias GROUP BY company_id),
passing AS (SELECT company_id, count(*) FILTER (WHERE health.status IN ('pass', 'pass_with_warnings')) AS passing_source_count, max(strftime(last_success_at, '%Y-%m-%d %H:%M')) AS success FROM (SELECT company_id, CAST(k AS VARCHAR) AS source_id FROM registry UNION SELECT company_id, CAST(k + 50 AS VARCHAR) FROM registry) JOIN health USING (source_id) GROUP BY company_id),
full_registry AS (SELECT registry.*, coalesce(jobs_found_today, 0) AS jobs_found_today, coalesce(jobs_found_30d, 0) AS jobs_found_30d, coalesce(seen, '') AS last_job_seen_at, coalesce(passing_source_count, 0) AS passing_source_count, coalesce(success, '') AS last_success_at,
 status LIKE 'ACTIVE%' AS coverage_ready FROM registry LEFT JOIN counted USING (company_id) LEFT JOIN passing USING (company_id)),
proven AS (SELECT *, (status = 'ACTIVE_DIRECT' AND passing_source_count > 0) OR (status LIKE 'ACTIVE%' AND status <> 'ACTIVE_DIRECT' AND jobs_found_30d > 0) AS coverage_proven FROM full_registry)"""
