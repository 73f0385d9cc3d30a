"""Company coverage: registry, health, jobs, proof states and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescape.functions.dates import iso
from rolescape.functions.text import first_filled, folded, percentage, text
from rolescape.operators.dedup import numbered

#: The registry's statuses.
DIRECT, GMAIL, NOTICE, MANUAL = "ACTIVE_DIRECT", "ACTIVE_GMAIL_ALERT", "ACTIVE_PUBLIC_NOTICE", "ACTIVE_MANUAL_IMPORT"
STAGED, BLOCKED, NONE = "STAGED_NEEDS_LIVE_PROOF", "BLOCKED_RESTRICTED", "NO_SOURCE_FOUND"
COVERED = (DIRECT, GMAIL, NOTICE, MANUAL)
STATUSES = (*COVERED, STAGED, BLOCKED, NONE)
PASSING = ("pass", "pass_with_warnings")


def is_covered(status: Column) -> Column:
    return status.isin(*COVERED)


def next_action(status: Column, mode: Column) -> Column:
    #: The texts of the recommended actions.
    return (
        F.when(status == STAGED, "Run bounded live contract proof, retain evidence, then enable only after tests pass.")
        .when(status == BLOCKED, "Use authorized Gmail alerts or private EML/PDF/image import; do not bypass restrictions.")
        .when(status == NONE, "Verify official careers site, talent community, public notices and recruiter channels.")
        .when(mode == "public_notice", "Implement HTML/PDF notice collector with closing-date and corrigendum tracking.")
        .when(mode == "gmail_alert", "Authorize Gmail locally and prove employer/portal alert query coverage.")
        .when(mode == "manual_import", "Retain official files locally and route uncertain extraction to Manual_Review.")
        .otherwise("Maintain health checks and evidence proof.")
    )


def alias_rows(registry: DataFrame) -> DataFrame:
    """company_id, alias: the folded company name, aliases and local entities, each once for a company."""
    none = F.array().cast("array<string>")
    names = F.concat(F.array("company"), F.coalesce("company_aliases", none), F.coalesce("local_entities", none))
    return registry.select("company_id", F.explode(names).alias("alias")).select("company_id", folded(F.col("alias")).alias("alias")).where("alias <> ''").distinct()


def job_counts(registry: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs today and in 30 days and the last sighting of each company; a job counts once for each company it names.

    Jobs are counted by folded name before the join, so the join sees a row for each name, not for each job.
    """
    found = iso(jobs["found_at"])
    by_name = jobs.groupBy(folded(jobs["company"]).alias("alias")).agg(F.count_if(F.to_date(found) == F.to_date(as_of)).alias("today"), F.count_if(found >= as_of - F.make_interval(days=F.lit(30))).alias("recent"), F.max(text(jobs["last_seen_at"])).alias("seen"))
    met = alias_rows(registry).join(by_name, "alias")
    return met.groupBy("company_id").agg(F.sum("today").alias("jobs_found_today"), F.sum("recent").alias("jobs_found_30d"), F.max("seen").alias("seen"))


def health_by_company(registry: DataFrame, health: DataFrame) -> DataFrame:
    """Latest success and attempt, and passing sources, over each company's sources."""
    wanted = registry.select("company_id", F.explode("source_ids").alias("source_id")).distinct()
    return wanted.join(health, "source_id").groupBy("company_id").agg(F.max(text(F.col("last_success_at"))).alias("success"), F.max(text(F.col("last_attempt_at"))).alias("attempt"), F.count_if(F.col("status").isin(*PASSING)).alias("passing"))


def company_registry(registry: DataFrame, jobs: DataFrame, health: DataFrame, as_of: Column) -> DataFrame:
    """The registry with counts, health, activity and the recommended action."""
    df = registry.join(job_counts(registry, jobs, as_of), "company_id", "left").join(health_by_company(registry, health), "company_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    plain = [c for c in registry.columns if c not in ("last_success_at", "last_job_seen_at")]
    return df.select(*plain, F.size(F.coalesce("source_ids", F.array().cast("array<string>"))).cast("long").alias("configured_source_count"), F.coalesce("passing", F.lit(0)).cast("long").alias("passing_source_count"), first_filled(F.col("success"), F.col("last_success_at")).alias("last_success_at"), text(F.col("attempt")).alias("last_attempt_at"), first_filled(F.col("seen"), F.col("last_job_seen_at")).alias("last_job_seen_at"), zero("jobs_found_today"), zero("jobs_found_30d"), is_covered(F.col("status")).alias("coverage_active"), next_action(F.col("status"), F.col("source_mode")).alias("recommended_next_action"))


def prove(registry: DataFrame) -> DataFrame:
    """coverage_ready, coverage_proven, coverage_active and proof_state: a direct source must pass, others have recent jobs."""
    ready = is_covered(F.col("status"))
    proven = ((F.col("status") == DIRECT) & (F.col("passing_source_count") > 0)) | (F.col("status").isin(GMAIL, NOTICE, MANUAL) & (F.col("jobs_found_30d") > 0))
    return registry.withColumns({"coverage_ready": ready, "coverage_proven": proven, "coverage_active": proven, "proof_state": F.when(proven, "proven_operational").when(ready, "configured_unproven").otherwise("not_configured")})


def gap_type(status: Column, proof_state: Column | None = None) -> Column:
    """Why a company is no covered one; with proof states unknown statuses are coverage_missing, without them null."""
    named = F.when(status == STAGED, "live_contract_proof").when(status == BLOCKED, "restricted_source").when(status == NONE, "source_discovery")
    if proof_state is None:
        return named
    return F.when(proof_state == "configured_unproven", "configured_but_unproven").otherwise(F.coalesce(named, F.lit("coverage_missing")))


def gaps(registry: DataFrame) -> DataFrame:
    """Companies without an active status, before proof."""
    return registry.where(~is_covered(F.col("status"))).withColumn("gap_type", gap_type(F.col("status"))).orderBy("priority", "country", "company")


def proof_gaps(proven: DataFrame) -> DataFrame:
    return proven.where(~F.col("coverage_proven")).withColumn("gap_type", gap_type(F.col("status"), F.col("proof_state"))).orderBy("priority", "country", "company")


def _status_counts(proven_only: bool) -> list[Column]:
    names = {DIRECT: "active_direct_sources", GMAIL: "active_gmail_sources", NOTICE: "public_notice_sources", MANUAL: "manual_import_sources", STAGED: "staged_sources", BLOCKED: "blocked_sources", NONE: "no_source_found"}
    return [F.count_if((F.col("status") == s) & (F.col("coverage_proven") if proven_only and s in COVERED else F.lit(True))).alias(n) for s, n in names.items()]


def country_coverage(registry: DataFrame) -> DataFrame:
    """Configured coverage by country: status counts, job sums, newest success, percentage."""
    out = registry.groupBy("country").agg(F.count("*").alias("total_target_companies"), *_status_counts(False), F.sum("jobs_found_today").alias("jobs_found_today"), F.sum("jobs_found_30d").alias("jobs_found_30d"), F.max("last_success_at").alias("last_successful_scan"), F.count_if(is_covered(F.col("status"))).alias("covered"))
    out = out.withColumn("coverage_percentage", percentage(F.col("covered"), F.col("total_target_companies"))).drop("covered")
    return out.orderBy("coverage_percentage", F.desc("total_target_companies"), "country")


def proof_coverage(proven: DataFrame) -> DataFrame:
    """Evidence-backed coverage by country, 16 columns."""
    out = proven.groupBy("country").agg(F.count("*").alias("total_target_companies"), F.count_if("coverage_ready").alias("configured_coverage_paths"), F.count_if("coverage_proven").alias("proven_operational_coverage"), *_status_counts(True), F.count_if(F.col("coverage_ready") & ~F.col("coverage_proven")).alias("unproven_configured_paths"), F.sum("jobs_found_today").alias("jobs_found_today"), F.sum("jobs_found_30d").alias("jobs_found_30d"), F.max("last_success_at").alias("last_successful_scan"))
    out = out.withColumn("coverage_percentage", percentage(F.col("proven_operational_coverage"), F.col("total_target_companies")))
    return out.orderBy("coverage_percentage", F.desc("total_target_companies"), "country")


def country_matrix(registry: DataFrame) -> DataFrame:
    """A row for each country, a column for each status, their active sum and percentage."""
    out = registry.groupBy("country").agg(F.count("*").alias("target_companies"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES], F.count_if(is_covered(F.col("status"))).alias("active_coverage"))
    return out.withColumn("coverage_percent", percentage(F.col("active_coverage"), F.col("target_companies"))).orderBy("coverage_percent", F.desc("target_companies"), "country")


def ats_coverage(registry: DataFrame) -> DataFrame:
    out = registry.groupBy("ats_family").agg(F.count("company_id").alias("target_companies"), F.count_if(F.col("status") == DIRECT).alias("active_direct"), F.count_if(F.col("status").isin(GMAIL, NOTICE, MANUAL)).alias("active_alternative"), F.count_if(F.col("status") == STAGED).alias("staged"), F.count_if(F.col("status").isin(BLOCKED, NONE)).alias("blocked"))
    return out.orderBy(F.desc("active_direct"), F.desc("target_companies"), "ats_family")


def stale(registry: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Direct sources whose last success is unknown or older than some days."""
    success = iso(F.col("last_success_at"))
    return registry.where((F.col("status") == DIRECT) & (success.isNull() | (success < as_of - F.make_interval(days=F.lit(days)))))


def notices(registry: DataFrame, overridden: bool = False) -> DataFrame:
    """Public-notice companies: by source mode, or after overrides by an ATS family that names notices."""
    return registry.where(F.lower("ats_family").contains("notice") if overridden else F.col("source_mode") == "public_notice")


def with_status(registry: DataFrame, *statuses: str) -> DataFrame:
    return registry.where(F.col("status").isin(*statuses))


def alert_capable(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("alert_supported") & (F.col("status") != BLOCKED))


def override(registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """registry with the columns that a company's override sets; a null doesn't set, an empty text does.

    An override of an unknown or repeated company stops the query.
    """
    columns = [c for c in overrides.columns if c != "company_id" and c in registry.columns]
    o = overrides.select("company_id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_set"))
    checked = o.groupBy("company_id").agg(*[F.first(c).alias(c) for c in o.columns if c != "company_id"], F.count("*").alias("_n"))
    joined = registry.withColumn("_known", F.lit(True)).join(checked, "company_id", "full")
    bad = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("override of an unknown company: "), F.col("company_id")))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("more than one override of "), F.col("company_id")))).otherwise(F.col("company_id"))
    return joined.select(*[bad.alias(c) if c == "company_id" else F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in registry.columns])


def company_aliases(registry: DataFrame, ignore_case: bool = False) -> DataFrame:
    """company_id, company, alias. Exact distinct in order company, aliases, entities; or ignoring case with entities before aliases."""
    none = F.array().cast("array<string>")
    names = [F.array("company"), F.coalesce("company_aliases", none), F.coalesce("local_entities", none)]
    if ignore_case:
        names = [names[0], names[2], names[1]]
    rows = registry.select("company_id", "company", F.posexplode(F.concat(*names)).alias("at", "alias"))
    key = folded(F.col("alias")) if ignore_case else F.col("alias")
    return rows.groupBy("company_id", "company", key.alias("k")).agg(F.min_by("alias", "at").alias("alias")).select("company_id", "company", "alias").orderBy("company", "alias")


def query_groups(terms: DataFrame, column: str, size: int = 25, newer_than_days: int = 30) -> DataFrame:
    """Sorted distinct terms in groups of `size`, each an OR of quoted terms behind a newer_than filter.

    Terms are numbered by ranges, so no task sees all of them.
    """
    cleaned = F.trim(F.replace(text(terms[column]), F.lit('"'), F.lit("")))
    distinct = terms.select(cleaned.alias("term")).where("term <> ''").groupBy(F.lower("term").alias("k")).agg(F.min("term").alias("term"))
    grouped = numbered(distinct, ["k"], "n").groupBy(F.floor(F.col("n") / size).cast("int").alias("group")).agg(F.count("*").alias("terms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: F.concat(F.lit('"'), x["term"], F.lit('"'))), " OR ").alias("q"))
    return grouped.select((F.col("group") + 1).alias("query_group"), "terms", F.concat(F.lit(f"newer_than:{newer_than_days}d ("), F.col("q"), F.lit(")")).alias("query")).orderBy("query_group")


def totals(companies: DataFrame, countries: DataFrame, country: str = "India") -> DataFrame:
    """One row: the size of the registry, its active companies, and a country's percentage (0 without it)."""
    of = countries.where(F.col("country") == country).agg(F.coalesce(F.max("coverage_percentage"), F.lit(0.0)).alias("coverage_percentage"))
    return companies.agg(F.count("*").alias("companies"), F.count_if("coverage_active").alias("active")).join(F.broadcast(of))
