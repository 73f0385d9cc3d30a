"""Integrity checks of the ledger and its side tables, and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescape.functions.text import text


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def missing_required(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.trim(text(F.col("title"))) == "") | (F.trim(text(F.col("company"))) == ""))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_anti")


def orphan_links(links: DataFrame, jobs: DataFrame, messages: DataFrame) -> DataFrame:
    """Links whose job or whose message is missing."""
    return orphans(links, jobs, "job_key").unionByName(orphans(links, messages, "message_id")).distinct()


def link_completeness(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each message its links, those that resolve, and whether all do."""
    there = jobs.select("job_key").distinct().withColumn("there", F.lit(True))
    return links.join(there, "job_key", "left").groupBy("message_id").agg(F.count("*").alias("links"), F.count_if("there").alias("resolved")).withColumn("complete", F.col("links") == F.col("resolved"))


def evidence_by_source(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("source_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).orderBy("source_id")


def evidence_problems(ledger: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Ledger rows whose file (binaryFile: path, content) is missing or has another SHA-256."""
    found = files.select(F.col("path").alias(path), F.sha2("content", 256).alias("now"))
    return ledger.join(found, path, "left").withColumn("problem", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")).where("problem IS NOT NULL").drop("now")


def verify(jobs: DataFrame, aliases: DataFrame, imports: DataFrame, links: DataFrame, messages: DataFrame) -> DataFrame:
    """check, violations for every rule."""
    checks = {"duplicate_job_keys": duplicate_keys(jobs, "job_key"), "missing_required": missing_required(jobs), "orphan_aliases": orphans(aliases, jobs, "job_key"), "staged_imports": imports.where("status = 'staged'"), "imports_without_job": orphans(imports.where("job_key <> ''"), jobs, "job_key"), "orphan_links": orphan_links(links, jobs, messages)}
    parts = [df.agg(F.lit(name).alias("check"), F.count("*").alias("violations")) for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_status(attempted: Column, passed: Column) -> Column:
    return F.when(attempted == 0, "no_sources").when(passed == attempted, "pass").when(passed == 0, "fail").otherwise("partial")


def run_totals(results: DataFrame) -> DataFrame:
    """One row over source results (status, jobs_found, jobs_new, jobs_updated)."""
    ok = F.col("status").isin("pass", "pass_with_warnings")
    out = results.agg(F.count("*").alias("sources_attempted"), F.count_if(ok).alias("sources_passed"), F.count_if(~ok).alias("sources_failed"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("jobs_found", "jobs_new", "jobs_updated")])
    return out.withColumn("status", run_status(F.col("sources_attempted"), F.col("sources_passed")))


def shard_status(plan: DataFrame, found: DataFrame) -> DataFrame:
    """Every planned shard (id) with its status, missing ones named so."""
    return plan.join(found.select("id", "status"), "id", "left").select("id", F.coalesce("status", F.lit("missing")).alias("status"))


def repeated_pages(pages: DataFrame, body: str) -> DataFrame:
    """Pages of a source whose content has come before."""
    key = F.sha2(text(pages[body]).cast("binary"), 256)
    return pages.groupBy("source_id", key.alias("fingerprint")).agg(F.count("*").alias("pages")).where("pages > 1")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def shard_totals(shards: DataFrame) -> DataFrame:
    """The sums of the shards' status fields, and what the whole run's status is."""
    out = shards.agg(F.count("*").alias("shards_completed"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("sources_attempted", "sources_passed", "sources_failed", "jobs_collected", "new_jobs", "updated_jobs")])
    return out.withColumn("collection_status", run_status(F.col("sources_attempted"), F.col("sources_passed")))


def counts_by_status(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("files"), F.count_if("review_required").alias("review_required"))


def missing_names(rows: DataFrame, present: str, required: tuple[str, ...]) -> DataFrame:
    """rows with missing: the required names that an array column lacks, sorted."""
    return rows.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col(present))))


def proof_by_source(evidence: DataFrame, notices: DataFrame, least: int) -> DataFrame:
    """Files, bytes and notices of each source, and whether both prove it."""
    n = notices.groupBy("source_id").agg(F.count("*").alias("notices"))
    out = evidence_by_source(evidence).join(n, "source_id", "full_outer")
    out = out.select("source_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "bytes", "notices")])
    return out.withColumn("proven", (F.col("files") > 0) & (F.col("notices") >= least))
