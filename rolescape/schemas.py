"""Schemas of the engine's tables. Text is never null by contract; missing is the empty string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a job row, in order.
JOB_COLUMNS = (
    "title", "company", "normalized_role", "location", "city", "country", "description", "apply_url", "source_url", "source_name",
    "published_at", "closing_at", "found_at", "last_seen_at", "job_type", "employment_type", "salary_text", "experience_text", "skills_text",
    "software_text", "sector", "agency_name", "recruiter_name", "recruiter_email", "contact_source_url", "contact_confidence", "match_score",
    "match_reasons", "gaps", "priority", "duplicate_status", "application_status", "job_key",
)
DEFAULTS = {"source_name": "manual", "priority": "normal", "duplicate_status": "unique", "application_status": "new"}


def struct(*columns: str) -> T.StructType:
    """Columns as "name" (text) or "name kind"."""
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "bool": T.BooleanType(), "ts": T.TimestampType(), "array": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(c.split()[0], kinds[c.split()[1]] if " " in c else T.StringType()) for c in columns])


JOB = struct(*[c + " int" if c == "match_score" else c for c in JOB_COLUMNS])
LEDGER = T.StructType([*JOB.fields, T.StructField("identity_fingerprint", T.StringType()), T.StructField("canonical_url", T.StringType())])
ALIASES = struct("alias_type", "alias_value", "job_key", "first_seen_at")
SOURCE_HEALTH = struct("source_id", "source_name", "last_attempt_at", "last_success_at", "status", "records_found int", "error_message")
RUNS = struct("run_id", "started_at", "ended_at", "status", "sources_attempted int", "sources_passed int", "sources_failed int", "jobs_found int", "jobs_new int", "export_status", "error_message")
EVIDENCE = struct("evidence_id", "run_id", "source_id", "fetched_at", "source_url", "file_path", "sha256", "content_type", "status_code int", "size_bytes long")
IMPORTS = struct("import_id", "sha256", "original_path", "original_name", "stored_path", "mime_type", "size_bytes long", "extraction_method", "extracted_chars int", "review_required int", "warnings", "job_key", "status", "imported_at")
MESSAGES = struct("message_id", "thread_id", "sender", "subject", "received_at", "query_text", "evidence_path", "sha256", "status", "jobs_created int", "jobs_updated int", "error_message", "imported_at")
MESSAGE_JOBS = struct("message_id", "job_key", "candidate_index int", "source_url")
REGISTRY = struct("company_id", "company", "country", "regions array", "local_entities array", "company_aliases array", "sectors array", "source_ids array", "employer_type", "official_careers_url", "job_host", "ats_family", "source_mode", "status", "verified_at", "last_success_at", "last_job_seen_at", "blocked_reason", "alert_supported bool", "priority int")
CONTACTS = struct("organization", "record_type", "country", "email", "mailbox_type", "verification_status", "mail_route_status", "priority_score int", "source_url", "source_sha256", "extraction_method", "evidence_context", "discovered_at_utc", "review_reason")
FAILURES = struct("organization", "url", "stage", "error")
TABLES = {"jobs": LEDGER, "job_identity_aliases": ALIASES, "source_health": SOURCE_HEALTH, "runs": RUNS, "source_evidence": EVIDENCE, "private_imports": IMPORTS, "gmail_alert_messages": MESSAGES, "gmail_alert_jobs": MESSAGE_JOBS}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, every column."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """df with exactly the schema's columns: missing ones added with their default (text: empty, number: 0), text never null."""
    out = []
    for f in schema.fields:
        blank = F.lit(defaults.get(f.name, "")) if isinstance(f.dataType, T.StringType) else F.lit(0) if isinstance(f.dataType, T.IntegerType | T.LongType) else F.lit(None)
        c = F.coalesce(df[f.name].cast(f.dataType), blank.cast(f.dataType)) if f.name in df.columns else blank.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
