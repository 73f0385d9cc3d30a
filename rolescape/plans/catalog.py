"""Named queries over the driver's tables, each with its SQL where SQL has a form for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolescape import schemas
from rolescape.config import Groups, Taxonomy
from rolescape.functions import dates, emails, text, urls
from rolescape.operators import contacts, coverage, dedup, integrity, ledger, matching, reports, scoring
from rolescape.plans.adapters import AS_OF, EVENTS_AS_OF, HEALTH_SQL, JOBS_SQL, PROFILE, PROVEN_SQL, REGISTRY_SQL, TAXONOMY, doc_jobs, health, jobs, literal, registry, table
from rolescape.shared import written
from rolescape.sources import html, mail

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
GROUP_SQL = f"grouped AS (SELECT *, left(sha256({NORM.format('title')} || '|' || {NORM.format('company')} || '|' || {NORM.format('location')} || '|' || left(published_at, 10)), 20) AS duplicate_group FROM jobs)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def phrase_sql(column: str, phrase: str) -> str:
    words = r"\s+".join(phrase.split())
    return f"regexp_matches({column}, '(^|[^a-z0-9]){words}([^a-z0-9]|$)')"


def first_match_sql(column: str, groups: Groups) -> str:
    ranked = sorted(((len(a), -i, n, a) for i, (n, xs) in enumerate(groups) for a in xs), key=lambda x: (-x[0], -x[1]))
    return "CASE " + " ".join(f"WHEN {phrase_sql(column, a)} THEN '{n}'" for _, _, n, a in ranked) + " ELSE '' END"


def any_sql(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


@query(f"""WITH {JOBS_SQL}, {GROUP_SQL},
 sized AS (SELECT duplicate_group, count(*) AS source_count, string_agg(DISTINCT source_name, '; ' ORDER BY source_name) AS duplicate_sources FROM grouped GROUP BY 1),
 seen AS (SELECT duplicate_group, apply_url, min(o) AS o FROM (SELECT duplicate_group, apply_url, row_number() OVER (ORDER BY found_at DESC, company, title, job_key) AS o FROM grouped) GROUP BY 1, 2),
 links AS (SELECT duplicate_group, string_agg(apply_url, chr(10) ORDER BY o) AS all_apply_urls FROM seen GROUP BY 1),
 best AS (SELECT *, row_number() OVER (PARTITION BY duplicate_group ORDER BY match_score DESC, published_at DESC, last_seen_at DESC, found_at DESC, company, title, job_key) AS n FROM grouped)
 SELECT duplicate_group, job_key, company, title, match_score, source_count, duplicate_sources, all_apply_urls, CASE WHEN source_count > 1 THEN 'cross_source_duplicate' ELSE 'unique' END AS duplicate_status
 FROM best JOIN sized USING (duplicate_group) JOIN links USING (duplicate_group) WHERE n = 1""")
def dedup_representatives(spark, d):
    return dedup.representatives(jobs(spark, d)).select("duplicate_group", "job_key", "company", "title", "match_score", "source_count", "duplicate_sources", "all_apply_urls", "duplicate_status")


@query(f"WITH {JOBS_SQL}, {GROUP_SQL} SELECT duplicate_group, job_key, source_name, source_count FROM (SELECT *, count(*) OVER (PARTITION BY duplicate_group) AS source_count FROM grouped) WHERE source_count > 1")
def dedup_variants(spark, d):
    return dedup.variants(jobs(spark, d)).select("duplicate_group", "job_key", "source_name", "source_count")


@query(f"WITH {JOBS_SQL} SELECT job_key, application_status FROM jobs WHERE application_status NOT IN ('expired', 'rejected')")
def active_rows(spark, d):
    return reports.active(jobs(spark, d)).select("job_key", "application_status")


@query(f"WITH {JOBS_SQL} SELECT application_status, count(*) AS jobs FROM jobs WHERE application_status IN ('applied', 'follow_up', 'rejected', 'expired') GROUP BY 1")
def status_partition_counts(spark, d):
    df = jobs(spark, d)
    return df.where(F.col("application_status").isin("applied", "follow_up", "rejected", "expired")).groupBy("application_status").agg(F.count("*").alias("jobs"))


@query(f"WITH {JOBS_SQL} SELECT job_key, found_at FROM jobs WHERE starts_with(found_at, '2001-07-15')")
def new_today(spark, d):
    return reports.new_today(jobs(spark, d), literal(AS_OF)).select("job_key", "found_at")


@query(f"WITH {JOBS_SQL} SELECT job_key, priority FROM jobs WHERE priority IN ('critical', 'high')")
def high_priority(spark, d):
    return reports.high_priority(jobs(spark, d)).select("job_key", "priority")


@query("SELECT CAST(doc_id AS VARCHAR) AS job_key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def manual_review(spark, d):
    imports = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("job_key"), (F.col("quality") == 0).cast("int").alias("review_required"))
    return reports.manual_review(doc_jobs(spark, d), imports).select("job_key")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_alias_anti(spark, d):
    return integrity.orphans(table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query("SELECT l_orderkey AS message_id, count(*) AS links, count(p_partkey) AS resolved, count(*) = count(p_partkey) AS complete FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) ON l_partkey = p_partkey GROUP BY 1")
def link_completeness(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("job_key"))
    return integrity.link_completeness(links, table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("job_key")))


@query(f"WITH {JOBS_SQL} SELECT country, count(*) AS jobs, count(*) FILTER (WHERE priority IN ('critical', 'high')) AS critical_high, max(published_at) AS newest_posting FROM jobs GROUP BY 1")
def summary_by_country(spark, d):
    return dedup.summary_by(jobs(spark, d), "country")


@query(f"WITH {JOBS_SQL} SELECT company, count(*) AS jobs, count(*) FILTER (WHERE priority IN ('critical', 'high')) AS critical_high, max(published_at) AS newest_posting FROM jobs GROUP BY 1")
def summary_by_company(spark, d):
    return dedup.summary_by(jobs(spark, d), "company")


_METRICS = {
    "generated_at": f"'{AS_OF.replace(' ', 'T')}+00:00'", "raw_source_rows": "(SELECT count(*) FROM jobs)", "worldwide_deduplicated_jobs": "(SELECT count(*) FROM best)",
    "duplicate_variant_rows": "(SELECT count(*) FROM sized WHERE n > 1)", "new_today": f"(SELECT count(*) FROM best WHERE starts_with(found_at, '{AS_OF[:10]}'))", "high_priority": "(SELECT count(*) FROM best WHERE priority IN ('critical', 'high'))",
    "countries": "(SELECT count(DISTINCT country) FROM best)", "companies": "(SELECT count(DISTINCT company) FROM best)",
    "manual_review": "(SELECT count(*) FROM jobs WHERE CAST(job_key AS BIGINT) % 5 = 0 OR job_key IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0))",
    **{s: f"(SELECT count(*) FROM jobs WHERE application_status = '{s}')" for s in ("applied", "follow_up", "rejected", "expired")},
    "recruiter_contacts": "(SELECT count(*) FROM customer WHERE c_acctbal < 0)", "sources_total": "(SELECT count(*) FROM health)", "sources_passing": "(SELECT count(*) FROM health WHERE status <> 'fail')", "sources_failing": "(SELECT count(*) FROM health WHERE status = 'fail')",
    "gmail_messages": "(SELECT count(*) FROM events)", "gmail_complete": "(SELECT count(*) FROM events WHERE event_type <> 'error')", "gmail_failed": "(SELECT count(*) FROM events WHERE event_type = 'error')",
    "target_companies": "(SELECT count(*) FROM registry)", "active_company_coverage": "(SELECT count(*) FROM registry WHERE status LIKE 'ACTIVE%')", "company_coverage_gaps": "(SELECT count(*) FROM registry WHERE status NOT LIKE 'ACTIVE%')",
}


@query(f"""WITH {JOBS_SQL}, {HEALTH_SQL}, {REGISTRY_SQL}, live AS (SELECT * FROM jobs WHERE application_status NOT IN ('expired', 'rejected')), {GROUP_SQL.replace('FROM jobs', 'FROM live')},
 best AS (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY duplicate_group ORDER BY match_score DESC, published_at DESC, last_seen_at DESC, found_at DESC, company, title, job_key) = 1), sized AS (SELECT count(*) OVER (PARTITION BY duplicate_group) AS n FROM grouped)
 {' UNION ALL '.join(f"SELECT '{name}' AS metric, CAST({value} AS VARCHAR) AS value" for name, value in _METRICS.items())}""")
def daily_metrics(spark, d):
    j = jobs(spark, d).withColumn("contact_confidence", F.when(F.col("job_key").cast("long") % 5 == 0, "ALERT_SUPPLIED").otherwise(""))
    imports = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("job_key"), (F.col("quality") == 0).cast("int").alias("review_required"))
    messages = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "complete_with_warnings").otherwise("complete").alias("status"))
    companies = registry(spark, d).withColumn("coverage_active", F.col("status").startswith("ACTIVE")).withColumn("coverage_gap", ~F.col("coverage_active"))
    return reports.daily_metrics(j, ledger.health_latest(health(spark, d)), imports, table(spark, d, "customer").where("c_acctbal < 0"), messages, companies, literal(AS_OF))


@query(f"WITH {JOBS_SQL} SELECT job_key, match_score, published_at, company, title FROM jobs ORDER BY match_score DESC, published_at DESC, company, title, job_key LIMIT 100")
def top_100_jobs(spark, d):
    return reports.top_jobs(jobs(spark, d)).select("job_key", "match_score", "published_at", "company", "title")


@query(f"WITH {JOBS_SQL} SELECT company FROM (SELECT company, max((match_score, published_at)) AS r FROM jobs WHERE match_score >= 80 GROUP BY 1 ORDER BY r DESC, company LIMIT 5)")
def executive_top_employers(spark, d):
    return reports.top_names(jobs(spark, d), "company")


@query("SELECT source AS source_id, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def evidence_by_source(spark, d):
    return integrity.evidence_by_source(table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("n_chars").alias("size_bytes")))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_key_check(spark, d):
    return integrity.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey").withColumnRenamed("count", "n")


@query("SELECT doc_id FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 3 OR trim(coalesce(text, '')) = '' OR trim(coalesce(source, '')) = ''")
def missing_required(spark, d):
    title, company = F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("text")), F.when(F.col("doc_id") % 7 != 3, F.col("source"))
    return integrity.missing_required(table(spark, d, "documents").select("doc_id", title.alias("title"), company.alias("company"))).select("doc_id")


@query(f"SELECT doc_id, {NORM.format('text')} AS normalized FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


FIRST_LINE = "left(split_part(text, chr(10), 1), 80)"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS job_key, sha256({NORM.format(FIRST_LINE)} || '|' || {NORM.format('source')} || '|' || {NORM.format('lang')} || '|' || {NORM.format('text')}) AS fingerprint FROM documents")
def fingerprint_sha256(spark, d):
    df = doc_jobs(spark, d)
    return df.select("job_key", ledger.fingerprint(df).alias("fingerprint"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS job_key, sha256(lower(concat_ws(' ', nullif({FIRST_LINE}, ''), nullif(source, ''), nullif(lang, ''), nullif(text, '')))) AS searchable_sha FROM documents")
def searchable_text(spark, d):
    df = doc_jobs(spark, d)
    return df.select("job_key", F.sha2(matching.searchable(df), 256).alias("searchable_sha"))


@query(r"""WITH parts AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)', 1)) || '://' || lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)', 2)) AS o, rtrim(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)', 3), '/') AS p, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT lower(split_part(x, '=', 1)) IN ('fbclid', 'gclid', 'dclid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid'))) AS q FROM pages)
 SELECT page_id, o || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical FROM parts""")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query("SELECT page_id, rtrim(split_part(url, '#', 1), '/') AS identity FROM pages")
def url_identity(spark, d):
    return table(spark, d, "pages").select("page_id", urls.identity(F.col("url")).alias("identity"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) AS origin, array_to_string(list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), '|') AS parts FROM pages")
def path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"), F.array_join(urls.path_parts(F.col("url")), "|").alias("parts"))


@query(r"SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '(^|\.)example\.(com|org)$')")
def url_allowlist(spark, d):
    return table(spark, d, "pages").where(urls.is_web(F.col("url")) & urls.in_domains(F.col("url"), ["example.com", "example.org"])).select("page_id")


@query(f"SELECT doc_id, {phrase_sql('lower(text)', 'general public license')} AS gpl, {phrase_sql('lower(text)', 'of the')} AS of_the FROM documents")
def phrase_match(spark, d):
    t = F.lower("text")
    return table(spark, d, "documents").select("doc_id", text.contains_phrase(t, "general public license").alias("gpl"), text.contains_phrase(t, "of the").alias("of_the"))


@query(f"SELECT doc_id FROM documents WHERE {any_sql('lower(text)', ('license', 'reserved', 'lead'))}")
def substring_match(spark, d):
    return table(spark, d, "documents").where(text.contains_any(F.lower("text"), ("license", "reserved", "lead"))).select("doc_id")


@query(f"SELECT doc_id, {first_match_sql('lower(text)', TAXONOMY.roles)} AS best FROM documents")
def longest_alias(spark, d):
    return table(spark, d, "documents").select("doc_id", matching.first_match(F.lower("text"), TAXONOMY.roles).alias("best"))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(phrase_sql('lower(text)', a) for a in xs)} THEN '{n}' END" for n, xs in TAXONOMY.software) + "], lambda x: x IS NOT NULL), '; ') AS found FROM documents")
def all_matches(spark, d):
    return table(spark, d, "documents").select("doc_id", matching.all_matches(F.lower("text"), TAXONOMY.software).alias("found"))


_T = PROFILE.terms
_W = PROFILE.weights
SCORED_SQL = f"""scored AS (SELECT CAST(doc_id AS VARCHAR) AS job_key, CAST(least(100, {' + '.join(f"CASE WHEN {any_sql('s', _T[k])} THEN {_W[k]} ELSE 0 END" for k in ('target_role', 'e3d_pdms', 'piping_layout', 'sector', 'experience', 'preferred_location', 'site_offshore', 'diploma_eligible'))}) AS INTEGER) AS match_score,
 array_to_string(list_filter([CASE WHEN NOT {any_sql('s', _T['target_role'])} THEN 'Target role wording not detected' END, CASE WHEN NOT {any_sql('s', _T['e3d_pdms'])} THEN 'E3D/PDMS/SP3D requirement not stated' END, CASE WHEN NOT {any_sql('s', _T['diploma_eligible'])} AND {any_sql('s', _T['mandatory_degree'])} THEN 'Degree may be mandatory' END], lambda x: x IS NOT NULL), '; ') AS gaps
 FROM (SELECT doc_id, lower({FIRST_LINE} || ' ' || source || ' ' || lang || ' ' || text) AS s FROM documents))"""


@query(f"WITH {SCORED_SQL} SELECT job_key, match_score, gaps, CASE WHEN match_score >= 85 THEN 'critical' WHEN match_score >= 70 THEN 'high' WHEN match_score >= 50 THEN 'normal' ELSE 'low' END AS priority FROM scored")
def match_score(spark, d):
    return scoring.score(doc_jobs(spark, d), PROFILE, literal(AS_OF)).select("job_key", "match_score", "gaps", "priority")


@query(f"WITH {SCORED_SQL} SELECT CASE WHEN match_score >= 85 THEN 'critical' WHEN match_score >= 70 THEN 'high' WHEN match_score >= 50 THEN 'normal' ELSE 'low' END AS priority, count(*) AS jobs FROM scored GROUP BY 1")
def priority_bucket(spark, d):
    return scoring.score(doc_jobs(spark, d), PROFILE, literal(AS_OF)).groupBy("priority").agg(F.count("*").alias("jobs"))


@query(f"WITH {SCORED_SQL} SELECT job_key, match_score FROM scored WHERE match_score >= 20")
def profile_filter(spark, d):
    return scoring.profile_filter(scoring.score(doc_jobs(spark, d), PROFILE, literal(AS_OF))).select("job_key", "match_score")


_TITLE = f"trim(regexp_replace(lower({FIRST_LINE}), '\\s+', ' ', 'g'))"
_VETO = " OR ".join(phrase_sql("t", x) for x in TAXONOMY.negative_roles)


@query(f"""WITH base AS (SELECT doc_id, lang, {_TITLE} AS t, {_TITLE} || ' ' || lower(left(text, 2000)) AS c, lower({FIRST_LINE} || ' ' || source || ' ' || lang || ' ' || text) AS s FROM documents)
 SELECT CAST(doc_id AS VARCHAR) AS job_key, CASE WHEN {_VETO} THEN '' WHEN ({first_match_sql('t', TAXONOMY.roles)}) <> '' THEN {first_match_sql('t', TAXONOMY.roles)} ELSE {first_match_sql('c', TAXONOMY.roles)} END AS normalized_role,
 CASE lang WHEN 'de' THEN 'Essen' WHEN 'fr' THEN 'Lyon' ELSE '' END AS city, CASE lang WHEN 'de' THEN 'Germany' WHEN 'fr' THEN 'France' WHEN 'es' THEN 'Spain' WHEN 'en' THEN 'Worldwide' ELSE '' END AS country, {first_match_sql('s', TAXONOMY.sectors)} AS sector, {first_match_sql('s', TAXONOMY.employment)} AS employment_type FROM base""")
def enrich_fill_empty(spark, d):
    return matching.enrich(doc_jobs(spark, d), TAXONOMY).select("job_key", "normalized_role", "city", "country", "sector", "employment_type")


_EMAIL = r"[A-Za-z0-9.!#$%&''*+/=?^_`{|}~\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"


@query(f"SELECT doc_id, lower(regexp_extract(text, '{_EMAIL}', 0)) AS email FROM documents WHERE regexp_matches(text, '{_EMAIL}')")
def first_email(spark, d):
    df = table(spark, d, "documents").select("doc_id", emails.first_email(F.col("text")).alias("email"))
    return df.where("email <> ''")


@query(f"SELECT DISTINCT doc_id, lower(e) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}', 0)) AS e FROM documents)")
def all_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(emails.all_emails(F.col("text"))).alias("email"))


@query(r"""SELECT page_id, CASE WHEN len(l) <= 2 THEN h ELSE array_to_string(l[len(l)-1:len(l)], '.') END AS base_domain FROM (SELECT page_id, h, string_split(h, '.') AS l FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h FROM pages))""")
def base_domain(spark, d):
    return table(spark, d, "pages").select("page_id", emails.base_domain(urls.host(F.col("url"))).alias("base_domain"))


#: Addresses made of a part's number: every mailbox kind occurs.
LOCALS = ("careers", "info", "hr.team", "press", "info.hr", "jobs-emea", "u003ehr", "jane.doe", "e-talent.legal", "contact")
_LOCAL_SQL = "[" + ", ".join(f"'{x}'" for x in LOCALS) + "][p_partkey % 10 + 1]"
_TOKENS_SQL = f"[x for x in string_split_regex({_LOCAL_SQL}, '[._+-]+') if x <> '']"
_KIND_SQL = (
    f"CASE WHEN regexp_matches({_LOCAL_SQL}, '^u00[0-9a-f]{{2}}') OR list_has_any({_TOKENS_SQL}, {list(emails.EXCLUDED)}) THEN 'excluded' WHEN list_contains({list(emails.GENERAL)}, ({_TOKENS_SQL})[1]) THEN 'general_business'"
    f" WHEN list_has_any({_TOKENS_SQL}, {list(emails.JOB)}) THEN 'job_or_recruitment' WHEN list_has_any({_TOKENS_SQL}, {list(emails.GENERAL)}) THEN 'general_business' ELSE 'excluded' END"
)


def mailboxes(spark, d):
    p = table(spark, d, "part")
    local = F.element_at(F.array(*map(F.lit, LOCALS)), (p["p_partkey"] % 10 + 1).cast("int"))
    return p.select("p_partkey", F.concat(local, F.lit("@c"), (p["p_partkey"] % 97).cast("string"), F.lit(".example.com")).alias("email"), F.when(p["p_partkey"] % 4 == 0, "no_mail_route").otherwise("mx").alias("mail_route_status"), p["p_brand"].alias("organization"), F.concat(F.lit("https://example.com/"), (p["p_partkey"] % 13).cast("string")).alias("source_url"))


_MAIL_SQL = f"mailboxes AS (SELECT p_partkey, {_LOCAL_SQL} || '@c' || (p_partkey % 97) || '.example.com' AS email, {_KIND_SQL} AS kind, p_partkey % 4 <> 0 AS routed, p_brand AS organization, 'https://example.com/' || (p_partkey % 13) AS source_url FROM part)"
_JUDGED_SQL = f"{_MAIL_SQL}, judged AS (SELECT *, CASE WHEN kind = 'excluded' THEN 'excluded' WHEN NOT routed THEN 'manual_review_dns' WHEN kind = 'job_or_recruitment' THEN 'verified_official_job_mailbox' ELSE 'verified_official_general_mailbox' END AS status, CASE WHEN kind = 'excluded' THEN 0 WHEN kind = 'job_or_recruitment' THEN CASE WHEN routed THEN 100 ELSE 60 END WHEN routed THEN 70 ELSE 30 END AS score FROM mailboxes)"


@query(f"WITH {_MAIL_SQL} SELECT p_partkey, kind FROM mailboxes")
def mailbox_type(spark, d):
    return mailboxes(spark, d).select("p_partkey", emails.quality_type(F.col("email")).alias("kind"))


@query(f"SELECT p_partkey, CASE WHEN list_has_any({_TOKENS_SQL}, {list(emails.SCAN_JOB)}) THEN 'job_or_recruitment' WHEN list_has_any({_TOKENS_SQL}, {list(emails.GENERAL)}) THEN 'general_business' ELSE 'excluded_non_role' END AS kind FROM part")
def scan_mailbox_type(spark, d):
    return mailboxes(spark, d).select("p_partkey", emails.mailbox_type(F.col("email")).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'jobs' || p_partkey || '@example.com' WHEN p_partkey % 3 = 1 THEN '' ELSE 'a.b@sub.example.org' END AS email FROM part")
def normalize_email(spark, d):
    p = table(spark, d, "part")
    raw = F.when(p["p_partkey"] % 3 == 0, F.concat(F.lit("MAILTO:Jobs"), p["p_partkey"].cast("string"), F.lit("@Example.COM?subject=CV"))).when(p["p_partkey"] % 3 == 1, "bad..name@logo.png").otherwise("<A.B%40Sub.Example.org>,")
    return p.select("p_partkey", emails.normalized(raw).alias("email"))


@query(f"WITH {_JUDGED_SQL} SELECT p_partkey, status, CAST(score AS INTEGER) AS score FROM judged")
def verification_decision(spark, d):
    df = contacts.gate(mailboxes(spark, d))
    return df.select("p_partkey", F.col("verification_status").alias("status"), F.col("priority_score").alias("score"))


@query(f"""WITH {_JUDGED_SQL}, ok AS (SELECT * FROM judged WHERE kind <> 'excluded'), ranked AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY score DESC, organization, source_url) AS n FROM ok),
 orgs AS (SELECT email, organization, min(n) AS o FROM ranked GROUP BY 1, 2), names AS (SELECT email, string_agg(organization, ' | ' ORDER BY o) AS organization_aliases FROM orgs GROUP BY 1)
 SELECT email, organization, status AS verification_status, CAST(score AS INTEGER) AS priority_score, (SELECT count(*) FROM ok o WHERE o.email = r.email) AS sightings, organization_aliases FROM ranked r JOIN names USING (email) WHERE n = 1""")
def contact_dedup(spark, d):
    return contacts.clean(contacts.gate(mailboxes(spark, d))).select("email", "organization", "verification_status", "priority_score", "sightings", "organization_aliases")


@query(f"""WITH {_JUDGED_SQL}, best AS (SELECT email, arg_max(organization, score) AS x, max(score) AS score, max(CASE WHEN kind = 'job_or_recruitment' THEN 1 ELSE 0 END) AS job, max(CASE WHEN routed THEN 1 ELSE 0 END) AS routed, min(kind) AS kind FROM judged WHERE kind <> 'excluded' GROUP BY email),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY score DESC, organization, source_url) AS n FROM judged WHERE kind <> 'excluded')
 SELECT count(*) AS contacts, count(*) FILTER (WHERE status = 'verified_official_job_mailbox') AS job, count(*) FILTER (WHERE status = 'verified_official_general_mailbox') AS general, count(*) FILTER (WHERE status = 'manual_review_dns') AS review, count(DISTINCT email) AS emails, count(DISTINCT organization) AS organizations FROM ranked WHERE n = 1""")
def contact_summary(spark, d):
    return contacts.summary(contacts.clean(contacts.gate(mailboxes(spark, d))))


@query(f"WITH {_JUDGED_SQL} SELECT organization, email, max(score) AS score FROM judged WHERE kind <> 'excluded' GROUP BY 1, 2")
def contact_best(spark, d):
    df = contacts.gate(mailboxes(spark, d)).where("NOT excluded").withColumn("k", F.concat_ws(" ", "organization", "email"))
    return dedup.best_per(df, "k", F.desc("priority_score"), "source_url", "p_partkey").select("organization", "email", F.col("priority_score").alias("score"))


def full_registry(spark, d):
    latest = ledger.health_latest(health(spark, d))
    text_health = latest.withColumns({"last_success_at": F.coalesce(F.date_format("last_success_at", "yyyy-MM-dd HH:mm"), F.lit("")), "last_attempt_at": F.date_format("last_attempt_at", "yyyy-MM-dd HH:mm")})
    return coverage.company_registry(registry(spark, d), jobs(spark, d), text_health, literal(AS_OF))


@query(f"WITH {PROVEN_SQL} SELECT company_id, jobs_found_today, jobs_found_30d, last_job_seen_at FROM full_registry")
def company_job_counts(spark, d):
    return full_registry(spark, d).select("company_id", "jobs_found_today", "jobs_found_30d", "last_job_seen_at")


@query(f"WITH {PROVEN_SQL} SELECT company_id, passing_source_count, last_success_at FROM full_registry")
def health_by_source(spark, d):
    return full_registry(spark, d).select("company_id", "passing_source_count", "last_success_at")


@query(f"WITH {HEALTH_SQL} SELECT source_id, source_name, last_attempt_at, last_success_at, status, records_found, error_message FROM health")
def source_health_latest(spark, d):
    return ledger.health_latest(health(spark, d))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in coverage.STATUSES)


@query(f"WITH {REGISTRY_SQL} SELECT country, count(*) AS target_companies, {_COUNTS}, count(*) FILTER (WHERE status LIKE 'ACTIVE%') AS active_coverage, round_even(count(*) FILTER (WHERE status LIKE 'ACTIVE%') * 100.0 / count(*), 1) AS coverage_percent FROM registry GROUP BY 1")
def country_company_matrix(spark, d):
    return coverage.country_matrix(registry(spark, d))


_NAMED = "count(*) FILTER (WHERE status = 'STAGED_NEEDS_LIVE_PROOF') AS staged_sources, count(*) FILTER (WHERE status = 'BLOCKED_RESTRICTED') AS blocked_sources, count(*) FILTER (WHERE status = 'NO_SOURCE_FOUND') AS no_source_found, CAST(sum(jobs_found_today) AS BIGINT) AS jobs_found_today, CAST(sum(jobs_found_30d) AS BIGINT) AS jobs_found_30d, max(last_success_at) AS last_successful_scan"


def _active_sql(more: str) -> str:
    names = {"ACTIVE_DIRECT": "active_direct_sources", "ACTIVE_GMAIL_ALERT": "active_gmail_sources", "ACTIVE_PUBLIC_NOTICE": "public_notice_sources", "ACTIVE_MANUAL_IMPORT": "manual_import_sources"}
    return ", ".join(f"count(*) FILTER (WHERE status = '{s}'{more}) AS {n}" for s, n in names.items())


@query(f"WITH {PROVEN_SQL} SELECT country, count(*) AS total_target_companies, {_active_sql('')}, {_NAMED}, round_even(count(*) FILTER (WHERE status LIKE 'ACTIVE%') * 100.0 / count(*), 1) AS coverage_percentage FROM full_registry GROUP BY 1")
def country_coverage(spark, d):
    return coverage.country_coverage(full_registry(spark, d))


@query(f"WITH {PROVEN_SQL} SELECT country, count(*) AS total_target_companies, count(*) FILTER (WHERE coverage_ready) AS configured_coverage_paths, count(*) FILTER (WHERE coverage_proven) AS proven_operational_coverage, {_active_sql(' AND coverage_proven')}, {_NAMED}, count(*) FILTER (WHERE coverage_ready AND NOT coverage_proven) AS unproven_configured_paths, round_even(count(*) FILTER (WHERE coverage_proven) * 100.0 / count(*), 1) AS coverage_percentage FROM proven GROUP BY 1")
def proof_coverage(spark, d):
    return coverage.proof_coverage(coverage.prove(full_registry(spark, d)))


@query(f"WITH {REGISTRY_SQL} SELECT ats_family, count(*) AS target_companies, count(*) FILTER (WHERE status = 'ACTIVE_DIRECT') AS active_direct, count(*) FILTER (WHERE status LIKE 'ACTIVE%' AND status <> 'ACTIVE_DIRECT') AS active_alternative, count(*) FILTER (WHERE status = 'STAGED_NEEDS_LIVE_PROOF') AS staged, count(*) FILTER (WHERE status IN ('BLOCKED_RESTRICTED', 'NO_SOURCE_FOUND')) AS blocked FROM registry GROUP BY 1")
def ats_coverage(spark, d):
    return coverage.ats_coverage(registry(spark, d))


_GAP = "CASE status WHEN 'STAGED_NEEDS_LIVE_PROOF' THEN 'live_contract_proof' WHEN 'BLOCKED_RESTRICTED' THEN 'restricted_source' WHEN 'NO_SOURCE_FOUND' THEN 'source_discovery' END"


@query(f"WITH {REGISTRY_SQL} SELECT company_id, status, {_GAP} AS gap_type FROM registry WHERE status NOT LIKE 'ACTIVE%'")
def coverage_gaps(spark, d):
    return coverage.gaps(registry(spark, d)).select("company_id", "status", "gap_type")


@query(f"WITH {PROVEN_SQL} SELECT company_id, CASE WHEN coverage_ready THEN 'configured_unproven' ELSE 'not_configured' END AS proof_state, CASE WHEN coverage_ready THEN 'configured_but_unproven' ELSE coalesce({_GAP}, 'coverage_missing') END AS gap_type FROM proven WHERE NOT coverage_proven")
def proof_gaps(spark, d):
    return coverage.proof_gaps(coverage.prove(full_registry(spark, d))).select("company_id", "proof_state", "gap_type")


#: A day on which part of the sources' last successes are too old.
STALE_AS_OF = "2024-02-06 18:00:00"


@query(f"WITH {REGISTRY_SQL}, {HEALTH_SQL} SELECT r.company_id FROM registry r LEFT JOIN health h ON h.source_id = r.company_id WHERE r.status = 'ACTIVE_DIRECT' AND (h.last_success_at IS NULL OR h.last_success_at < TIMESTAMP '{STALE_AS_OF}' - INTERVAL 7 DAY)")
def stale_sources(spark, d):
    h = ledger.health_latest(health(spark, d)).select("source_id", dates.utc_text(F.col("last_success_at")).alias("at"))
    r = registry(spark, d).drop("last_success_at")
    df = r.join(h, r["company_id"] == h["source_id"], "left").withColumn("last_success_at", F.coalesce("at", F.lit("")))
    return coverage.stale(df, literal(STALE_AS_OF)).select("company_id")


@query(f"WITH {REGISTRY_SQL} SELECT company_id, CASE WHEN status = 'STAGED_NEEDS_LIVE_PROOF' THEN 'Run bounded live contract proof, retain evidence, then enable only after tests pass.' WHEN status = 'BLOCKED_RESTRICTED' THEN 'Use authorized Gmail alerts or private EML/PDF/image import; do not bypass restrictions.' WHEN status = 'NO_SOURCE_FOUND' THEN 'Verify official careers site, talent community, public notices and recruiter channels.' WHEN source_mode = 'public_notice' THEN 'Implement HTML/PDF notice collector with closing-date and corrigendum tracking.' WHEN source_mode = 'gmail_alert' THEN 'Authorize Gmail locally and prove employer/portal alert query coverage.' WHEN source_mode = 'manual_import' THEN 'Retain official files locally and route uncertain extraction to Manual_Review.' ELSE 'Maintain health checks and evidence proof.' END AS action FROM registry")
def next_action(spark, d):
    return registry(spark, d).select("company_id", coverage.next_action(F.col("status"), F.col("source_mode")).alias("action"))


@query(f"WITH {REGISTRY_SQL} SELECT company_id, CASE WHEN k % 10 = 0 THEN 'BLOCKED_RESTRICTED' ELSE status END AS status, CASE WHEN k % 10 = 0 THEN '' ELSE ats_family END AS ats_family FROM registry")
def override_update(spark, d):
    r = registry(spark, d)
    o = r.where(F.col("company_id").cast("long") % 10 == 0).select("company_id", F.lit("BLOCKED_RESTRICTED").alias("status"), F.lit("").alias("ats_family"))
    return coverage.override(r, o).select("company_id", "status", "ats_family")


@query(f"WITH {REGISTRY_SQL} SELECT company_id, source_mode, status FROM registry WHERE source_mode = 'public_notice' OR (alert_supported AND status <> 'BLOCKED_RESTRICTED')")
def notice_and_alert_views(spark, d):
    r = registry(spark, d)
    return coverage.notices(r).unionByName(coverage.alert_capable(r)).select("company_id", "source_mode", "status").distinct()


_ALIAS = "SELECT company_id, company, 'Customer#' || lpad(company_id, 9, '0') AS alias FROM registry UNION ALL SELECT company_id, company, 'Entity ' || company_id FROM registry UNION ALL SELECT company_id, company, company FROM registry"


@query(f"WITH {REGISTRY_SQL} {_ALIAS} UNION ALL SELECT company_id, company, 'CUSTOMER#' || lpad(company_id, 9, '0') FROM registry UNION ALL SELECT company_id, company, upper(company) FROM registry")
def alias_distinct_exact(spark, d):
    return coverage.company_aliases(registry(spark, d))


@query(f"WITH {REGISTRY_SQL} {_ALIAS}")
def alias_distinct_ci(spark, d):
    return coverage.company_aliases(registry(spark, d), ignore_case=True)


@query("""SELECT CAST(g + 1 AS INTEGER) AS query_group, count(*) AS terms, 'newer_than:30d (' || string_agg('"' || s_name || '"', ' OR ' ORDER BY lower(s_name)) || ')' AS query FROM (SELECT s_name, (row_number() OVER (ORDER BY lower(s_name)) - 1) // 25 AS g FROM (SELECT DISTINCT s_name FROM supplier)) GROUP BY g""")
def query_chunks(spark, d):
    return coverage.query_groups(table(spark, d, "supplier"), "s_name")


@query("SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) % 6 AS shard FROM supplier")
def shard_assignment(spark, d):
    return dedup.dealt_shards(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], 6)


@query(f"WITH {JOBS_SQL} SELECT company AS \"Company\", title AS \"Job Title\", published_at AS \"Published\", match_score AS \"Match Score\" FROM jobs WHERE found_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY")
def recent_export(spark, d):
    return reports.recent_export(jobs(spark, d), literal(AS_OF)).select("Company", "Job Title", "Published", "Match Score")


@query(f"WITH {JOBS_SQL} SELECT job_key, CASE WHEN CAST(published_at AS TIMESTAMP) > TIMESTAMP '{AS_OF}' THEN 'future_date_review' WHEN CAST(published_at AS TIMESTAMP) >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'last_30_days' ELSE 'older' END AS status FROM jobs")
def publication_status(spark, d):
    return jobs(spark, d).select("job_key", dates.publication_status(dates.parsed(F.col("published_at")), literal(AS_OF)).alias("status"))


def dated_docs(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    df = doc_jobs(spark, d)
    return df.join(e, df["job_key"] == e["user_id"].cast("string"), "left").withColumns({"published_at": dates.utc_text(F.col("ts")), "match_score": (F.col("job_key").cast("long") % 101).cast("int")}).drop("ts", "user_id")


_REPORT_SQL = f"""dated AS (SELECT doc_id, text, max(ts) AS ts FROM documents LEFT JOIN events ON user_id = doc_id GROUP BY 1, 2), body AS (SELECT *, lower(trim(regexp_replace({FIRST_LINE}, '\\s+', ' ', 'g')) || '  ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS s FROM dated WHERE {any_sql('lower(text)', ('the', 'und'))}),
 marked AS (SELECT CAST(doc_id AS VARCHAR) AS job_key, CASE WHEN ts IS NULL THEN 'date_unknown' WHEN date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-28 00:00:00' AND TIMESTAMP '2024-01-30 06:00:00' THEN 'confirmed_48h' ELSE 'older' END AS date_status, CASE WHEN {any_sql('s', reports.URGENT)} THEN 'urgent' ELSE 'normal' END AS urgency, {any_sql('s', reports.SENIOR)} OR doc_id % 101 >= 70 AS senior_fit FROM body)"""


def report_rows(spark, d):
    return reports.classify(dated_docs(spark, d), literal("2024-01-30 00:00:00"), relevant=("the", "und"))


@query(f"WITH {_REPORT_SQL} SELECT job_key, date_status, urgency, senior_fit FROM marked")
def report_48h(spark, d):
    return reports.report(report_rows(spark, d)).select("job_key", "date_status", "urgency", "senior_fit")


@query(f"WITH {_REPORT_SQL} SELECT count(*) AS relevant, count(*) FILTER (WHERE date_status = 'confirmed_48h') AS confirmed, count(*) FILTER (WHERE date_status = 'confirmed_48h' AND urgency = 'urgent') AS confirmed_urgent, count(*) FILTER (WHERE date_status = 'date_unknown' AND urgency = 'urgent') AS urgent_unknown FROM marked")
def report_48h_metrics(spark, d):
    return reports.report_metrics(reports.report(report_rows(spark, d))).drop("countries", "locations")


#: Postings made of orders for the shortlist: titles, places and closing texts that pass and that fail each rule.
_CITY = ("Mumbai / Pune", "navi mumbai", "Thane and Mumbai", "London", "Pune")


def shortlist_jobs(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    df = o.select(k.cast("string").alias("job_key"), pick(("Lead Piping Engineer", "Civil piping lead", "E3D Designer"), k).alias("title"), F.lit("Acme").alias("company"), pick(_CITY, k).alias("location"), pick(("open", "Position has been closed"), k / 3).alias("description"), F.date_format("o_orderdate", "d MMM yyyy").alias("published_at"), F.concat(F.lit("https://jobs.example.com/"), (k % 2000).cast("string"), F.lit("/#a")).alias("apply_url"), (k % 101).cast("int").alias("match_score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_seen_at"))
    return schemas.conform(df, schemas.JOB)


_CITIES = (("Mumbai", "India", ("mumbai",)), ("Navi Mumbai", "India", ("navi mumbai",)), ("Thane", "India", ("thane",)), ("Pune", "India", ("pune",)))


@query(f"""WITH s AS (SELECT *, o_orderkey % 5 AS c FROM orders WHERE o_orderkey % 3 <> 1 AND CAST(floor(o_orderkey / 3) AS BIGINT) % 2 = 0 AND o_orderkey % 5 IN (0, 1, 2)),
 best AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey % 2000 ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey % 101 DESC, ['Lead Piping Engineer', 'Civil piping lead', 'E3D Designer'][o_orderkey % 3 + 1], CAST(o_orderkey AS VARCHAR)) AS n FROM s)
 SELECT 'https://jobs.example.com/' || (o_orderkey % 2000) || '/#a' AS apply_url, CAST(o_orderkey % 101 AS INTEGER) AS match_score, CASE c WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Navi Mumbai' ELSE 'Mumbai; Thane' END AS cities,
 CASE WHEN o_orderdate > TIMESTAMP '{AS_OF}' THEN 'future_date_review' WHEN o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'last_30_days' ELSE 'older' END AS publication_status FROM best WHERE n = 1""")
def shortlist(spark, d):
    out = reports.shortlist(shortlist_jobs(spark, d), Taxonomy(cities=_CITIES), ("Mumbai", "Navi Mumbai", "Thane"), literal(AS_OF))
    return out.select("apply_url", "match_score", F.array_join("target_cities", "; ").alias("cities"), "publication_status")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders")
def union_replace_by_key(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return ledger.replace_by_key([o, o.where("k % 2 = 0").withColumn("price", F.col("price") + 1)], ["k"])


@query("SELECT sha256(text) AS text_sha, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def first_seen_distinct(spark, d):
    return dedup.first_seen(table(spark, d, "documents").select(F.sha2("text", 256).alias("text_sha"), "doc_id"), ["text_sha"], "doc_id")


def unescaped_sql(x: str) -> str:
    """Character references that the pages use, resolved."""
    for name, char in (("copy", "'©'"), ("middot", "'·'"), ("nbsp", "chr(160)"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)")):
        x = f"replace({x}, '&{name};', {char})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def untagged_sql(x: str) -> str:
    return f"trim(regexp_replace({unescaped_sql(f"regexp_replace({x}, '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))"


def without_sql(x: str, tags: tuple[str, ...], instead: str) -> str:
    for t in tags:
        x = f"regexp_replace({x}, '<{t}[ >].*?</{t}>', {instead}, 'gs')"
    return x


_VISIBLE_SQL = f"regexp_replace({without_sql(without_sql('html', ('script', 'style', 'title', 'noscript', 'template'), chr(39) * 2), ('nav', 'header', 'footer', 'form'), 'chr(10)')}, '<!--.*?-->', '', 'gs')"
_LINED_SQL = f"regexp_replace(regexp_replace({_VISIBLE_SQL}, '</?({'|'.join(sorted(html.BLOCKS))})( [^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"


@query(f"""WITH found AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1) AS h, regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>(.*?)</a>', 1) AS t FROM pages), each AS (SELECT page_id, h, t, unnest(range(len(h))) AS position FROM found)
 SELECT page_id, CAST(position AS INTEGER) AS position, {unescaped_sql('h[position + 1]')} AS href, {untagged_sql('t[position + 1]')} AS anchor FROM each""")
def page_links(spark, d):
    return html.links(table(spark, d, "pages"), "page_id", "html")


@query(f"SELECT page_id, {untagged_sql("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')")} AS title FROM pages")
def page_title(spark, d):
    return html.titles(table(spark, d, "pages"), "page_id", "html")


@query(f"WITH raw AS (SELECT page_id, {unescaped_sql(_LINED_SQL)} AS s FROM pages) SELECT page_id, array_to_string([x for x in [trim(regexp_replace(y, '[\\s\\x{{a0}}]+', ' ', 'g')) for y in string_split(s, chr(10))] if x <> ''], chr(10)) AS body FROM raw")
def page_text(spark, d):
    return html.body_text(table(spark, d, "pages"), "page_id", "html")


@query("""WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), placed AS (SELECT doc_id, l, unnest(range(len(l))) AS line FROM lines)
 SELECT doc_id, CAST(line AS INTEGER) AS line, array_to_string(list_slice(l, greatest(line - 3, 0) + 1, line + 4), chr(10)) AS near FROM placed WHERE regexp_matches(l[line + 1], '(license|License|reserved)')""")
def line_window(spark, d):
    return mail.line_neighbourhoods(table(spark, d, "documents"), "doc_id", "text", "(license|License|reserved)")


def halves(spark, d):
    """Documents as a stored ledger (even ids) and an incoming batch (all ids divisible by 4 again, and the odd ones)."""
    df = doc_jobs(spark, d).where("title <> '' AND company <> ''")
    # a ledger is a stored table
    stored = written(ledger.identified(df.where("CAST(job_key AS BIGINT) % 2 = 0")), "ledger")
    coming = df.withColumn("seq", F.col("job_key").cast("long")).where("seq % 4 = 0 OR seq % 2 = 1")
    return stored, coming


@query(f"""WITH d AS (SELECT doc_id, {FIRST_LINE} AS title, 'https://example.com/jobs/' || doc_id AS canonical_url FROM documents WHERE {FIRST_LINE} <> '' AND source <> '')
 SELECT CAST(doc_id AS VARCHAR) AS job_key, CAST(NULL AS BIGINT) AS seq, 'stored' AS action, canonical_url, title FROM d UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id, CASE WHEN doc_id % 2 = 0 THEN 'updated' ELSE 'new' END, canonical_url, title FROM d WHERE doc_id % 4 = 0 OR doc_id % 2 = 1""")
def ledger_merge(spark, d):
    stored, coming = halves(spark, d)
    merged = ledger.merge(stored, ledger.aliases_of(stored), coming)
    return merged.select("job_key", "seq", "action", "canonical_url", "title")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS match FROM documents WHERE {FIRST_LINE} <> '' AND source <> '' AND (doc_id % 4 = 0 OR doc_id % 2 = 1)")
def identity_resolve(spark, d):
    stored, coming = halves(spark, d)
    new = ledger.identified(coming).withColumn("id", F.col("job_key"))
    return ledger.resolve(new, stored, ledger.aliases_of(stored))


@query("SELECT doc_id, CASE WHEN substr(ltrim(s), 1, 1) IN ('=', '+', '-', '@') THEN '''' || s ELSE s END AS safe FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '=' || text ELSE text END AS s FROM documents)")
def formula_guard(spark, d):
    s = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("="), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.formula_safe(s).alias("safe"))


@query(r"SELECT doc_id, replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '|', '\|') AS cell FROM documents")
def markdown_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", text.markdown_cell(F.col("text")).alias("cell"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '-') AS slug FROM part")
def slugs(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query(f"WITH {HEALTH_SQL} SELECT count(*) AS sources_attempted, count(*) FILTER (WHERE status <> 'fail') AS sources_passed, count(*) FILTER (WHERE status = 'fail') AS sources_failed, CAST(sum(records_found) AS BIGINT) AS jobs_found, CASE WHEN count(*) FILTER (WHERE status <> 'fail') = count(*) THEN 'pass' WHEN count(*) FILTER (WHERE status <> 'fail') = 0 THEN 'fail' ELSE 'partial' END AS status FROM health")
def run_totals(spark, d):
    h = ledger.health_latest(health(spark, d)).select("status", F.col("records_found").alias("jobs_found"), F.lit(0).alias("jobs_new"), F.lit(0).alias("jobs_updated"))
    return integrity.run_totals(h).drop("jobs_new", "jobs_updated")


@query("SELECT source AS source_id, sha256(text) AS fingerprint, count(*) AS pages FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_pages(spark, d):
    return integrity.repeated_pages(table(spark, d, "documents").select(F.col("source").alias("source_id"), "text"), "text")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'missing' WHEN n_nationkey % 3 = 1 THEN 'pass' ELSE 'fail' END AS status FROM nation")
def shard_status(spark, d):
    n = table(spark, d, "nation")
    found = n.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 1, "pass").otherwise("fail").alias("status"))
    return integrity.shard_status(n.select(F.col("n_nationkey").alias("id")), found)
