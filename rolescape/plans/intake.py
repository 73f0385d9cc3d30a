"""Named queries of what comes in: notices, alerts, discovery, imports, runs and shards, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescape.config import TERMS, WEIGHTS, Profile
from rolescape.functions import emails, notices
from rolescape.operators import coverage, discovery, integrity, ledger, reports, scoring
from rolescape.plans.adapters import AS_OF, HEALTH_SQL, PROVEN_SQL, REGISTRY_SQL, health, literal, registry, table
from rolescape.plans.catalog import any_sql, query, unescaped_sql
from rolescape.schemas import JOB, conform
from rolescape.sources import listings, mail
from rolescape.sources import notices as scans

#: Sentences that parts are given in turn, so that notices, alerts and postings have something to find.
SENTENCES = (
    "Recruitment of engineers: last date 31.12.2025 for the online form", "Corrigendum dated 5 March 2024 on the vacancy", "Result of the written test, shortlisted names", "Walk-in interview, published on 01/02/2024, apply by April 5, 2024",
    "Extension of deadline: online application is open until 12-11-2024", "Post date: 3.4.2024 Addendum to the advertisement", "Frequently asked questions", "Senior piping engineer with AVEVA E3D, 12 years, Navi Mumbai",
    "Lead Piping Engineer for an offshore refinery, diploma", "Piping layout and plot plan for nuclear work in Oman, degree required", "Pipe support designer, site experience and punch list", "Write to hr.desk@example.com or noreply@example.com",
    "Job title: SP3D piping designer", "Location: Pune; ask jobs@mail.example.org",
)
ADDRESSES = ("https://boards.greenhouse.io/acme/", "https://example.com/jobs/", "https://example.com/careers/job/", "https://example.com/about/", "http://acme.myworkdayjobs.com/x#", "https://example.com/help/jobs/", "https://example.com/viewjob?jobid=", "ftp://example.com/job/", "https://example.com/contact.pdf?", "https://example.com/unsubscribe/")


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def pick_sql(values: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{at} % {len(values)} + 1]"


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as texts of three lines with a link."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.concat_ws("\n", pick(SENTENCES, k), pick(SENTENCES, F.floor(k / 3)), "p_name").alias("body"), F.concat(pick(ADDRESSES, F.floor(k / 5)), k.cast("string")).alias("url"))


NOTES_SQL = f"notes AS (SELECT p_partkey AS id, {pick_sql(SENTENCES, 'p_partkey')} || chr(10) || {pick_sql(SENTENCES, '(p_partkey // 3)')} || chr(10) || p_name AS body, {pick_sql(ADDRESSES, '(p_partkey // 5)')} || p_partkey AS url FROM part)"
_DATE_SQL = notices.DATE.replace("'", "''")


def bare(pattern: str) -> str:
    return pattern.removeprefix("(?i)").replace("'", "''")


@query(f"WITH {NOTES_SQL} SELECT id, CASE WHEN contains(lower(body), 'corrigendum') THEN 'corrigendum' WHEN contains(lower(body), 'addendum') THEN 'addendum' WHEN contains(lower(body), 'extension') AND (contains(lower(body), 'deadline') OR contains(lower(body), 'last date')) THEN 'deadline_extension' WHEN contains(lower(body), 'walk-in') OR contains(lower(body), 'walk in') THEN 'walk_in' ELSE 'advertisement' END AS kind FROM notes")
def notice_kind(spark, d):
    return notes(spark, d).select("id", notices.kind(F.col("body")).alias("kind"))


@query(f"WITH {NOTES_SQL} SELECT id, trim(regexp_extract(body, '{bare(notices.CLOSES)}', 1, 'i')) AS closing, trim(regexp_extract(body, '{bare(notices.PUBLISHED)}', 1, 'i')) AS published, trim(regexp_extract(body, '{bare(notices.POSTED)}', 1, 'i')) AS posted FROM notes")
def notice_dates(spark, d):
    b = F.col("body")
    return notes(spark, d).select("id", notices.closing(b).alias("closing"), notices.published(b).alias("published"), notices.posted(b).alias("posted"))


@query(f"WITH {NOTES_SQL} SELECT id, {any_sql('lower(body)', notices.INCLUDE)} AND NOT {any_sql('lower(body)', notices.EXCLUDE)} AS is_notice, {any_sql('lower(body)', notices.INCLUDE)} AS with_follow_ups, {any_sql('lower(body)', notices.AUXILIARY)} AS auxiliary FROM notes")
def notice_filter(spark, d):
    b = F.col("body")
    return notes(spark, d).select("id", notices.is_notice(b).alias("is_notice"), notices.is_notice(b, follow_ups=True).alias("with_follow_ups"), notices.is_auxiliary(b).alias("auxiliary"))


@query(f"WITH {NOTES_SQL} SELECT id FROM notes WHERE (contains(lower(body), 'piping') OR contains(lower(body), 'vacancy')) AND contains(lower(body), 'e') AND NOT contains(lower(body), 'diploma')")
def anchor_filter(spark, d):
    return notes(spark, d).where(notices.anchor_passes(F.col("body"), ("Piping", "vacancy"), ("e",), ("diploma",))).select("id")


_LINK_SQL = f"regexp_matches(lower(url), '^https?://') AND NOT {any_sql('lower(url)', mail.NO_JOB)} AND ({any_sql('lower(url)', mail.JOB_URL)} OR {any_sql('lower(body)', mail.ROLE)})"


@query(f"WITH {NOTES_SQL} SELECT id, url FROM notes WHERE {_LINK_SQL}")
def alert_links(spark, d):
    return notes(spark, d).where(mail.is_job_link(F.col("url"), F.col("body"))).select("id", "url")


_CONTACT_SQL = "coalesce([x for x in regexp_extract_all(lower({}), '\\b[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}\\b') if x <> {} AND NOT contains(x, 'noreply') AND NOT contains(x, 'no-reply') AND NOT contains(x, 'donotreply')][1], '')"


@query(f"WITH {NOTES_SQL} SELECT id, {_CONTACT_SQL.format('body', chr(39) + 'hr.desk@example.com' + chr(39))} AS contact FROM notes")
def public_contact(spark, d):
    return notes(spark, d).select("id", emails.public_contact(F.col("body"), F.lit("HR <HR.Desk@example.com>")).alias("contact"))


@query(f"""WITH {NOTES_SQL}, made AS (SELECT id, url, CASE WHEN id % 4 = 0 THEN 'Unknown employer' ELSE 'Acme ' || id END AS company, id % 4 = 0 AS unknown, {_CONTACT_SQL.format("'subject: alert' || chr(10) || 'from: alerts@portal.example' || chr(10) || body || chr(10)", chr(39) + 'alerts@portal.example' + chr(39))} AS recruiter_email FROM notes)
 SELECT id, company, recruiter_email, CASE WHEN recruiter_email <> '' THEN 'ALERT_SUPPLIED' ELSE '' END AS contact_confidence, CASE WHEN recruiter_email <> '' THEN url ELSE '' END AS contact_source_url, 'gmail:Portal' AS source_name, CASE WHEN unknown THEN 'review_required' ELSE 'new' END AS application_status FROM made""")
def alert_jobs(spark, d):
    a = notes(spark, d).select("id", "url", F.col("body").alias("context"), F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("Acme "), F.col("id").cast("string"))).alias("company"), F.lit("Alert").alias("subject"), F.lit("alerts@portal.example").alias("sender"), F.lit("Portal").alias("portal"), F.lit("").alias("body"))
    return mail.alert_jobs(a).select("id", "company", "recruiter_email", "contact_confidence", "contact_source_url", "source_name", "application_status")


@query(f"""WITH {NOTES_SQL}, lined AS (SELECT id, trim(regexp_replace(left(trim(regexp_extract(body, '(?:^|\\n)\\s*(?:job title|position|role)\\s*:\\s*([^\\n|;]{{2,180}})', 1, 'i')), 180), '\\s+', ' ', 'g')) AS labelled, [trim(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' -:|') for x in string_split(body, chr(10))] AS l FROM notes)
 SELECT id, CASE WHEN labelled <> '' THEN labelled ELSE coalesce([x for x in l if len(x) BETWEEN 4 AND 160 AND {any_sql('lower(x)', mail.ROLE)}][1], 'file ' || id) END AS title FROM lined""")
def inferred_title(spark, d):
    return notes(spark, d).select("id", mail.inferred_title(F.col("body"), F.concat(F.lit("file "), F.col("id").cast("string"))).alias("title"))


_HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_FOUND_SQL = f"regexp_matches(url, '^https?://[^/?#]') AND ({any_sql(_HOST_SQL, discovery.ATS_HOSTS)} OR {any_sql('lower(url)', discovery.JOB_URL_HINTS)})"


@query(f"WITH {NOTES_SQL}, found AS (SELECT id % 50 AS page, id, split_part(url, '#', 1) AS url FROM notes WHERE {_FOUND_SQL}), once AS (SELECT page, url, min(id) AS id FROM found GROUP BY 1, 2) SELECT page, url, id FROM once QUALIFY row_number() OVER (PARTITION BY page ORDER BY id) <= 3")
def discovery_candidates(spark, d):
    links = notes(spark, d).select((F.col("id") % 50).alias("page"), "id", "url")
    return discovery.candidates(links, "url", "page", "id", 3).select("page", "url", "id")


@query(f"WITH {NOTES_SQL} SELECT id FROM notes WHERE regexp_matches(url, '^https?://[^/?#]') AND (contains(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || ' ' || body), 'job') OR contains(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || ' ' || body), 'contact') OR lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) LIKE '%.pdf')")
def hinted_links(spark, d):
    return notes(spark, d).where(discovery.is_hinted(F.col("url"), F.col("body"), ("job", "contact"))).select("id")


_TYPES = ("greenhouse", "lever", "workday", "oracle_hcm", "sitemap", "public_html")


def source_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    key = (k % 40).cast("string")
    return table(spark, d, "supplier").select(k.alias("id"), pick(_TYPES, k).alias("type"), F.concat(F.lit("Board"), key).alias("board_token"), F.when(k % 4 == 0, "eu").otherwise("").alias("region"), F.concat(F.lit("Site"), key).alias("site"), F.lit("https://h.example").alias("base_url"), F.lit("T").alias("tenant"), F.concat(F.lit("N"), key).alias("site_number"), F.concat(F.lit("https://Example.com/"), key).alias("url"), F.col("s_name").alias("company"))


_IDENTITY_SQL = f"""sources AS (SELECT s_suppkey AS id, {pick_sql(_TYPES, 's_suppkey')} AS type, s_suppkey % 40 AS k, s_name AS company, s_suppkey % 4 = 0 AS eu FROM supplier),
identified AS (SELECT id, company, type || chr(10) || lower(CASE type WHEN 'greenhouse' THEN 'Board' || k WHEN 'lever' THEN CASE WHEN eu THEN 'eu' ELSE 'global' END || ':Site' || k WHEN 'workday' THEN 'https://h.example:T:Site' || k WHEN 'oracle_hcm' THEN 'https://h.example:N' || k ELSE 'https://Example.com/' || k END) AS identity FROM sources)"""


@query(f"WITH {_IDENTITY_SQL} SELECT id, identity FROM identified")
def source_identity(spark, d):
    s = source_rows(spark, d)
    return s.select("id", discovery.source_identity(s).alias("identity"))


@query(f"WITH {_IDENTITY_SQL} SELECT min(id) AS id, identity FROM identified WHERE identity NOT IN (SELECT identity FROM identified WHERE id % 10 = 0) AND lower(company) NOT IN (SELECT lower(company) FROM identified WHERE id % 7 = 0) GROUP BY identity")
def new_sources(spark, d):
    s = source_rows(spark, d)
    s = s.select("id", F.upper("company").alias("company"), discovery.source_identity(s).alias("identity"))
    return discovery.new_sources(s, s.where("id % 10 = 0"), s.where("id % 7 = 0"), "id").select("id", "identity")


@query("SELECT count(*) AS detected, count(*) FILTER (WHERE p_size > 25) AS verified, CAST(sum(p_size) AS BIGINT) AS probe_jobs FROM part")
def discovery_totals(spark, d):
    return discovery.totals(table(spark, d, "part").select(F.when(F.col("p_size") > 25, "verified").otherwise("not_probed").alias("probe_status"), F.col("p_size").alias("probe_jobs")))


_SCORE_SQL = " + ".join(f"CASE WHEN {any_sql('s', TERMS[k])} THEN {w} ELSE 0 END" for k, w in WEIGHTS.items() if k != "recent_posting")


@query(f"""WITH {NOTES_SQL}, scored AS (SELECT id, CAST(least(100, {_SCORE_SQL}) AS INTEGER) AS match_score, array_to_string([x for x in [CASE WHEN NOT {any_sql('s', TERMS['target_role'])} THEN 'Target role wording not detected' ELSE '' END, CASE WHEN NOT {any_sql('s', TERMS['e3d_pdms'])} THEN 'E3D/PDMS/SP3D requirement not stated' ELSE '' END, CASE WHEN NOT {any_sql('s', TERMS['diploma_eligible'])} AND ({any_sql('s', tuple(x.replace("'", "''") for x in TERMS['mandatory_degree']))}) THEN 'Degree may be mandatory' ELSE '' END] if x <> ''], '; ') AS gaps FROM (SELECT id, lower(body) AS s FROM notes))
 SELECT id, match_score, coalesce(gaps, '') AS gaps, CASE WHEN match_score >= 85 THEN 'critical' WHEN match_score >= 70 THEN 'high' WHEN match_score >= 50 THEN 'normal' ELSE 'low' END AS priority FROM scored""")
def default_score(spark, d):
    df = conform(notes(spark, d).select(F.col("id").cast("string").alias("job_key"), F.col("body").alias("description")), JOB)
    return scoring.score(df, Profile(), literal(AS_OF)).select(F.col("job_key").cast("long").alias("id"), "match_score", "gaps", "priority")


_SHARD_FIELDS = "CAST(sum(n_nationkey + 2) AS BIGINT) AS sources_attempted, CAST(sum(n_nationkey) AS BIGINT) AS sources_passed, CAST(sum(2) AS BIGINT) AS sources_failed, CAST(sum(n_regionkey) AS BIGINT) AS jobs_collected, CAST(sum(n_regionkey + 1) AS BIGINT) AS new_jobs, CAST(sum(0) AS BIGINT) AS updated_jobs"


@query(f"SELECT *, CASE WHEN sources_attempted = 0 THEN 'no_sources' WHEN sources_passed = sources_attempted THEN 'pass' WHEN sources_passed = 0 THEN 'fail' ELSE 'partial' END AS collection_status FROM (SELECT count(*) AS shards_completed, {_SHARD_FIELDS} FROM nation)")
def shard_totals(spark, d):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return integrity.shard_totals(table(spark, d, "nation").select((n + 2).alias("sources_attempted"), n.alias("sources_passed"), F.lit(2).alias("sources_failed"), r.alias("jobs_collected"), (r + 1).alias("new_jobs"), F.lit(0).alias("updated_jobs")))


@query("SELECT event_type AS status, count(*) AS files, count(*) FILTER (WHERE value > 50) AS review_required FROM events GROUP BY 1")
def import_counts(spark, d):
    return integrity.counts_by_status(table(spark, d, "events").select(F.col("event_type").alias("status"), (F.col("value") > 50).alias("review_required")))


@query("SELECT CAST(user_id AS VARCHAR) AS sha256, CASE WHEN bool_or(event_type = 'purchase') THEN 'complete' ELSE 'staged' END AS status, coalesce(CAST(arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS VARCHAR), '') AS job_key, count(*) AS attempts FROM events GROUP BY user_id")
def import_states(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("sha256"), F.when(F.col("event_type") == "purchase", "complete").otherwise("staged").alias("status"), F.col("event_id").cast("string").alias("job_key"), F.struct("ts", "event_id").alias("at"))
    return ledger.import_states(e).select("sha256", "status", "job_key", "attempts")


@query("SELECT CAST(user_id % 200 AS VARCHAR) AS run_id, arg_max(event_type, (ts, event_id)) AS status, coalesce(string_agg(left(props, 2000), ' | ' ORDER BY ts, event_id) FILTER (WHERE event_type = 'error' AND props <> ''), '') AS error_message FROM events GROUP BY user_id % 200")
def run_rows(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 200).cast("string").alias("run_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"), F.when(F.col("event_type") == "error", F.coalesce("props", F.lit(""))).otherwise("").alias("error_message"))
    return ledger.run_rows(e).select("run_id", "status", "error_message")


@query("SELECT l_orderkey AS evidence_id, max(l_linenumber) AS size_bytes FROM lineitem GROUP BY 1")
def evidence_latest(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_linenumber").alias("size_bytes"))
    return ledger.latest_rows(rows, "evidence_id", "size_bytes")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity > 25)")
def evidence_deletes(spark, d):
    rows = table(spark, d, "lineitem")
    return ledger.without(rows.select("l_orderkey", "l_linenumber"), rows.where("l_quantity > 25"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'review_required' WHEN o_orderstatus = 'O' THEN 'new' ELSE 'applied' END AS application_status FROM orders")
def review_flag(spark, d):
    o = table(spark, d, "orders").withColumn("application_status", F.when(F.col("o_orderstatus") == "O", "new").otherwise("applied"))
    return ledger.flag_review(o, F.col("o_totalprice") > 100000).select("o_orderkey", "application_status")


@query("SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS s_name FROM customer")
def shared_columns(spark, d):
    target = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("c_custkey"), F.col("s_name").alias("c_name"), "s_name")
    c = table(spark, d, "customer")
    return ledger.in_shape(c, target)


@query("SELECT s_suppkey, array_to_string(list_sort([x for x in ['company', 'country', 'priority', 'status'] if NOT list_contains(CASE s_suppkey % 3 WHEN 0 THEN ['company', 'country', 'priority', 'status', 'extra'] WHEN 1 THEN ['status', 'company'] ELSE ['extra'] END, x)]), ',') AS missing FROM supplier")
def missing_fields(spark, d):
    k = F.col("s_suppkey")
    lists = lambda *x: F.array(*map(F.lit, x))
    s = table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, lists("company", "country", "priority", "status", "extra")).when(k % 3 == 1, lists("status", "company")).otherwise(lists("extra")).alias("present"))
    return integrity.missing_names(s, "present", ("status", "priority", "country", "company")).select("s_suppkey", F.array_join("missing", ",").alias("missing"))


@query("""SELECT source_id, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, coalesce(notices, 0) AS notices, coalesce(files, 0) > 0 AND coalesce(notices, 0) >= 30 AS proven FROM (SELECT l_suppkey AS source_id, count(*) AS files, CAST(sum(l_linenumber) AS BIGINT) AS bytes FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1)
 FULL JOIN (SELECT l_suppkey AS source_id, count(*) AS notices FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) USING (source_id)""")
def notice_proof(spark, d):
    rows = table(spark, d, "lineitem").withColumn("source_id", F.col("l_suppkey"))
    return integrity.proof_by_source(rows.where("l_suppkey % 5 <> 0").withColumn("size_bytes", F.col("l_linenumber")), rows.where("l_linenumber = 1"), 30)


@query(f"WITH {REGISTRY_SQL} SELECT count(*) AS companies, count(*) FILTER (WHERE status LIKE 'ACTIVE%') AS active, coalesce(round_even(100.0 * count(*) FILTER (WHERE status LIKE 'ACTIVE%' AND country = 'INDIA') / nullif(count(*) FILTER (WHERE country = 'INDIA'), 0), 1), 0) AS coverage_percentage FROM registry")
def coverage_totals(spark, d):
    r = registry(spark, d)
    companies = r.withColumn("coverage_active", F.col("status").startswith("ACTIVE"))
    counts = r.withColumns({"jobs_found_today": F.lit(0), "jobs_found_30d": F.lit(0)})
    return coverage.totals(companies, coverage.country_coverage(counts), "INDIA")


@query(f"WITH {PROVEN_SQL} SELECT country, company, priority FROM full_registry QUALIFY row_number() OVER (PARTITION BY country ORDER BY priority, company) <= 3")
def registry_head(spark, d):
    return reports.head_per(registry(spark, d), "country", 3, "priority", "company").select("country", "company", "priority")


@query(f"WITH {HEALTH_SQL} SELECT source_id FROM health WHERE last_success_at IS NULL OR status = 'fail' ORDER BY CAST(source_id AS BIGINT) LIMIT 100")
def first_unproven(spark, d):
    h = ledger.health_latest(health(spark, d))
    return reports.first_rows(h.where("last_success_at IS NULL OR status = 'fail'").select("source_id", F.col("source_id").cast("long").alias("o")), 100, "o").select("source_id")


_PAGE_LINKS_SQL = f"""found AS (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS t FROM pages),
each AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || {unescaped_sql('h[i + 1]')} AS target, {unescaped_sql('t[i + 1]')} AS title, i FROM (SELECT page_id, url, h, t, unnest(range(len(h))) AS i FROM found)),
kept AS (SELECT page_id, target, arg_min(title, i) AS title, min(i) AS i FROM each WHERE (contains(lower(title), 'th') OR contains(lower(title), 'ein')) AND NOT contains(lower(title), 'the') GROUP BY 1, 2)"""


@query(f"WITH {_PAGE_LINKS_SQL} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS position, target, title, title AS context, '' AS error FROM kept")
def notice_links(spark, d):
    return scans.links(table(spark, d, "pages"), "page_id", "url", "html", adaptive=False, include=("th", "ein"), exclude=("the",), max_items=None)


@query(f"WITH {_PAGE_LINKS_SQL} SELECT target AS apply_url, title, 'Notice kind: advertisement' || chr(10) || title AS description FROM kept")
def notice_jobs(spark, d):
    found = scans.links(table(spark, d, "pages"), "page_id", "url", "html", include=("th", "ein"), exclude=("the",), max_items=None)
    return scans.jobs(found, found.limit(0).select("target", F.col("context").alias("body")), "Notices", "Acme").select("apply_url", "title", "description")


BOARDS = ("https://boards.greenhouse.io/acme/jobs/", "https://jobs.eu.lever.co/site/", "https://jobs.lever.co/", "https://jobs.smartrecruiters.com/Id/", "https://api.smartrecruiters.com/v1/companies/Other/postings/", "https://t1.wd3.myworkdayjobs.com/en-US/Board/", "https://t2.myworkdayjobs.com/Board2/x", "https://h.fa.oraclecloud.com/hcmUI/sites/CX_1/job/", "https://example.com/jobs/")
_KIND_SQL = "CASE WHEN host = 'boards.greenhouse.io' AND p1 <> '' THEN 'greenhouse' WHEN host IN ('jobs.lever.co', 'jobs.eu.lever.co') AND p1 <> '' THEN 'lever' WHEN host IN ('jobs.smartrecruiters.com', 'api.smartrecruiters.com') THEN 'smartrecruiters' WHEN host LIKE '%.myworkdayjobs.com' THEN 'workday' WHEN host LIKE '%.oraclecloud.com' THEN 'oracle_hcm' ELSE '' END"


@query(f"""WITH links AS (SELECT p_partkey AS id, {pick_sql(BOARDS, 'p_partkey')} || p_partkey AS url FROM part), split AS (SELECT id, url, regexp_extract(url, '^https://([^/]+)', 1) AS host, string_split(regexp_extract(url, '^https://[^/]+/(.*)$', 1), '/') AS p FROM links),
 named AS (SELECT *, p[1] AS p1, {_KIND_SQL.replace('p1', 'p[1]')} AS type FROM split)
 SELECT id, type, CASE type WHEN 'greenhouse' THEN p1 ELSE '' END AS board_token, CASE WHEN type <> 'lever' THEN '' WHEN host LIKE 'jobs.eu.%' THEN 'eu' ELSE 'global' END AS region, CASE WHEN type = 'lever' THEN p1 WHEN type <> 'workday' THEN '' WHEN regexp_matches(p1, '^[a-z]{{2}}(-[A-Z]{{2}})?$') THEN p[2] ELSE p1 END AS site,
 CASE WHEN type <> 'smartrecruiters' THEN '' WHEN host = 'api.smartrecruiters.com' THEN p[3] ELSE p1 END AS company_identifier, CASE WHEN type IN ('workday', 'oracle_hcm') THEN 'https://' || host ELSE '' END AS base_url, CASE type WHEN 'workday' THEN split_part(host, '.', 1) ELSE '' END AS tenant, CASE type WHEN 'oracle_hcm' THEN p[list_position(p, 'sites') + 1] ELSE '' END AS site_number FROM named""")
def detected_sources(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), discovery.detected(F.concat(pick(BOARDS, k), k.cast("string"))).alias("s")).select("id", "s.*")


LISTED = ("Piping Engineer Job ID: #12 Navi Mumbai Full Time", "Designer job id: 7 Pune part time", "Checker", "Lead, Contract", "Stress Engineer JOB ID : A-1 Doha, Qatar Temporary")


@query(f"""WITH listed AS (SELECT p_partkey AS id, {pick_sql(LISTED, 'p_partkey')} || CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_name ELSE '' END AS t FROM part)
 SELECT id, CASE WHEN regexp_matches(t, '\\bJob ID\\s*:', 'i') THEN trim(regexp_extract(t, '^(.*?)\\bJob ID\\s*:', 1, 'i')) ELSE trim(t) END AS title, trim(regexp_extract(t, 'Job ID\\s*:\\s*#?\\S+\\s+(.+?)\\s+(?:Full Time|Part Time|Contract|Temporary)$', 1, 'i')) AS location,
 CASE WHEN regexp_matches(t, '\\bFull Time\\b', 'i') THEN 'Full Time' WHEN regexp_matches(t, '\\bPart Time\\b', 'i') THEN 'Part Time' WHEN regexp_matches(t, '\\bContract\\b', 'i') THEN 'Contract' WHEN regexp_matches(t, '\\bTemporary\\b', 'i') THEN 'Temporary' ELSE '' END AS job_type FROM listed""")
def listing_facts(spark, d):
    k = F.col("p_partkey")
    t = F.concat(pick(LISTED, k), F.when(k % 7 == 0, F.concat(F.lit(" "), "p_name")).otherwise(""))
    return table(spark, d, "part").select(k.alias("id"), listings.title(t).alias("title"), listings.location(t).alias("location"), listings.job_type(t).alias("job_type"))


@query(f"""WITH found AS (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1) AS h, regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1) AS t FROM pages),
each AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || {unescaped_sql('h[i + 1]')} AS target, {unescaped_sql('t[i + 1]')} AS anchor, i FROM (SELECT page_id, url, h, t, unnest(range(len(h))) AS i FROM found))
SELECT page_id, target AS url, arg_min(anchor, i) AS anchor, CAST(min(i) AS INTEGER) AS position FROM each WHERE (contains(lower(target), '/a') OR contains(lower(target), '/t')) AND (contains(lower(anchor), 'n') OR contains(lower(anchor), 'th')) AND contains(lower(anchor), 't') AND NOT contains(lower(anchor), 'and') GROUP BY 1, 2""")
def listing_links(spark, d):
    return listings.scan(table(spark, d, "pages"), "page_id", "url", "html", ("/a", "/t"), include=("n", "th"), required=("t",), excluded=("and",))
