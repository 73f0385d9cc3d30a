"""Small fixtures for functions, scoring, ledger, coverage, sources, sinks and streams."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolescape import config, schemas, sinks
from rolescape.functions import dates, emails, text, urls
from rolescape.operators import contacts, coverage, dedup, ledger, matching, reports, scoring
from rolescape.sources import html, mail, payloads, registry
from rolescape.streaming import ingest

#: A dictionary of the tests' own.
TAXONOMY = config.Taxonomy(
    roles=(("Lead Piping Engineer", ("lead piping engineer", "piping lead engineer")), ("Piping Design Engineer", ("piping design engineer",)), ("Lead Piping Design Engineer", ("lead piping design engineer", "piping design lead")), ("Senior Piping Layout Engineer", ("senior piping layout engineer",)), ("SP3D Piping Designer", ("sp3d piping designer",))),
    software=(("AVEVA E3D", ("aveva e3d", "e3d")), ("PDMS", ("pdms", "aveva pdms")), ("SP3D", ("sp3d", "smartplant 3d", "smart plant 3d")), ("Navisworks", ("navisworks",)), ("AutoCAD", ("autocad", "auto cad"))),
    sectors=(("Oil and Gas", ("oil and gas", "oil & gas", "upstream", "downstream")), ("Refinery", ("refinery", "refining")), ("Offshore", ("offshore", "topsides", "platform")), ("LNG", ("lng", "liquefied natural gas"))),
    employment=(("Permanent", ("permanent", "full time", "full-time")), ("Contract", ("contract", "contractual", "fixed term", "fixed-term")), ("Remote", ("remote", "work from home"))),
    cities=(("Mumbai", "India", ("mumbai", "bombay")), ("Navi Mumbai", "India", ("navi mumbai", "new mumbai")), ("Bengaluru", "India", ("bengaluru", "bangalore")), ("Abu Dhabi", "United Arab Emirates", ("abu dhabi",)), ("Doha", "Qatar", ("doha",)), ("London", "United Kingdom", ("london",))),
    countries=(("India", ("india",)), ("United Arab Emirates", ("united arab emirates", "uae", "emirates")), ("Saudi Arabia", ("saudi arabia", "ksa")), ("Qatar", ("qatar",)), ("United Kingdom", ("united kingdom", "uk", "great britain", "england", "scotland", "wales")), ("United States", ("united states", "usa", "u.s.a.")), ("Germany", ("germany",)), ("France", ("france",))),
    regions=(("Europe", ("europe", "european union")), ("Africa", ("africa",)), ("Middle East", ("middle east", "gulf", "gcc")), ("Worldwide", ("worldwide", "global", "international"))),
    negative_roles=("software developer", "accountant", "civil engineer", "electrical engineer"),
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def jobs(spark, *rows):
    df = spark.createDataFrame([{"title": "t", "company": "c"} | r for r in rows], "seq long, job_key string, title string, company string, location string, description string, apply_url string, source_name string, published_at string, found_at string, last_seen_at string, match_score int, match_reasons string, gaps string, priority string, normalized_role string, city string, country string, application_status string, recruiter_email string, closing_at string, source_url string")
    return schemas.conform(df, schemas.T.StructType([*schemas.JOB.fields, schemas.T.StructField("seq", schemas.T.LongType())]))


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("https://EXAMPLE.com/jobs/123/?reference=ABC&source_id=7&utm_source=mail&gclid=x#apply", "https://example.com/jobs/123?reference=ABC&source_id=7"),
        ("HTTP://a.b", "http://a.b/"), ("https://a.b/x?b=2&a=1&a=", "https://a.b/x?a=&a=1&b=2"), ("https://a.b/x?q=a%20b*~", "https://a.b/x?q=a+b%2A~"), ("", ""),
    ],
)
def test_canonical_url(spark, given, want):
    assert one(spark, urls.canonical(F.lit(given))) == want


@pytest.mark.parametrize(("given", "want"), [("MAILTO:Jobs@Example.COM?subject=CV", "jobs@example.com"), ("bad..name@example.com", ""), ("asset@logo.png", ""), ("nobody", ""), ("<a+b@x.co.uk>,", "a+b@x.co.uk")])
def test_normalized_email(spark, given, want):
    assert one(spark, emails.normalized(F.lit(given))) == want


def test_mailboxes(spark):
    kind = lambda e: one(spark, emails.quality_type(F.lit(e)))
    assert [kind(e) for e in ("u003ehr@x.com", "e-talent.legal@x.com", "info.hr@x.com", "careers@x.com", "jane@x.com")] == ["excluded", "excluded", "general_business", "job_or_recruitment", "excluded"]
    assert one(spark, emails.base_domain(F.lit("a.b.example.co.uk"))) == "example.co.uk"
    code = "12" + "".join(f"{ord(c) ^ 0x12:02x}" for c in "jobs@example.com")
    assert one(spark, emails.decoded_cloudflare(F.lit(code))) == "jobs@example.com" and one(spark, emails.decoded_cloudflare(F.lit("zz"))) == ""


def test_text_functions(spark):
    assert one(spark, text.contains_phrase(F.lit("indianapolis, indiana, united states"), "india")) is False
    assert one(spark, text.contains_phrase(F.lit("in abu\n dhabi."), "abu dhabi")) is True
    assert one(spark, text.slug(F.lit("L&T Energy Hydrocarbon"))) == "l-t-energy-hydrocarbon" and len(one(spark, text.slug(F.lit("A" * 100)))) == 44
    assert one(spark, text.percentage(F.lit(1), F.lit(16))) == 6.2 and one(spark, text.percentage(F.lit(1), F.lit(0))) == 0
    assert one(spark, text.closing_date_text(F.lit("x\nClosing date: 31  August 2026\ny"))) == "31 August 2026"
    assert one(spark, text.formula_safe(F.lit("=HYPERLINK(1)"))) == "'=HYPERLINK(1)"
    assert one(spark, text.salary(F.lit(None).cast("string"), F.lit("150000"), F.lit("USD"), F.lit("YEAR"))) == "USD 150000 per YEAR"


def test_dates(spark):
    parsed = lambda x: one(spark, dates.utc_text(dates.parsed(F.lit(x), dates.REPORT_FORMATS)))
    assert parsed("recently") == "" and parsed("2026-07-28") == "2026-07-28T00:00:00+00:00" and parsed("3 Jan 2024") == "2024-01-03T00:00:00+00:00" and parsed("2026") == ""
    assert one(spark, dates.utc_text(dates.rfc822(F.lit("Tue, 28 Jul 2026 10:00:00 +0000")))) == "2026-07-28T10:00:00+00:00"


def test_enrichment_and_score(spark):
    df = jobs(spark, {"title": "Lead Piping Design Engineer", "location": "Abu Dhabi, UAE", "description": "AVEVA E3D and PDMS, contract, LNG plant. Closing date: 31 August 2026"}, {"title": "Accountant", "location": "Remote in Europe"})
    found = {r["title"]: r for r in matching.enrich(df, TAXONOMY).collect()}
    lead, other = found["Lead Piping Design Engineer"], found["Accountant"]
    assert (lead["normalized_role"], lead["city"], lead["country"], lead["software_text"], lead["employment_type"], lead["sector"], lead["closing_at"]) == ("Lead Piping Design Engineer", "Abu Dhabi", "United Arab Emirates", "AVEVA E3D; PDMS", "Contract", "LNG", "31 August 2026")
    assert other["normalized_role"] == "" and other["country"] == "Europe"
    scored = {r["title"]: r for r in scoring.score(df, config.Profile(), F.lit("2026-08-01").cast("timestamp"), TAXONOMY).collect()}
    assert scored["Lead Piping Design Engineer"]["match_score"] >= 50 and scored["Accountant"]["priority"] == "low" and "Target role wording not detected" in scored["Accountant"]["gaps"]
    kept = scoring.profile_filter(jobs(spark, {"normalized_role": "r", "match_score": 0}, {"match_score": 20}, {"match_score": 0}))
    assert kept.count() == 2


def merged(spark, stored, coming):
    old = ledger.identified(jobs(spark, *stored).drop("seq")) if stored else schemas.empty(spark, schemas.LEDGER)
    out = ledger.merge(old, ledger.aliases_of(old), jobs(spark, *[r | {"seq": i} for i, r in enumerate(coming)]))
    return ledger.stored_rows(out).collect(), [r["action"] for r in out.where("action <> 'stored'").orderBy("seq").collect()]


def test_ledger_keeps_status_and_contact(spark):
    rows, actions = merged(spark, [{"job_key": "k", "application_status": "applied", "recruiter_email": "a@b.c", "found_at": "1", "last_seen_at": "1"}], [{"job_key": "k", "last_seen_at": "2"}])
    assert actions == ["updated"] and len(rows) == 1
    assert (rows[0]["application_status"], rows[0]["recruiter_email"], rows[0]["found_at"], rows[0]["last_seen_at"]) == ("applied", "a@b.c", "1", "2")


def test_ledger_identities(spark):
    rows, actions = merged(spark, [], [{"apply_url": "https://x.y/1"}, {"title": "other", "apply_url": "https://x.y/1?utm_a=b"}])
    assert actions == ["new", "updated"] and [r["title"] for r in rows] == ["other"]
    rows, actions = merged(spark, [], [{}, {"apply_url": "https://x.y/1"}, {}])
    assert actions == ["new", "new", "updated"] and len(rows) == 2
    rows, actions = merged(spark, [{}], [{"apply_url": "https://x.y/1"}])
    assert actions == ["new"] and sorted(r["canonical_url"] for r in rows) == ["", "https://x.y/1"]
    rows, _ = merged(spark, [{"job_key": "k"}], [{"job_key": "k", "apply_url": "https://x.y/1"}])
    assert [r["canonical_url"] for r in rows] == ["https://x.y/1"]


def test_ledger_scored_rows_clear_what_was_derived(spark):
    old = {"job_key": "k", "city": "Pune", "match_score": 90, "priority": "critical", "match_reasons": "r"}
    rows, _ = merged(spark, [old], [{"job_key": "k", "gaps": "g", "priority": "low"}])
    assert (rows[0]["city"], rows[0]["match_score"], rows[0]["priority"]) == ("", 0, "low")
    rows, _ = merged(spark, [old], [{"job_key": "k"}])
    assert (rows[0]["city"], rows[0]["match_score"]) == ("Pune", 90)
    with pytest.raises(Exception, match="title and company"):
        merged(spark, [], [{"title": " "}])


def test_cross_source_pair(spark):
    pair = [{"job_key": k, "normalized_role": "r", "company": "c", "city": "x", "published_at": "2026-07-01", "match_score": s, "source_name": n} for k, s, n in (("a", 90, "A"), ("b", 80, "B"))]
    rep = dedup.representatives(jobs(spark, *pair).drop("seq")).collect()
    assert [(r["job_key"], r["source_count"], r["duplicate_sources"], r["duplicate_status"]) for r in rep] == [("a", 2, "A; B", "cross_source_duplicate")]
    assert dedup.variants(jobs(spark, *pair).drop("seq")).count() == 2
    empty = dedup.representatives(schemas.empty(spark, schemas.JOB))
    assert empty.count() == 0 and {"duplicate_group", "source_count", "all_apply_urls"} <= set(empty.columns)


def test_direct_contacts_fall_back(spark):
    rows = spark.createDataFrame([("a", "x@y.z")], "n string, email string")
    fallback = spark.createDataFrame([("f", "")], "n string, email string")
    assert [r["n"] for r in reports.direct_contacts(rows, fallback).collect()] == ["a"]
    assert [r["n"] for r in reports.direct_contacts(rows.limit(0), fallback).collect()] == ["f"]


def test_contact_gate(spark):
    df = spark.createDataFrame([("A", "hr@x.com", "mx", "u1"), ("B", "hr@x.com", "mx", "u2"), ("C", "u003ehr@x.com", "mx", "u3")], "organization string, email string, mail_route_status string, source_url string")
    gated = contacts.gate(df)
    clean = contacts.clean(gated).collect()
    assert [(r["email"], r["sightings"], r["organization_aliases"], r["source_urls"]) for r in clean] == [("hr@x.com", 2, "A | B", "u1 | u2")] and contacts.excluded(gated).count() == 1


def test_overrides_of_unknown_companies_fail(spark):
    r = spark.createDataFrame([("a", "X", "s")], "company_id string, company string, status string")
    assert coverage.override(r, spark.createDataFrame([("a", "")], "company_id string, status string")).first()["status"] == ""
    with pytest.raises(Exception, match="unknown company"):
        coverage.override(r, spark.createDataFrame([("b", "t")], "company_id string, status string")).collect()


def landed(spark, payload):
    return spark.createDataFrame([("Board", "Acme", payload if isinstance(payload, str) else json.dumps(payload))], "source_name string, company string, payload string")


def test_json_sources(spark):
    g = payloads.read("greenhouse", landed(spark, {"jobs": [{"title": "Piping Lead", "absolute_url": "https://x/1", "location": {"name": "Pune"}, "content": "&lt;p&gt;Hello&lt;/p&gt;", "updated_at": "2026-01-01", "departments": [{"name": "Eng"}], "metadata": [{"name": "Level", "value": "5"}]}, {"title": ""}]})).collect()
    assert [(r["title"], r["company"], r["location"], r["description"], r["published_at"], r["skills_text"]) for r in g] == [("Piping Lead", "Acme", "Pune", "Hello", "2026-01-01", "Eng; Level: 5")]
    lever = payloads.read("lever", landed(spark, [{"text": "T", "hostedUrl": "https://h", "categories": {"allLocations": ["A", "B"], "team": "X"}, "salaryRange": {"min": 1, "max": 2, "currency": "USD", "interval": "year"}}])).first()
    assert (lever["location"], lever["apply_url"], lever["salary_text"], lever["skills_text"]) == ("A, B", "https://h", "USD 1 - 2 per year", "X")
    detail = spark.createDataFrame([("7", json.dumps({"name": "Full", "postingUrl": "https://p"}))], "id string, payload string")
    assert payloads.read("smartrecruiters", landed(spark, {"content": [{"id": "7", "name": "Short"}]}), details=detail).first()["title"] == "Full"
    assert payloads.read("oracle_hcm", landed(spark, {"items": [{"requisitionList": [{"Title": "O", "PostedDate": "2026-07-22"}]}]})).first()["published_at"] == "2026-07-22"
    assert payloads.read("workday", landed(spark, {"jobPostings": [{"title": "W", "externalPath": "/a"}, {"title": "W", "externalPath": "/a"}]})).count() == 1
    feed = "<rss><channel><item><title>R</title><link>https://r</link><description><![CDATA[<b>x</b>]]></description><pubDate>Tue, 28 Jul 2026 10:00:00 +0000</pubDate><category>c</category></item></channel></rss>"
    r = payloads.read("rss", landed(spark, feed)).first()
    assert (r["title"], r["description"], r["published_at"], r["skills_text"]) == ("R", "x", "2026-07-28T10:00:00+00:00", "c")
    assert payloads.read("greenhouse", landed(spark, "not json")).count() == 0
    with pytest.raises(ValueError, match="unknown source kind"):
        payloads.read("other", landed(spark, "{}"))


def test_html_sources(spark):
    page = """<html><head><title>Job | Acme</title><script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "title": "Lead", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Pune", "addressCountry": "IN"}}}]}</script></head>
    <body><nav><a href="/n">nav</a></nav><h1>Lead <b>Engineer</b></h1><p>Write to <a href="mailto:jobs@acme.com">us</a> or hr [at] acme [dot] com<br>now</p></body></html>"""
    df = spark.createDataFrame([(1, page), (2, None)], "k int, html string")
    assert [r["href"] for r in html.links(df, "k", "html").orderBy("position").collect()] == ["/n", "mailto:jobs@acme.com"]
    assert {r["k"]: r["title"] for r in html.titles(df, "k", "html").collect()} == {1: "Lead Engineer", 2: ""}
    assert html.body_text(df, "k", "html").where("k = 1").first()["body"].split("\n") == ["Lead Engineer", "Write to us or hr [at] acme [dot] com", "now"]
    post = html.postings(df, "k", "html").collect()
    assert [(r["title"], r["company"], r["location"]) for r in post] == [("Lead", "Acme", "Pune, IN")]
    assert [(r["raw"], r["method"]) for r in html.contact_candidates(df, "k", "html").collect()][:1] == [("jobs@acme.com", "mailto")]
    assert "text_obfuscation" in {r["method"] for r in html.contact_candidates(df, "k", "html").collect()}


def test_alert_mail(spark):
    raw = b"Subject: Jobs\nFrom: Board <a@b.example>\nMIME-Version: 1.0\nContent-Type: text/plain\n\nLead engineer\nhttps://b.example/jobs/1?utm_source=x\nhttps://b.example/jobs/1\nhttps://b.example/unsubscribe?job=1\n"
    df = spark.createDataFrame([("m1", bytearray(raw)), ("m2", bytearray(b""))], "message_id string, raw binary")
    found = mail.candidates(df).collect()
    assert [(r["message_id"], r["url"]) for r in found] == [("m1", "https://b.example/jobs/1")]


def test_private_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Gr\xfc\xdfe ".encode("cp1252") * 30)
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    got = {r["path"].rpartition("/")[2]: r for r in mail.files(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["body"].startswith("Grüße") and not got["a.txt"]["review_required"]
    assert got["b.pdf"]["review_required"] and got["b.pdf"]["error"] == "unsupported"


def test_registry_rejects_bad_entries(tmp_path):
    good = {"company_id": "a", "company": "A", "country": "India", "status": "ACTIVE_DIRECT", "employer_type": "x", "official_careers_url": "https://a", "ats_family": "x", "source_mode": "direct"}
    assert registry.checked([(tmp_path, good)]) == [good]
    with pytest.raises(ValueError, match="unsupported status"):
        registry.checked([(tmp_path, good | {"status": "x"})])
    with pytest.raises(ValueError, match="duplicate"):
        registry.checked([(tmp_path, good), (tmp_path, good | {"company_id": "b", "company": "a"})])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1", ["a", "b"])], "x string, y array<string>")
    sinks.write_views({"v": df}, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/v")).first().asDict() == {"x": "'=1", "y": "a; b"}
    sinks.write_report("T", {"S": df.select("x")}, tmp_path / "r")
    assert "| =1 |" in (tmp_path / "r.md").read_text() and json.loads((tmp_path / "r.json").read_text()) == {"S": [{"x": "=1"}]}
    path, digest = sinks.write_evidence(tmp_path / "e", 1, b"x", "../../outside.txt")
    assert path.endswith(".bin") and len(digest) == 64


def test_streams(spark, tmp_path):
    schema = "source_id string, source_name string, at timestamp, status string, records_found int, error_message string"
    rows = [("s", "S", "2024-01-01", "pass", 1, ""), ("s", "S", "2024-01-02", "fail", 0, "x")]
    df = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    q = ingest.health(ingest.landed(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("complete").format("memory").queryName("health_now").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM health_now").first()
    assert (r["status"], str(r["last_success_at"]), r["error_message"]) == ("fail", "2024-01-01 00:00:00", "x")
    seen = []
    q = ingest.once_each(ingest.landed(spark, str(tmp_path / "in"), df.schema), "source_id", lambda: None, lambda b, n: seen.append((n, b.count()))).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 1)]


def test_health_keeps_the_last_success(spark):
    rows = [("a", "A", "2024-01-01", "pass", 1, ""), ("a", "A", "2024-01-03", "fail", 0, "e" * 2000)]
    r = ledger.health_latest(spark.createDataFrame(rows, "source_id string, source_name string, at string, status string, records_found int, error_message string")).first()
    assert (r["last_success_at"], r["status"], len(r["error_message"])) == ("2024-01-01", "fail", 1000)


def test_shortlist_dates(spark):
    base = {"title": "Piping Engineer", "location": "Mumbai"}
    rows = [base | {"job_key": str(i), "apply_url": f"https://x/{u}", "published_at": p} for i, (u, p) in enumerate((("1", "2026-09-20"), ("2", "soon"), ("3", "2026-12-01"), ("1#a", "2026-09-20")))]
    out = reports.shortlist(jobs(spark, *rows), TAXONOMY, ("Mumbai",), F.lit("2026-09-23").cast("timestamp")).collect()
    assert Counter(r["publication_status"] for r in out) == Counter(["last_30_days", "unknown", "future_date_review"])
