"""Notice scans, alerts, feeds and numbering on small fixtures."""

from pyspark.sql import functions as F

from rolescape.functions import emails
from rolescape.operators import dedup
from rolescape.sources import mail, notices, payloads

LISTING = """<html><body><h2>Recruitment 2024</h2><table><tr><td>Advertisement for piping engineers, last date 31.12.2024</td><td><a href="/a.pdf">Download</a></td></tr>
<tr><td>Result of the test</td><td><a href="/r.pdf">Vacancy result list</a></td></tr><tr><td>Vacancy</td><td><a href="https://other.example/x">Vacancy elsewhere</a></td></tr></table>
<div class="job-card"><strong>Walk-in for designers</strong><p><a href="/w.html">View details</a></p></div><li><a href="/faq">FAQ on the vacancy</a></li>
<script>const rows = `<li>Vacancy in Pune <a href='/s.html'>Senior designer vacancy</a></li>`;</script></body></html>"""


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_notices_of_a_listing(spark):
    df = pages(spark, (1, "https://jobs.example/list", LISTING), (2, "https://jobs.example/none", None), (3, None, "<a href='x'>Vacancy"))
    base = {r["target"]: r for r in notices.links(df, "page_id", "url", "html", adaptive=False).collect()}
    assert set(base) == {"https://jobs.example/a.pdf", "https://jobs.example/w.html", "https://jobs.example/faq"}
    assert base["https://jobs.example/a.pdf"]["title"] == "Recruitment 2024" and "last date" in base["https://jobs.example/a.pdf"]["context"]
    adaptive = {r["target"]: r for r in notices.links(df, "page_id", "url", "html").collect()}
    assert set(adaptive) == {"https://jobs.example/a.pdf", "https://jobs.example/w.html", "https://jobs.example/s.html"}
    assert adaptive["https://jobs.example/w.html"]["title"] == "Walk-in for designers" and adaptive["https://jobs.example/s.html"]["context"] == "Vacancy in Pune Senior designer vacancy"
    assert "https://jobs.example/r.pdf" in {r["target"] for r in notices.links(df, "page_id", "url", "html", follow_ups=True).collect()}
    assert notices.links(df, "page_id", "url", "html", max_items=1).count() == 1
    docs = spark.createDataFrame([("https://jobs.example/s.html", "Published on 1 May 2024. Corrigendum. Closing date: June 3, 2024")], "target string, body string")
    out = {r["apply_url"]: r for r in notices.jobs(notices.links(df, "page_id", "url", "html"), docs, "Portal", "Acme").collect()}
    assert len(out) == 3 and out["https://jobs.example/s.html"]["published_at"] == "1 May 2024" and out["https://jobs.example/s.html"]["closing_at"] == "June 3, 2024"
    assert out["https://jobs.example/s.html"]["description"].startswith("Notice kind: corrigendum") and out["https://jobs.example/a.pdf"]["closing_at"] == "31.12.2024"


def test_atom_entries(spark):
    feed = """<feed><entry><title>Designer</title><link rel="self" href="https://x.example/self"/><link rel="alternate" href="https://x.example/1?a=1&amp;b=2"/><updated>2024-05-01T00:00:00Z</updated><summary>&lt;p&gt;Text&lt;/p&gt;</summary><category term="piping"/></entry>
<entry><title>Checker</title><link href="https://x.example/2"/><published>2024-04-01</published></entry><entry><link href="https://x.example/3"/></entry></feed>"""
    df = spark.createDataFrame([(feed, "Feed", "Acme")], "payload string, source_name string, company string")
    out = {r["title"]: r for r in payloads.rss(df).collect()}
    assert out["Designer"]["apply_url"] == "https://x.example/1?a=1&b=2" and out["Designer"]["published_at"] == "2024-05-01T00:00:00Z" and out["Designer"]["skills_text"] == "piping" and out["Designer"]["description"] == "Text"
    assert out["Checker"]["apply_url"] == "https://x.example/2" and out["Checker"]["published_at"] == "2024-04-01" and len(out) == 2


def test_alert_links_by_url_and_words(spark):
    rows = [("https://x.example/jobs/1", "", True), ("https://x.example/help/jobs/1", "", False), ("https://x.example/a", "a Piping Engineer", True), ("https://x.example/a", "an accountant", False), ("mailto:x", "piping", False)]
    df = spark.createDataFrame(rows, "u string, t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", mail.is_job_link(F.col("u"), F.col("t")).alias("got")).collect())


def test_addresses_with_spelt_signs_and_bounds(spark):
    df = spark.createDataFrame([("x..jobs@a-.example.com",), ("write to jobs@mail.example.com now",)], "t string")
    assert [r["e"] for r in df.select(emails.first_email(F.col("t")).alias("e")).collect()] == ["", "jobs@mail.example.com"]
    assert __import__("re").search(emails.OBFUSCATED.replace("(?i)", ""), "hr [at] mail.example [dot] com").groups() == ("hr", "mail.example", "com")


def test_places_in_an_order(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k")).repartition(7)
    assert all(r["position"] == r["k"] for r in dedup.numbered(df, ["k"]).collect())
    assert dedup.numbered(df.limit(0), ["k"]).count() == 0


def test_query_groups_are_checked_and_chosen(spark, tmp_path):
    import pytest

    from rolescape.sources import registry

    file = tmp_path / "groups.yaml"
    file.write_text("query_groups:\n- {id: b, name: B, enabled: true, query: 'a   b'}\n- {id: a, name: A, enabled: false, query: q, max_messages: 5}\n- {id: c, name: C, enabled: true, query: q}\n")
    groups = registry.query_groups(spark, file)
    assert [tuple(r) for r in groups.collect()] == [("b", "B", True, 200, "a b"), ("c", "C", True, 200, "q"), ("a", "A", False, 5, "q")]
    assert [r["id"] for r in registry.chosen_groups(groups, ["c", "a"]).collect()] == ["c"] and registry.chosen_groups(groups).count() == 2
    for only in (["x"], ["a"]):
        with pytest.raises(ValueError):
            registry.chosen_groups(groups, only)
    for bad in ("- {id: b, name: B, enabled: 1, query: q}", "- {id: b, name: B, enabled: true, query: q, max_messages: 0}", "- {id: b, name: '', enabled: true, query: q}", "- 1", "- {id: b, name: B, enabled: true, query: q}\n- {id: b, name: B, enabled: true, query: q}"):
        file.write_text(f"query_groups:\n{bad}\n")
        with pytest.raises(ValueError):
            registry.query_groups(spark, file)


def test_targets_at_any_depth_and_in_shards(spark, tmp_path):
    from rolescape.sources import registry

    file = tmp_path / "recruiters.yaml"
    file.write_text("groups:\n- company: One\n  website: 'http://www.one.example/#top'\n  units:\n  - {name: Two, url: 'https://two.example/a', country: India, record_type: Employer}\n- {name: ONE, official_url: 'http://www.one.example/'}\n- {name: None there}\n")
    out = [tuple(r) for r in registry.targets(spark, [file]).collect()]
    assert out == [("One", "recruiter", "", ["http://www.one.example/"], ["one.example", "www.one.example"]), ("Two", "employer", "India", ["https://two.example/a"], ["two.example", "www.two.example"])]
    assert [r["organization"] for r in registry.targets(spark, [file], 1, 2).collect()] == ["Two"]


def test_discovery_reports_skip_what_is_no_report(spark, tmp_path):
    from rolescape.operators import discovery

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r.json").write_text('{"records": [{"company": "Acme", "source": {"type": "lever", "site": "x"}, "probe_jobs": 3}, 5]}')
    (tmp_path / "bad.json").write_text("{no json")
    (tmp_path / "list.json").write_text("[1]")
    out = discovery.reports(spark, str(tmp_path)).collect()
    assert len(out) == 1 and tuple(out[0])[:3] == ("Acme", "", "") and out[0]["confidence"] == "candidate" and out[0]["probe_jobs"] == 3 and '"lever"' in out[0]["source"]


def test_documents_contact_files_and_bundles(spark, tmp_path):
    import json
    import zipfile

    from rolescape import sinks
    from rolescape.operators import contacts

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {w}><w:body><w:p><w:r><w:t>Piping </w:t><w:t>engineer</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Place</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Pune</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    folder = tmp_path / "private"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (folder / "b.docx").write_bytes(b"no zip")
    out = {r["path"].rsplit("/", 1)[1]: r for r in mail.files(spark, str(folder)).collect()}
    assert out["a.docx"]["body"] == "Piping engineer\nPlace | Pune" and out["a.docx"]["error"] == "" and out["b.docx"]["error"] == "unreadable"
    for shard, body in (("s1", "email,organization\na@x.example,A\n"), ("s2", "email,organization\nb@x.example,\n")):
        (tmp_path / "out" / shard).mkdir(parents=True)
        (tmp_path / "out" / shard / "All_Official_Contacts.csv").write_text(body)
        (tmp_path / "out" / shard / "other.csv").write_text("z\n1\n")
    assert sorted(tuple(r) for r in contacts.read_outputs(spark, str(tmp_path / "out")).collect()) == [("a@x.example", "A"), ("b@x.example", "")]
    target = sinks.bundle([tmp_path / "out", folder / "a.docx"], tmp_path / "all.zip")
    with zipfile.ZipFile(target) as z:
        assert z.namelist() == ["out/s1/All_Official_Contacts.csv", "out/s1/other.csv", "out/s2/All_Official_Contacts.csv", "out/s2/other.csv", "a.docx"]
    digest = sinks.write_json({"b": 1, "a": "é"}, tmp_path / "plan.json")
    assert json.loads((tmp_path / "plan.json").read_text()) == {"a": "é", "b": 1} and len(digest) == 64


def test_a_streaming_ledger_merges_batch_by_batch(spark, tmp_path):
    from rolescape import schemas
    from rolescape.store import Store
    from rolescape.streaming import ingest

    def land(name, *rows):
        df = spark.createDataFrame([(*r, i) for i, r in rows], "title string, company string, apply_url string, published_at string, seq long")
        schemas.conform(df, schemas.JOB).withColumn("n", F.monotonically_increasing_id()).drop("n").join(df.select("title", "apply_url", "seq"), ["title", "apply_url"]).select(*schemas.JOB.names, "seq").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    land("a", (1, ("Designer", "Acme", "https://x.example/1", "2024-01-01")), (2, ("Checker", "Acme", "https://x.example/2", "")))
    schema = spark.read.parquet(str(tmp_path / "in" / "a")).schema

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = ingest.ledger(stream, str(tmp_path / "ledger")).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    store = Store(spark, str(tmp_path / "ledger"))
    assert {r["title"] for r in store.read("jobs", version=1).collect()} == {"Designer", "Checker"}
    land("b", (3, ("Designer II", "Acme", "https://x.example/1?utm_source=a", "2024-02-01")), (4, ("Lead", "Acme", "https://x.example/4", "")))
    run()
    assert {r["title"] for r in store.read("jobs").collect()} == {"Designer II", "Checker", "Lead"} and store.read("job_identity_aliases").count() == 7
    # a stream that begins anew goes on from the newest version
    land("c", (5, ("Another", "Acme", "https://x.example/5", "")))
    again = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ingest.ledger(again, str(tmp_path / "ledger"), writer="second").option("checkpointLocation", str(tmp_path / "offsets2")).trigger(availableNow=True).start().awaitTermination()
    assert store.current() == 3 and store.read("jobs").count() == 4


def test_listings_with_details_and_robots(spark):
    from rolescape.sources import listings

    html = """<a href="/jobs/1#x">Piping Engineer Job ID: #12 Navi Mumbai Full Time</a><a href="/jobs/1">again</a><a href="/jobs/2">Checker, contract</a>
<a href="https://other.example/jobs/3">Elsewhere</a><a href="mailto:a@b.example">Mail jobs</a><a href="/about">About</a><a href="http://[bad/jobs/">Bad</a>"""
    df = pages(spark, (1, "https://x.example/list", html), (2, "https://x.example/none", None))
    found = listings.scan(df, "page_id", "url", "html", ("/jobs/",), excluded=("again",))
    assert {(r["url"], r["position"]) for r in found.collect()} == {("https://x.example/jobs/1", 0), ("https://x.example/jobs/2", 2)}
    details = spark.createDataFrame([("https://x.example/jobs/2", "Senior Checker", "")], "url string, title string, location string")
    out = {r["apply_url"]: r for r in listings.jobs(found, "Board", "Acme", details).collect()}
    one, two = out["https://x.example/jobs/1"], out["https://x.example/jobs/2"]
    assert (one["title"], one["location"], one["job_type"]) == ("Piping Engineer", "Navi Mumbai", "Full Time") and (two["title"], two["job_type"]) == ("Senior Checker", "Contract")
    urls = spark.createDataFrame([("https://x.example/jobs/1",), ("https://x.example/private/1",), ("https://y.example/private/1",), ("https://z.example/a",), ("https://w.example/a",)], "url string")
    robots = spark.createDataFrame([("https://x.example", 200, "User-agent: *\\nDisallow: /private/".replace("\\n", chr(10))), ("https://y.example", 404, ""), ("https://z.example", 500, "")], "origin string, status_code int, body string")
    assert {r["url"] for r in listings.permitted(urls, "url", robots, "bot").collect()} == {"https://x.example/jobs/1", "https://y.example/private/1"}
    assert listings.permitted(urls, "url", robots, "bot", deny_on_error=False).count() == 4


def test_pages_with_a_main_element_and_generic_titles(spark):
    from rolescape.sources import html

    rows = [(1, "u", "<title>Careers</title><div>aside</div><main><p>one</p><main>two</main>three</main><div>end</div>"), (2, "u", "<h1>Designer</h1><div role='main'>in<div>deep</div>still</div>out"), (3, "u", "<title>Lead Careers at Acme</title><p>all</p>of it"), (4, "u", "<div role='main'>first</div><main>real</main>")]
    df = pages(spark, *rows)
    assert {r["page_id"]: r["body"] for r in html.body_text(df, "page_id", "html").collect()} == {1: "one\ntwo\nthree", 2: "in\ndeep\nstill", 3: "all\nof it", 4: "real"}
    assert {r["page_id"]: r["title"] for r in html.titles(df, "page_id", "html").collect()} == {1: "", 2: "Designer", 3: "Lead", 4: ""}
