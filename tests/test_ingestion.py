"""Alert messages and private files through the versioned ledger: completion, repair, replay."""

from pathlib import Path

from pyspark.sql import functions as F

from rolescape import alerts, imports
from rolescape.store import Store

ALERT = """From: Jobs <alerts@linkedin.com>
To: me@mine.example
Subject: New piping roles
Date: Tue, 28 Jul 2026 10:00:00 +0000
MIME-Version: 1.0
Content-Type: text/html; charset=utf-8

<html><body><a href="https://jobs.example.com/jobs/1?utm_source=x">Piping Engineer</a> <a href="https://jobs.example.com/jobs/2">Piping Designer</a>
<a href="https://jobs.example.com/unsubscribe/jobs/3">Stop</a></body></html>"""


def arrived(spark, *rows):
    return spark.createDataFrame([(k, raw.encode() if isinstance(raw, str) else raw) for k, raw in rows], "message_id string, raw binary")


def test_messages_are_complete_when_their_links_resolve(spark, tmp_path):
    store = Store(spark, str(tmp_path / "ledger"), buckets=4)
    quiet = "From: a@b.example\nSubject: hello\n\nno links here"
    got = {r["message_id"]: r for r in alerts.ingest(store, arrived(spark, ("m1", ALERT), ("m2", quiet), ("m3", None)), "alerts:0").collect()}
    assert {k: (r["status"], r["jobs_created"]) for k, r in got.items()} == {"m1": ("complete", 2), "m2": ("complete_no_match", 0), "m3": ("complete_no_match", 0)}
    assert (got["m1"]["sender"], got["m1"]["subject"], got["m1"]["received_at"]) == ("Jobs <alerts@linkedin.com>", "New piping roles", "2026-07-28T10:00:00+00:00")
    assert store.current() == 1 and store.read("jobs").count() == 2 and store.read("gmail_alert_jobs").count() == 2
    # the same batch again, and the same messages in another batch, change no table
    assert alerts.ingest(store, arrived(spark, ("m1", ALERT)), "alerts:0").count() == 0 and store.current() == 1
    before = {k: p for k, p in store.manifest().items() if k[0] != "batch"}
    assert alerts.ingest(store, arrived(spark, ("m1", ALERT), ("m2", quiet)), "alerts:1").count() == 0
    assert {k: p for k, p in store.manifest().items() if k[0] != "batch"} == before


def test_a_message_with_a_lost_job_is_read_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path / "ledger"), buckets=4)
    alerts.ingest(store, arrived(spark, ("m1", ALERT)))
    lost = store.read("jobs").limit(1)
    kept = store.read("jobs").join(lost.select("job_key"), "job_key", "left_anti")
    version = store.current()
    store.publish({(t, b): "" for (t, b) in store.manifest() if t == "jobs"} | store.put("jobs", kept.select(*store.read("jobs").columns)), version)
    assert store.read("jobs").count() == 1
    again = alerts.ingest(store, arrived(spark, ("m1", ALERT))).first()
    assert (again["status"], again["jobs_created"], again["jobs_updated"]) == ("complete", 1, 1)
    assert store.read("jobs").count() == 2 and store.read("gmail_alert_jobs").count() == 2


def test_reconciliation_of_ledger_files_and_bytes(spark):
    rows = [("a", "e/a", "k1", "complete"), ("b", "e/b", "k1", "staged"), ("c", "e/c", "none", "complete"), ("d", "e/d", "k1", "complete"), ("e", "e/e", "k1", "complete"), ("f", "e/f", "k1", "complete"), ("g", "e/g", "k1", "complete"), ("h", "e/h", "k1", "complete"), ("i", "e/i", "", "staged")]
    known = spark.createDataFrame(rows, "sha256 string, stored_path string, job_key string, status string")
    listing = spark.createDataFrame([("p1", "a"), ("p0", "a"), ("p2", "b"), ("p3", "c"), ("p4", "d"), ("p5", "e"), ("p6", "new")], "path string, sha256 string")
    evidence = spark.createDataFrame([("e/a", "a"), ("e/c", "c"), ("e/e", "x"), ("e/f", "f"), ("e/g", "x")], "stored_path string, sha256 string")
    got = {r["sha256"]: (r["state"], r["path"]) for r in imports.reconcile(known, listing, evidence, spark.createDataFrame([("k1",)], "job_key string")).collect()}
    assert got == {"a": ("duplicate", "p0"), "b": ("retry", "p2"), "c": ("retry", "p3"), "d": ("repair_missing", "p4"), "e": ("repair_corrupt", "p5"), "f": ("kept", ""), "g": ("lost_corrupt", ""), "h": ("lost_missing", ""), "i": ("stale", ""), "new": ("new", "p6")}
    assert {s for s, _ in got.values()} == set(imports.STATES)


def test_a_folder_is_imported_once_and_repaired(spark, tmp_path):
    folder, evidence = tmp_path / "in", tmp_path / "in" / "evidence"
    (folder / "deep").mkdir(parents=True)
    body = "Job title: Piping Engineer\nCompany: Acme\nLocation: Pune\nApply at https://x.example/jobs/1."
    (folder / "one.txt").write_text(body)
    (folder / "deep" / "copy.md").write_text(body)
    (folder / "empty.txt").write_text(" ")
    (folder / "left.bin").write_text("not supported")
    store = Store(spark, str(tmp_path / "ledger"), buckets=4)
    run = lambda: {Path(r["path"]).name: r["status"] for r in imports.import_folder(store, str(folder), str(evidence)).collect()}
    assert run() == {"copy.md": "created", "one.txt": "duplicate", "empty.txt": "failed"}
    job, row = store.read("jobs").first(), store.read("private_imports").first()
    assert (job["title"], job["company"], job["location"], job["apply_url"], job["application_status"]) == ("Piping Engineer", "Acme", "Pune", "https://x.example/jobs/1", "review_required")
    assert (row["status"], row["job_key"]) == ("complete", job["job_key"]) and Path(row["stored_path"]).read_text() == body
    version = store.current()
    assert run() == {"copy.md": "duplicate", "one.txt": "duplicate", "empty.txt": "failed"} and store.current() == version
    Path(row["stored_path"]).write_text("changed")
    assert run()["copy.md"] == "repaired" and Path(row["stored_path"]).read_text() == body
    # an import that broke off after staging is done again
    staged = store.read("private_imports").withColumn("status", F.lit("staged"))
    store.publish(store.replaced("private_imports", staged, version), version)
    assert run()["copy.md"] == "updated" and store.read("private_imports").first()["status"] == "complete" and store.read("jobs").count() == 1
    try:
        imports.import_folder(store, str(folder), str(evidence), max_files=1)
        raise AssertionError
    except ValueError as e:
        assert "more than 1" in str(e)
