"""Private files into the ledger: staged, stored as evidence, merged as jobs, complete; and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescape import schemas
from rolescape.functions.dates import utc_text
from rolescape.functions.text import collapse, line_value, text
from rolescape.functions.urls import first_url
from rolescape.shared import written
from rolescape.sinks import evidence_hashes, store_evidence
from rolescape.sources import mail
from rolescape.store import Store

#: The endings of files that can be imported.
ENDINGS = (".txt", ".md", ".csv", ".pdf", ".docx", ".eml", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
#: States of a content after reconciliation, and what they ask for.
STATES = {
    "new": "a file that was never imported",
    "duplicate": "imported, with its job and its evidence",
    "retry": "staged, or complete without its job: imported again",
    "repair_missing": "complete, its evidence is gone, and a file still has the bytes",
    "repair_corrupt": "complete, its evidence holds other bytes, and a file still has the right ones",
    "kept": "imported before, with its job and its evidence, and in no file of the listing",
    "lost_missing": "complete, its evidence is gone, and no file has the bytes",
    "lost_corrupt": "complete, its evidence holds other bytes, and no file has the right ones",
    "stale": "staged, or complete without its job, and in no file of the listing",
}


def reconcile(imports: DataFrame, listing: DataFrame, evidence: DataFrame, jobs: DataFrame) -> DataFrame:
    """sha256, path, stored_path, job_key, state of every content that is in the ledger or in a file.

    imports has sha256, stored_path, job_key, status; listing path, sha256 of the files offered; evidence stored_path, sha256
    of the stored bytes; jobs job_key. A content that several files hold is one row with the first path. Only complete
    imports whose job is there can be duplicates; their evidence decides whether it has to be repaired.
    """
    there = evidence.select(F.col("stored_path").alias("at"), F.col("sha256").alias("bytes"))
    known = imports.select("sha256", "stored_path", "job_key", "status").join(jobs.select("job_key").distinct().withColumn("job", F.lit(True)), "job_key", "left")
    known = known.join(there, F.col("stored_path") == F.col("at"), "left")
    files = listing.groupBy("sha256").agg(F.min("path").alias("path"))
    both = files.join(known, "sha256", "full_outer")
    whole = (F.col("status") == "complete") & F.coalesce("job", F.lit(False))
    offered, damage = F.col("path").isNotNull(), F.when(F.col("bytes").isNull(), "missing").otherwise("corrupt")
    state = (
        F.when(F.col("status").isNull(), "new")
        .when(~whole, F.when(offered, "retry").otherwise("stale"))
        .when(F.col("bytes").eqNullSafe(F.col("sha256")), F.when(offered, "duplicate").otherwise("kept"))
        .otherwise(F.concat(F.when(offered, "repair_").otherwise("lost_"), damage))
    )
    return both.select("sha256", text(F.col("path")).alias("path"), text(F.col("stored_path")).alias("stored_path"), text(F.col("job_key")).alias("job_key"), state.alias("state"))


def job_rows(files: DataFrame) -> DataFrame:
    """Job rows of files (path, body, method, sha256): title, company and location by their labels, else inferred or unknown."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    body = F.trim(F.col("body"))
    title = mail.inferred_title(body, F.regexp_replace(name, "[_-]", " "))
    company = mail.labelled_company(body)
    rows = files.select(
        "sha256", F.when(title == "", "Unidentified vacancy").otherwise(title).alias("title"), F.when(company == "", "Unknown employer").otherwise(company).alias("company"), collapse(line_value(body, "location|city", 300)).alias("location"),
        body.alias("description"), first_url(body).alias("apply_url"), F.concat(F.lit("private:"), "method").alias("source_name"),
    )
    # title and employer were inferred, so the posting is looked at
    return rows.withColumn("application_status", F.lit("review_required"))


def warned(files: DataFrame) -> Column:
    """What a reader of the import should know, joined by " | "."""
    return F.concat_ws(" | ", F.when(F.col("error") != "", F.col("error")), F.lit("Job title was inferred from document text or filename"), F.lit("Employer was inferred or marked Unknown employer"))


def import_folder(store: Store, folder: str, evidence: str, max_files: int = 500, max_bytes: int = 25_000_000) -> DataFrame:
    """Imports the supported files below a folder; path, sha256, status of each: created, updated, duplicate, repaired or failed.

    Files below the evidence folder are left out; more than max_files files are an error before anything is written. Each
    content is staged in a first version, so an import that breaks off is found and done again by the next run, which changes
    nothing where all is complete. Evidence that is missing or corrupt is written again from the file. A file without text,
    or too large, fails alone.
    """
    spark, at = store.spark, evidence.rstrip("/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    found = mail.files(spark, folder, max_bytes, contents=True).withColumn("path", plain)
    ends = F.lower("path")
    found = found.where(F.lit(False) if not ENDINGS else ends.rlike("(" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$")).where(~F.col("path").startswith(at + "/"))
    found = written(found, "private-files")
    if found.count() > max_files:
        raise ValueError(f"more than {max_files} supported files below {folder}")
    usable = found.where((F.trim(F.col("body")) != "") & F.col("content").isNotNull())
    failed = found.join(usable.select("path"), "path", "left_anti").select("path", F.coalesce("sha256", F.lit("")).alias("sha256"), F.lit("failed").alias("status"))

    plan = written(reconcile(store.read("private_imports"), usable.select("path", "sha256"), evidence_hashes(spark, at), store.read("jobs", columns=["job_key"])), "plan")
    asked = usable.dropDuplicates(["sha256"]).join(plan.where(F.col("state").isin("new", "retry")).select("sha256"), "sha256")
    mend = usable.dropDuplicates(["sha256"]).join(plan.where(F.col("state").startswith("repair")).select("sha256"), "sha256")
    now = utc_text(F.current_timestamp())
    row = asked.select(
        F.left("sha256", F.lit(32)).alias("import_id"), "sha256", F.col("path").alias("original_path"), F.element_at(F.split("path", "/"), -1).alias("original_name"), F.concat(F.lit(f"{at}/"), F.left("sha256", F.lit(2)), F.lit("/"), "sha256").alias("stored_path"),
        "size_bytes", F.col("method").alias("extraction_method"), F.length("body").alias("extracted_chars"), F.lit(1).alias("review_required"), F.left(warned(asked), F.lit(4000)).alias("warnings"), F.lit("staged").alias("status"), now.alias("imported_at"),
    )
    staged = written(schemas.conform(row, schemas.IMPORTS), "staged")
    version = store.current()
    if not staged.isEmpty():
        version = store.publish(store.replaced("private_imports", staged, version), version)
    stored = store_evidence(asked.unionByName(mend), at)
    stored.write.format("noop").mode("overwrite").save()

    jobs = written(job_rows(asked).orderBy("sha256"), "postings").withColumn("seq", F.monotonically_increasing_id())
    jobs = written(jobs, "numbered")
    done = None
    if not staged.isEmpty():

        def rows(events: DataFrame) -> dict[str, tuple[DataFrame, DataFrame | None]]:
            key = jobs.select("seq", "sha256").join(events.select("seq", F.col("job_key").alias("key")), "seq")
            return {"private_imports": (staged.join(key.select("sha256", "key"), "sha256").withColumn("job_key", F.col("key")).withColumn("status", F.lit("complete")), None)}

        events = store.upsert(jobs, more=rows)
        done = jobs.select("seq", "sha256").join(events.select("seq", F.when(F.col("action") == "new", "created").otherwise("updated").alias("outcome")), "seq").select("sha256", "outcome")
    else:
        done = spark.createDataFrame([], "sha256 string, outcome string")
    first = usable.groupBy("sha256").agg(F.min("path").alias("first"))
    out = usable.select("path", "sha256").join(plan.select("sha256", "state"), "sha256").join(done, "sha256", "left").join(first, "sha256")
    # another file with the same bytes is a duplicate of the first
    status = F.when(F.col("path") != F.col("first"), "duplicate").when(F.col("state").startswith("repair"), "repaired").otherwise(F.coalesce("outcome", F.lit("duplicate")))
    return out.select("path", "sha256", status.alias("status")).unionByName(failed)
