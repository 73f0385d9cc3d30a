"""Alert messages into the ledger: jobs, messages and links of one version, complete only where all links resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescape import schemas
from rolescape.functions.dates import received, utc_text
from rolescape.functions.text import text
from rolescape.operators.integrity import link_completeness
from rolescape.shared import written
from rolescape.sources import mail
from rolescape.store import Store


def settled(messages: DataFrame, links: DataFrame, jobs: DataFrame) -> DataFrame:
    """message_id of the stored messages that are complete and whose links all lead to a job."""
    whole = link_completeness(links, jobs).where("complete").select("message_id")
    without = messages.select("message_id").join(links.select("message_id"), "message_id", "left_anti")
    return messages.where(F.col("status").startswith("complete")).select("message_id").join(whole.unionByName(without), "message_id", "left_semi")


def postings(candidates: DataFrame) -> DataFrame:
    """Jobs of alert candidates, with message_id, candidate_index and url; arrival follows message and candidate."""
    named = mail.portal(candidates, "sender")
    shaped = named.withColumns({"context": F.concat_ws("\n", "anchor", "near"), "location": F.lit("")})
    shaped = shaped.withColumns({"title": mail.inferred_title(F.col("context"), F.coalesce(F.nullif("anchor", F.lit("")), F.col("subject"))), "company": mail.labelled_company(F.col("context"))})
    return mail.alert_jobs(shaped)


def ingest(store: Store, arrived: DataFrame, mark: str | None = None) -> DataFrame:
    """Stores messages (message_id, raw; optionally thread_id, query_text, internal_ms) and gives their rows.

    A message that is stored complete, and whose links all lead to jobs, is left alone. Any other one is read anew: its
    links and its row are replaced in the version that its jobs go into. A message that can't be parsed is stored as failed
    with its error, and the others go on. With a mark, a batch that is run again changes nothing.
    """
    spark, names = arrived.sparkSession, schemas.MESSAGES.names
    if mark and store.done(mark):
        return schemas.empty(spark, schemas.MESSAGES)
    touched = store.touched(arrived, "gmail_alert_messages")
    before, links = store.read("gmail_alert_messages", touched), store.read("gmail_alert_jobs", touched)
    old = settled(before, links.select("message_id", "job_key"), store.read("jobs", columns=["job_key"]))
    fresh = written(schemas.conform(arrived, schemas.struct("message_id", "thread_id", "query_text", "internal_ms")).join(arrived.select("message_id", "raw"), "message_id").dropDuplicates(["message_id"]).join(old, "message_id", "left_anti"), "messages")
    found = written(mail.candidates(fresh).orderBy("message_id", "candidate_index"), "candidates")
    offered = written(postings(found.where("error = ''")).orderBy("message_id", "candidate_index"), "postings").withColumn("seq", F.monotonically_increasing_id())
    offered = written(offered, "numbered")

    def rows(events: DataFrame) -> dict[str, tuple[DataFrame, DataFrame | None]]:
        link = offered.select("seq", "message_id", "candidate_index", F.col("url").alias("source_url")).join(events.select("seq", "job_key", "action"), "seq")
        made = link.groupBy("message_id").agg(F.count_if(F.col("action") == "new").cast("int").alias("jobs_created"), F.count_if(F.col("action") == "updated").cast("int").alias("jobs_updated"))
        failed = found.where("error <> ''").groupBy("message_id").agg(F.max("error").alias("error_message"))
        head = mail.headers(fresh)
        out = fresh.select("message_id", "thread_id", "query_text", "internal_ms", F.sha2("raw", 256).alias("sha256")).join(head, "message_id", "left").join(made, "message_id", "left").join(failed, "message_id", "left")
        status = F.when(F.col("error_message").isNotNull(), "failed").when(F.col("jobs_created").isNull(), "complete_no_match").otherwise("complete")
        out = out.withColumns({"status": status, "received_at": utc_text(received(F.col("internal_ms"), F.col("sent"), F.current_timestamp())), "imported_at": utc_text(F.current_timestamp()), "error_message": text(F.col("error_message"))})
        messages = schemas.conform(out, schemas.MESSAGES).select(*names)
        return {"gmail_alert_messages": (messages, None), "gmail_alert_jobs": (link.drop("seq", "action"), fresh.select("message_id"))}

    store.upsert(offered, more=rows, mark=mark)
    return store.read("gmail_alert_messages", touched).join(fresh.select("message_id"), "message_id", "left_semi")
