"""Contact extraction from text, mailbox verdicts and the final quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescape.functions.emails import all_emails, base_domain, mailbox_type, normalized, quality_reason, quality_type, verification
from rolescape.functions.text import context, first_filled, once, text
from rolescape.schemas import CONTACTS


def from_text(df: DataFrame, body: str, organization: str) -> DataFrame:
    """organization, email, mailbox_type, evidence_context for each distinct address in plain text."""
    rows = df.select(text(df[organization]).alias("organization"), df[body].alias("body"), F.explode(all_emails(df[body])).alias("raw"))
    rows = rows.withColumn("email", normalized(F.col("raw"))).where("email <> ''")
    return rows.select("organization", "email", mailbox_type(F.col("email")).alias("mailbox_type"), context(F.col("body"), F.col("raw")).alias("evidence_context"))


def official(contacts: DataFrame, hosts: DataFrame) -> DataFrame:
    """Contacts whose domain is that of a target host (hosts: organization, host)."""
    known = hosts.select("organization", base_domain(hosts["host"]).alias("domain")).distinct()
    return contacts.withColumn("domain", base_domain(F.substring_index("email", "@", -1))).join(known, ["organization", "domain"], "left_semi").drop("domain")


def decide(contacts: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """verification_status, priority_score and review_reason from the mailbox kind and the domain's mail route."""
    df = contacts
    if routes is not None:
        df = df.drop("mail_route_status").withColumn("domain", F.substring_index("email", "@", -1)).join(routes.select("domain", "mail_route_status"), "domain", "left").drop("domain")
    kind = F.when(df["mailbox_type"] == "excluded_non_role", "excluded").otherwise(df["mailbox_type"])
    v = verification(kind, first_filled(F.col("mail_route_status"), F.lit("not_checked")))
    return df.withColumns({"verification_status": v["status"], "priority_score": v["score"], "review_reason": v["reason"]})


def gate(contacts: DataFrame) -> DataFrame:
    """contacts judged anew by the final rules: mailbox_type, status, score, reason, excluded."""
    df = once(once(contacts, _email=normalized(F.col("email"))), _kind=quality_type(F.col("_email")))
    email, kind = F.col("_email"), F.col("_kind")
    v = verification(kind, text(F.col("mail_route_status")))
    bad = (email == "") | (kind == "excluded")
    return df.withColumns({"mailbox_type": F.when(email == "", "excluded").otherwise(kind), "verification_status": F.when(bad, "excluded").otherwise(v["status"]), "priority_score": F.when(bad, 0).otherwise(v["score"]), "review_reason": F.when(email == "", "invalid e-mail").when(bad, quality_reason(email)).otherwise(v["reason"]), "excluded": bad, "email": F.when(email == "", text(F.col("email"))).otherwise(email)}).drop("_email", "_kind")


def unique_text(value: Column, order: Column) -> Column:
    """Distinct filled values in an order, joined by " | "."""
    v = F.trim(text(value))
    return F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.when(v != "", F.struct(order.alias("o"), v.alias("v"))))), lambda x: x["v"])), " | ")


def clean(gated: DataFrame) -> DataFrame:
    """One row of each address that passed: the best, with all its organizations and source URLs."""
    ok = gated.where(~F.col("excluded"))
    order = F.struct((-F.col("priority_score")).alias("s"), F.col("organization").alias("o"), F.col("source_url").alias("u"))
    out = ok.groupBy("email").agg(F.min_by(F.struct("organization", "mailbox_type", "verification_status", "priority_score", "review_reason"), order).alias("r"), F.count("*").alias("sightings"), unique_text(F.col("organization"), order).alias("organization_aliases"), unique_text(F.col("source_url"), order).alias("source_urls"))
    return out.select("email", "r.*", "sightings", "organization_aliases", "source_urls").orderBy(F.desc("priority_score"), "organization", "email")


def excluded(gated: DataFrame) -> DataFrame:
    return gated.where("excluded").orderBy("organization", "email")


def views(cleaned: DataFrame) -> dict[str, DataFrame]:
    """The job, general and review parts of the clean contacts."""
    return {"job": cleaned.where("verification_status = 'verified_official_job_mailbox'"), "general": cleaned.where("verification_status = 'verified_official_general_mailbox'"), "review": cleaned.where("verification_status = 'manual_review_dns'")}


def summary(cleaned: DataFrame) -> DataFrame:
    status = F.col("verification_status")
    return cleaned.agg(F.count("*").alias("contacts"), F.count_if(status == "verified_official_job_mailbox").alias("job"), F.count_if(status == "verified_official_general_mailbox").alias("general"), F.count_if(status == "manual_review_dns").alias("review"), F.count_distinct("email").alias("emails"), F.count_distinct("organization").alias("organizations"))


def read_outputs(spark: SparkSession, folder: str, name: str = "All_Official_Contacts.csv") -> DataFrame:
    """The contact files of that name in all folders below one, by the names in each file's own header; nulls as empty, and
    columns that some files lack are empty there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder)
    head = F.rtrim(F.substring_index(F.decode("content", "UTF-8"), "\n", 1), F.lit("\r"))
    # a row for each different header, with the names of its files
    groups = found.select("path", head.alias("head")).groupBy("head").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()
    out = None
    for g in sorted(groups, key=lambda r: r["paths"]):
        part = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("encoding", "UTF-8").csv(g["paths"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.na.fill("") if out is not None else spark.createDataFrame([], CONTACTS)
