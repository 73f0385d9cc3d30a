"""E-mail and private files: messages as alert candidates, files as text."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from email.message import EmailMessage
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescape.functions.emails import public_contact
from rolescape.functions.text import collapse, contains_any, line_value, text
from rolescape.functions.urls import canonical, unwrapped
from rolescape.operators.dedup import best_per
from rolescape.sources.html import parse, to_text

#: Parts of URLs that are no postings, parts of those that are, and words of a role.
NO_JOB = ("unsubscribe", "preferences", "privacy", "terms", "settings", "help", "support", "login", "sign-in", "signin", "profile", "talent-community", "talentnetwork")
JOB_URL = ("/job/", "/jobs/", "/careers/job/", "/viewjob", "/jobdetails", "/job-detail", "jobid=", "job_id=")
ROLE = ("piping", "pipe layout", "plant layout", "e3d", "aveva", "pdms", "sp3d", "smartplant 3d", "smart 3d", "piping designer", "piping engineer", "model coordinator", "pipe support")
#: The names of portals by the domains they send from.
PORTALS = {"linkedin.com": "LinkedIn", "naukri.com": "Naukri", "indeed.com": "Indeed", "glassdoor.com": "Glassdoor", "foundit.in": "Foundit", "monster.com": "Monster", "gulftalent.com": "GulfTalent", "bayt.com": "Bayt", "naukrigulf.com": "Naukrigulf", "rigzone.com": "Rigzone", "energyjobline.com": "Energy Jobline", "oilandgasjobsearch.com": "Oil and Gas Job Search", "epcengineer.com": "EPC Engineer"}
TEXT_ENDINGS = (".txt", ".md", ".csv")


def is_job_link(url: Column, around: Column) -> Column:
    """A web link without an excluded part whose URL looks like a posting, or with a role's words around it."""
    u = F.lower(text(url))
    return u.rlike("^https?://") & ~contains_any(u, NO_JOB) & (contains_any(u, JOB_URL) | contains_any(F.lower(text(around)), ROLE))


def inferred_title(c: Column, fallback: Column, words: tuple[str, ...] = ROLE, most: int = 160) -> Column:
    """The labelled title, else the first line of 4 to `most` characters with one of the words, else the fallback."""
    lines = F.transform(F.split(text(c), r"\r?\n"), lambda x: F.trim(collapse(x), F.lit(" -:|")))
    labelled = F.left(collapse(F.regexp_extract(text(c), r"(?i)(?:^|\n)\s*(?:job title|position|role)\s*:\s*([^\n|;]{2,180})", 1)), F.lit(180))
    fits = F.filter(lines, lambda x: F.length(x).between(4, most) & contains_any(F.lower(x), words))
    return F.coalesce(F.nullif(labelled, F.lit("")), F.get(fits, F.lit(0)), F.left(collapse(fallback), F.lit(160)))


def line_neighbourhoods(docs: DataFrame, key: str, body: str, pattern: str, reach: int = 3) -> DataFrame:
    """key, line (from 0), near: every line that a pattern matches, with the lines up to `reach` before and after it."""
    lines = F.split(text(F.col(body)), "\n")
    at = docs.select(key, lines.alias("l")).select(key, "l", F.posexplode("l").alias("line", "x")).where(F.col("x").rlike(pattern))
    first = F.greatest(F.lit(0), F.col("line") - reach)
    return at.select(key, "line", F.array_join(F.slice("l", first + 1, F.col("line") - first + reach + 1), "\n").alias("near"))


def alert_jobs(alerts: DataFrame) -> DataFrame:
    """Postings from alert candidates (title, company, location, url, context, sender, subject, portal, body).

    A contact found in the alert makes its confidence ALERT_SUPPLIED; without an employer the posting is for review.
    """
    c = lambda n: text(F.col(n))
    evidence = F.concat(F.lit("Subject: "), c("subject"), F.lit("\nFrom: "), c("sender"), F.lit("\n"), c("context"), F.lit("\n"), F.left(c("body"), F.lit(12000)))
    out = alerts.withColumn("description", evidence).withColumn("recruiter_email", public_contact(F.col("description"), F.col("sender")))
    there = F.col("recruiter_email") != ""
    return out.withColumns({
        "company": F.when(c("company") == "", "Unknown employer").otherwise(c("company")), "apply_url": c("url"), "source_url": c("url"), "source_name": F.concat(F.lit("gmail:"), c("portal")), "agency_name": c("portal"),
        "contact_confidence": F.when(there, "ALERT_SUPPLIED").otherwise(""), "contact_source_url": F.when(there, c("url")).otherwise(""), "duplicate_status": F.lit("cross_source_candidate"),
        "application_status": F.when(c("company") == "", "review_required").otherwise("new"),
    })


def body(message: EmailMessage, kind: str) -> str:
    part = message.get_body((kind,))
    try:
        return part.get_content() if part else ""
    except (LookupError, ValueError):
        return ""


def decoded(raw: bytes) -> str:
    """Text of a file of unknown encoding: UTF-8, else Windows-1252, else Latin-1."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: The unpacked size up to which a document is read.
DOCUMENT_BYTES = 50_000_000


def document_text(raw: bytes) -> str:
    """The paragraphs of a DOCX file outside tables, then its table rows with cells joined by " | ", a line each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if z.getinfo("word/document.xml").file_size > DOCUMENT_BYTES:
            raise ValueError("document too large")
        xml = z.read("word/document.xml")
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("document with entities")
    body = ElementTree.fromstring(xml).find(f"{WORD}body")
    said = lambda node: "".join(x.text or "" if x.tag == f"{WORD}t" else "\t" if x.tag == f"{WORD}tab" else "\n" for x in node.iter() if x.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br")).strip()
    lines = [said(p) for p in body.findall(f"{WORD}p")]
    for row in (r for t in body.findall(f"{WORD}tbl") for r in t.findall(f"{WORD}tr")):
        lines.append(" | ".join("\n".join(said(p) for p in cell.findall(f"{WORD}p")).strip() for cell in row.findall(f"{WORD}tc")))
    return "\n".join(x for x in lines if x)


def message_rows(raw: bytes) -> Iterator[tuple[str, str, str, str, str, int, str, str, str]]:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    head = [str(m.get(h, "") or "") for h in ("Subject", "From", "Date")]
    plain, at = body(m, "plain"), 0
    for href, anchor in parse(body(m, "html")).links:
        yield *head, plain, "html", at, href, anchor, ""
        at += 1
    lines = plain.splitlines()
    for i, line in enumerate(lines):
        for url in re.findall(r"https?://[^\s<>\"']+", line):
            near = "\n".join(lines[max(0, i - 3) : i + 4])
            yield *head, plain, "plain", at, url.rstrip(".,);]"), "", near
            at += 1


def candidates(messages: DataFrame) -> DataFrame:
    """Links of raw messages (message_id, raw) that look like postings, each canonical URL once for a message.

    A message that can't be parsed gives a row with an error and no link.
    """
    names = ["message_id", "subject", "sender", "sent", "body", "part", "candidate_index", "href", "anchor", "near", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, raw in zip(batch.column("message_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                try:
                    out += [(k, *r, "") for r in message_rows(raw or b"")]
                except Exception as e:  # one bad message must not end the batch
                    out.append((k, *[""] * 5, -1, "", "", "", f"{type(e).__name__}: {e}"[:1000]))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=pa.schema([(n, pa.int32() if n == "candidate_index" else pa.string()) for n in names]))

    found = messages.select("message_id", "raw").mapInArrow(run, ", ".join(f"{n} {'int' if n == 'candidate_index' else 'string'}" for n in names))
    url = unwrapped(F.col("href"))
    ok = found.withColumn("url", canonical(url)).where((F.col("error") != "") | is_job_link(url, F.concat_ws("\n", "anchor", "near")))
    return best_per(ok.withColumn("_k", F.concat_ws(" ", "message_id", F.when(F.col("error") == "", F.col("url")))), "_k", F.asc("candidate_index")).drop("_k")


def headers(messages: DataFrame) -> DataFrame:
    """message_id, subject, sender, sent of raw messages (message_id, raw); what can't be read is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, raw in zip(batch.column("message_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                try:
                    m = email.message_from_bytes(raw or b"", policy=email.policy.default)
                    out.append((k, *[str(m.get(h, "") or "") for h in ("Subject", "From", "Date")]))
                except Exception:  # its row says why; here it has no headers
                    out.append((k, "", "", ""))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["message_id", "subject", "sender", "sent"])

    return messages.select("message_id", "raw").mapInArrow(run, "message_id string, subject string, sender string, sent string")


def labelled_company(c: Column) -> Column:
    """The value of a line that names the company, or empty."""
    return collapse(line_value(c, "company|employer|organi[sz]ation|hiring company", 300))


def files(spark: SparkSession, folder: str, most_bytes: int = 25_000_000, contents: bool = False) -> DataFrame:
    """Text of private files below a folder: path, size_bytes, sha256, body, method, review_required, error, and with
    `contents` their bytes.

    Text files are decoded, messages read as headers and body; endings without a reader here (PDF, images) give
    an empty body for review. Larger files are left out with an error.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    raw = raw.select("path", F.col("length").alias("size_bytes"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, methods = [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = path.lower()
                if content is None:
                    bodies.append(""), methods.append("too_large")
                elif name.endswith(TEXT_ENDINGS):
                    bodies.append(decoded(content)), methods.append("text")
                elif name.endswith(".eml"):
                    m = email.message_from_bytes(content, policy=email.policy.default)
                    head = "\n".join(f"{h}: {m[h]}" for h in ("Subject", "From", "To", "Date") if m[h])
                    bodies.append(f"{head}\n\n{body(m, 'plain') or to_text(body(m, 'html'))}"), methods.append("eml")
                elif name.endswith(".docx"):
                    try:
                        bodies.append(document_text(content)), methods.append("docx")
                    except (KeyError, ValueError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError):
                        bodies.append(""), methods.append("unreadable")
                else:
                    bodies.append(""), methods.append("unsupported")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size_bytes"), batch.column("content"), pa.array(bodies), pa.array(methods)], ["path", "size_bytes", "content", "body", "method"])

    read = raw.mapInArrow(run, "path string, size_bytes long, content binary, body string, method string")
    return read.select("path", "size_bytes", F.sha2("content", 256).alias("sha256"), "body", "method", (F.length(F.trim("body")) < 80).alias("review_required"), F.when(F.col("method").isin("too_large", "unsupported", "unreadable"), F.col("method")).otherwise("").alias("error"), *(["content"] if contents else []))


def new_only(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet, each key once."""
    return incoming.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")


def portal(sender: DataFrame, column: str, portals: dict[str, str] = PORTALS) -> DataFrame:
    """sender with portal: the name of the portal whose domain sent it, else the display name, else the domain, else "Gmail alert"."""
    domain = F.lower(F.regexp_extract(text(F.col(column)), r"@([A-Za-z0-9.\-]+)", 1))
    named = None
    for d, name in portals.items():
        hit = (domain == d) | domain.endswith("." + d)
        named = F.when(hit, name) if named is None else named.when(hit, name)
    display = F.trim(F.regexp_extract(text(F.col(column)), r'^\s*"?([^"<]*?)"?\s*<', 1))
    rest = F.when(display != "", display).when(domain != "", domain).otherwise("Gmail alert")
    return sender.withColumn("portal", named.otherwise(rest) if named is not None else rest)
