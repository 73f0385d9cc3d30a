"""E-mail address column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolescape.functions.text import let, text

#: The shapes of an address, plain and with its signs spelt out.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?)+"
OBFUSCATED = r"(?i)([a-z0-9._%+\-]+)\s*(?:\[at\]|\(at\)|\sat\s)\s*([a-z0-9.\-]+)\s*(?:\[dot\]|\(dot\)|\sdot\s)\s*([a-z]{2,24})"
#: File endings that look like domains, and suffixes of two labels.
FILE_ENDINGS = ("gif", "jpg", "jpeg", "pdf", "png", "svg", "webp")
TWO_LABELS = ("co.in", "co.uk", "com.au", "com.br", "com.cn", "com.my", "com.sg", "com.tr", "com.mx", "co.nz", "co.za", "org.uk", "net.au")
#: Words of a mailbox that decide its kind.
SCAN_JOB = ("career", "careers", "cv", "employment", "hr", "hiring", "job", "jobs", "people", "recruit", "recruiter", "recruiting", "recruitment", "resume", "resumes", "staffing", "talent", "vacancy", "vacancies")
JOB = ("application", "applications", *SCAN_JOB)
GENERAL = ("admin", "business", "contact", "enquiries", "enquiry", "general", "hello", "info", "office")
EXCLUDED = ("abuse", "accessibility", "billing", "compliance", "copyright", "dmarc", "donotreply", "dpo", "gdpr", "investor", "legal", "media", "noreply", "postmaster", "press", "privacy", "relations", "security", "support", "webmaster")


def first_email(c: Column) -> Column:
    return F.lower(F.regexp_extract(text(c), EMAIL, 0))


#: The shape of an address in an alert, and signs of one that nobody reads.
ALERT_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
NO_REPLY = ("noreply", "no-reply", "donotreply")


def public_contact(c: Column, sender: Column) -> Column:
    """The first address of a text that is neither the sender's nor a no-reply one, lower-cased; else empty."""
    own = F.lower(F.regexp_extract(text(sender), ALERT_EMAIL, 0))
    found = F.transform(F.regexp_extract_all(text(c), F.lit(ALERT_EMAIL), F.lit(0)), F.lower)
    silent = lambda x: x.contains(NO_REPLY[0]) | x.contains(NO_REPLY[1]) | x.contains(NO_REPLY[2])
    return F.coalesce(F.get(F.filter(found, lambda x: (x != own) & ~silent(x)), F.lit(0)), F.lit(""))


def all_emails(c: Column) -> Column:
    """Distinct addresses of a text as written there, lower-cased, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(EMAIL), F.lit(0)), F.lower))


def normalized(c: Column) -> Column:
    """A cleaned address, or empty for what can't be one. ASCII domains; others need their IDNA form."""
    t = F.regexp_replace(F.trim(F.coalesce(F.try_url_decode(F.replace(text(c), F.lit("+"), F.lit("%2B"))), text(c))), "(?i)^mailto:", "")
    return let(F.lower(F.btrim(F.substring_index(t, "?", 1), F.lit(" <>\"'()[]{}.,;:"))), _checked)


def _checked(t: Column) -> Column:
    local, domain = F.substring_index(t, "@", 1), F.rtrim(F.substring_index(t, "@", -1), F.lit("."))
    labels = F.split(domain, r"\.")
    good = (
        (F.length(t) <= 254) & (F.length(F.regexp_replace(t, "[^@]", "")) == 1)
        & local.rlike(r"^[a-z0-9!#$%&'*+/=?^_`{|}~\-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~\-]+)*$") & (F.length(local) <= 64)
        & (F.size(labels) >= 2) & F.forall(labels, lambda x: x.rlike(r"^[a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?$"))
        & ~F.element_at(labels, -1).isin(*FILE_ENDINGS)
    )
    return F.when(good, F.concat(local, F.lit("@"), domain)).otherwise("")


def base_domain(host: Column) -> Column:
    """The registrable domain: two labels, three below a suffix of two."""
    h = F.rtrim(F.lower(text(host)), F.lit("."))
    two = F.substring_index(h, ".", -2)
    return F.when(two.isin(*TWO_LABELS), F.substring_index(h, ".", -3)).otherwise(two)


def local_part(email: Column) -> Column:
    return F.substring_index(text(email), "@", 1)


def tokens(email: Column) -> Column:
    return F.filter(F.split(F.lower(local_part(email)), r"[._+\-]+"), lambda x: x != "")


def _any(email: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens(email), F.array(*map(F.lit, words)))


def mailbox_type(email: Column) -> Column:
    """The scan's reading: job, general, or excluded_non_role."""
    return F.when(_any(email, SCAN_JOB), "job_or_recruitment").when(_any(email, GENERAL), "general_business").otherwise("excluded_non_role")


def quality_type(email: Column) -> Column:
    """The final gate's reading: artifact, excluded word, leading general word, job, general, else excluded."""
    local = F.lower(local_part(email))
    return (
        F.when(local.rlike("^u00[0-9a-f]{2}"), "excluded")
        .when(_any(email, EXCLUDED), "excluded")
        .when(F.get(tokens(email), F.lit(0)).isin(*GENERAL), "general_business")
        .when(_any(email, JOB), "job_or_recruitment")
        .when(_any(email, GENERAL), "general_business")
        .otherwise("excluded")
    )


def quality_reason(email: Column) -> Column:
    local = F.lower(local_part(email))
    return (
        F.when(local.rlike("^u00[0-9a-f]{2}"), "escaped HTML/JavaScript prefix in local part")
        .when(_any(email, EXCLUDED), "non-application mailbox token")
        .when(quality_type(email) == "excluded", "not a role-based organizational mailbox")
        .otherwise("")
    )


def verification(kind: Column, route: Column) -> Column:
    """struct(status, score, reason): a mailbox kind with a proven mail route, or for review."""
    routed = route.isin("mx", "implicit_mx")
    job, general = kind == "job_or_recruitment", kind == "general_business"
    return F.struct(
        F.when(~job & ~general, "excluded").when(~routed, "manual_review_dns").when(job, "verified_official_job_mailbox").otherwise("verified_official_general_mailbox").alias("status"),
        F.when(~job & ~general, 0).when(job & routed, 100).when(job, 60).when(routed, 70).otherwise(30).alias("score"),
        F.when(~job & ~general, "not a role-based organizational mailbox").when(routed, "").otherwise(F.concat(F.lit("mail route not proven: "), route)).alias("reason"),
    )


def decoded_cloudflare(hexed: Column) -> Column:
    """An address whose bytes were XORed with the first one; empty for malformed input."""
    h = F.lower(text(hexed))
    byte = lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("int")
    places = F.sequence(F.lit(3), F.greatest(F.lit(3), F.length(h) - 1), F.lit(2))
    return F.when(h.rlike("^([0-9a-f]{2}){2,}$"), F.array_join(F.transform(places, lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1))))), "")).otherwise("")
