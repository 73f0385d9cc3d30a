"""Public recruitment notices: their kind, dates and link filters as column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolescape.functions.text import contains_any, text

#: Words that make a link a notice, that make it a follow-up, and that mark auxiliary links.
INCLUDE = ("recruitment", "vacancy", "vacancies", "advertisement", "notification", "job opening", "walk-in", "walk in", "corrigendum", "addendum", "extension of deadline", "apply online")
EXCLUDE = ("admit card", "call letter", "scorecard", "score card", "result", "shortlisted", "shortlist", "selected candidates", "selection list", "interview schedule", "medical examination", "document verification")
AUXILIARY = ("frequently asked", "faq", "important instruction", "mock test", "english newspaper", "hindi newspaper", "apply online")
#: Link texts that are no title.
GENERIC = ("click here", "details", "download", "download advertisement", "view", "view details", "apply online")
#: The shapes of a date, and what stands before one.
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DAY = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
DATE = rf"(?:{DAY}|\d{{1,2}}\s+{MONTH}\s+\d{{4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}})"
CLOSES = rf"(?i)(?:last\s+date|closing\s+date|application\s+closes?|apply\s+(?:by|before)|online\s+application[^\n]{{0,60}}?(?:till|until|up\s+to|closes?\s+on))[^\n]{{0,40}}?({DATE})"
PUBLISHED = rf"(?i)(?:published\s+(?:on|date)|advertisement\s+date|dated?)[^\n]{{0,30}}?({DATE})"
POSTED = rf"(?i)(?:post\s+date|posted\s+on)\s*:?\s*({DAY})"


def kind(c: Column) -> Column:
    """corrigendum, addendum, deadline_extension, walk_in, or advertisement."""
    t = F.lower(text(c))
    return (
        F.when(t.contains("corrigendum"), "corrigendum")
        .when(t.contains("addendum"), "addendum")
        .when(t.contains("extension") & contains_any(t, ("deadline", "last date")), "deadline_extension")
        .when(contains_any(t, ("walk-in", "walk in")), "walk_in")
        .otherwise("advertisement")
    )


def closing(c: Column) -> Column:
    return F.trim(F.regexp_extract(text(c), CLOSES, 1))


def published(c: Column) -> Column:
    return F.trim(F.regexp_extract(text(c), PUBLISHED, 1))


def posted(c: Column) -> Column:
    return F.trim(F.regexp_extract(text(c), POSTED, 1))


def is_notice(c: Column, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE, follow_ups: bool = False) -> Column:
    """Any word of a notice, and none of a follow-up unless those are wanted."""
    t = F.lower(text(c))
    found = contains_any(t, [x.lower() for x in include])
    return found if follow_ups else found & ~contains_any(t, [x.lower() for x in exclude])


def is_auxiliary(link_text: Column) -> Column:
    return contains_any(F.lower(text(link_text)), AUXILIARY)


def anchor_passes(c: Column, include: Sequence[str], required: Sequence[str], excluded: Sequence[str]) -> Column:
    """Any include pattern (none given: passes), every required one, and none of the excluded."""
    t = F.lower(text(c))
    ok = contains_any(t, [x.lower() for x in include]) if include else F.lit(True)
    for x in required:
        ok = ok & t.contains(x.lower())
    return ok & ~contains_any(t, [x.lower() for x in excluded])


def is_pdf(content_type: Column, path: Column) -> Column:
    """Whether a document is read as PDF, by its type or the end of its path."""
    return F.lower(text(content_type)).contains("pdf") | F.lower(text(path)).endswith(".pdf")
