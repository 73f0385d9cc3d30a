"""Date text to timestamps, UTC. `as_of` is always a parameter; nothing reads the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolescape.functions.text import text

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
#: The named formats of the shortlist and of the 48-hour report.
SHORTLIST_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")
REPORT_FORMATS = ("d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "M/d/yyyy")


def iso(c: Column) -> Column:
    """ISO date or date-time text as a timestamp; naive text is UTC; anything else is null."""
    t = F.trim(text(c))
    return F.when(t.rlike(ISO), F.replace(t, F.lit(","), F.lit(".")).try_cast("timestamp"))


def parsed(c: Column, formats: Sequence[str] = SHORTLIST_FORMATS) -> Column:
    """ISO, else the first of the named formats that fits; null if none does."""
    t = F.trim(text(c))
    return F.coalesce(iso(c), *[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def utc_text(c: Column) -> Column:
    """A timestamp as ISO text with seconds and offset; null as empty."""
    return F.coalesce(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), F.lit(""))


def since(c: Column, as_of: Column, days: int) -> Column:
    """Whether a timestamp is not older than some days; null and unknown are not."""
    return F.coalesce(c >= as_of - F.make_interval(days=F.lit(days)), F.lit(False))


def publication_status(published: Column, as_of: Column, days: int = 30) -> Column:
    return (
        F.when(published.isNull(), "unknown")
        .when(published > as_of, "future_date_review")
        .when(since(published, as_of, days), f"last_{days}_days")
        .otherwise("older")
    )


def rfc822(c: Column) -> Column:
    """An e-mail date, its weekday and zone name dropped, as a timestamp."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", "")
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(t, "(GMT|UTC|UT)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss")))


def received(millis: Column, header: Column, as_of: Column) -> Column:
    """When a message came: its epoch milliseconds, else its date header, else as_of."""
    return F.coalesce(F.timestamp_millis(millis.cast("string").try_cast("bigint")), rfc822(header), as_of)
