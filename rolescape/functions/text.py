"""Text column builders. Missing text is the empty string throughout; Python-style white space includes NBSP."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def text(c: Column) -> Column:
    """A column as text, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that the optimizer won't put in place of every use of theirs."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def first_filled(*columns: Column) -> Column:
    """The first column that isn't empty, else empty."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in columns], F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text(c), SPACE, " "))


def normalize(c: Column) -> Column:
    """Lower case; runs of anything but ASCII letters and digits as one space; ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def folded(c: Column) -> Column:
    """Lower case (ß as ss) with white space collapsed, for names that are compared."""
    return F.replace(F.lower(collapse(c)), F.lit("ß"), F.lit("ss"))


def join_filled(columns: Sequence[Column], separator: str) -> Column:
    """The non-empty columns, joined."""
    return F.array_join(F.filter(F.array(*[text(c) for c in columns]), lambda x: x != ""), separator)


def join_trimmed(values: Column, separator: str = ", ") -> Column:
    """The non-empty trimmed elements of an array, joined."""
    return F.array_join(F.filter(F.transform(values, lambda x: F.trim(text(x))), lambda x: x != ""), separator)


def list_text(values: Column) -> Column:
    """An array as "a; b"; null as empty."""
    return F.coalesce(F.array_join(values, "; "), F.lit(""))


def phrase_pattern(phrase: str) -> str:
    """A pattern for a phrase between ASCII alphanumeric boundaries, any white space between its words."""
    words = [re.sub(r"([^a-z0-9])", r"\\\1", w) for w in phrase.lower().split()]
    return r"(?<![a-z0-9])" + r"\s+".join(words) + r"(?![a-z0-9])"


def contains_phrase(lowered: Column, phrase: str) -> Column:
    return lowered.rlike(phrase_pattern(phrase)) if phrase.split() else F.lit(False)


def contains_any(lowered: Column, terms: Sequence[str]) -> Column:
    """Any of the terms as a plain substring."""
    found = F.lit(False)
    for t in terms:
        found = found | lowered.contains(t)
    return found


def hits(lowered: Column, terms: Sequence[str]) -> Column:
    """The distinct terms that are substrings, in sorted order."""
    return F.array_compact(F.array(*[F.when(lowered.contains(t), F.lit(t)) for t in sorted(set(terms))]))


def terms_pass(lowered: Column, terms: Sequence[str], phrases: bool = False) -> Column:
    """Include filter: an empty list passes; else any term as substring, or as phrase."""
    if not terms:
        return F.lit(True)
    if not phrases:
        return contains_any(lowered, [t.lower() for t in terms])
    found = F.lit(False)
    for t in terms:
        found = found | contains_phrase(lowered, t)
    return found


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def slug(c: Column, limit: int = 44) -> Column:
    """Lower-case ASCII words joined by hyphens, cut to a length."""
    body = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.left(body, F.lit(limit)), "-+$", "")


def source_id(company: Column, kind: Column, identity: Column, limit: int = 64) -> Column:
    """A stable id: slug, kind and ten hex digits of the identity's hash."""
    return F.left(F.concat(slug(company), F.lit("_"), kind, F.lit("_"), F.left(sha256(identity), F.lit(10))), F.lit(limit))


def formula_safe(c: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets an apostrophe in front."""
    return F.when(F.substring(F.ltrim(c), 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(c)


def markdown_cell(c: Column) -> Column:
    return F.replace(collapse(c), F.lit("|"), F.lit("\\|"))


def number(c: Column) -> Column:
    """Text as a number; what isn't one is 0."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    """part of whole in percent at one digit, half to even; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part * 100.0 / whole, 1))


def context(c: Column, needle: Column, radius: int = 160, limit: int = 400) -> Column:
    """The text around the first place of needle, ignoring case, collapsed and cut; empty if it isn't there."""
    at = F.instr(F.lower(c), F.lower(needle))
    start = F.greatest(F.lit(1), at - radius)
    return F.when(at == 0, F.lit("")).otherwise(F.left(collapse(F.substr(c, start, at + F.length(needle) + radius - start)), F.lit(limit)))


def line_value(c: Column, label_pattern: str, limit: int) -> Column:
    """The value after a label at the start of a line, cut to a length."""
    return F.left(F.trim(F.regexp_extract(text(c), rf"(?im)^\s*(?:{label_pattern})\s*[:\-]\s*([^\r\n]+)$", 1)), F.lit(limit))


def salary(low: Column, high: Column, currency: Column, per: Column) -> Column:
    """"USD 1 - 2 per YEAR", with one figure if only one is known; empty without figures."""
    figures = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat_ws(" - ", low, high)).otherwise(F.coalesce(low, high))
    unit = F.when(text(per) != "", F.concat(F.lit("per "), per))
    return F.when(figures.isNull(), F.lit("")).otherwise(F.concat_ws(" ", F.nullif(text(currency), F.lit("")), figures, unit))


CLOSING = r"(?i)(?:closing date|application deadline|apply by|last date)\s*[:\-]\s*([^\n\r|;]{4,80})"


def closing_date_text(c: Column) -> Column:
    """The text after a closing-date label, 4 to 80 characters, collapsed."""
    return collapse(F.regexp_extract(text(c), CLOSING, 1))
