"""Paging contracts over landed pages: which pages of a source a reader in order would have taken, and what is wrong.

A landed page is a row with source_id, page (the order in which it was asked for) and payload. Whether a page counts depends
only on those before it, so each rule is a running window over a source: totals, the pages already met, and the first end
or contradiction. A contradiction is a row, not an exception, and the source's jobs are left out by `trusted`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolescape.functions.text import first_filled

READ, END, UNUSED, ERROR, WARNING = "read", "end", "unused", "error", "warning"


def whole_number(v: Column, path: str) -> tuple[Column, Column]:
    """A field as a non-negative integer, and whether it is there but isn't one."""
    said = F.try_variant_get(v, path, "string")
    n = said.try_cast("bigint")
    return F.when(n >= 0, n), said.isNotNull() & (n.isNull() | (n < 0))


def list_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def identities(rows: Column, key: str, *others: str) -> Column:
    """The fingerprint of a page's rows: of each its key, or else other fields."""
    said = lambda x, p: F.coalesce(F.try_variant_get(x, p, "string"), F.lit(""))
    return F.sha2(F.to_json(F.transform(rows, lambda x: first_filled(said(x, key), F.concat_ws("|", *[said(x, p) for p in others])))), 256)


def first_error(*checks: tuple[Column, Column | str]) -> Column:
    """The message of the first check that fails, else empty."""
    out = F.lit("")
    for failed, message in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(False)), F.lit(message) if isinstance(message, str) else message).otherwise(out)
    return out


def settled(pages: DataFrame, error: Column, ends: Column, warning: Column | None = None, by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """pages with outcome and error: those after the first end or error of their group are unused; a warning ends it too."""
    before = Window.partitionBy(*by).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    warned = F.lit("") if warning is None else warning
    df = pages.withColumns({"_error": error, "_warned": warned}).withColumn("_stop", (F.col("_error") != "") | (F.col("_warned") != "") | F.coalesce(ends, F.lit(False)))
    over = F.coalesce(F.max("_stop").over(before), F.lit(False))
    outcome = F.when(over, UNUSED).when(F.col("_error") != "", ERROR).when(F.col("_warned") != "", WARNING).when(F.col("n") == 0, END).otherwise(READ)
    told = F.when(over, "").otherwise(F.concat("_error", "_warned"))
    return df.withColumns({"outcome": outcome, "error": told}).drop("_error", "_warned", "_stop")


def oracle_pages(landed: DataFrame, page_size: int = 100, max_scan: int = 2500, max_pages: int = 30) -> DataFrame:
    """source_id, page, n, expected (the offset asked for), outcome, error of pages with Offset, Limit and TotalJobsCount.

    Errors: a payload of another shape, figures that are no whole numbers, an offset, limit or total that contradicts what
    was asked for and came, a page met before, and more pages than max_pages. A page without rows ends the source, as do the
    announced total, a page that isn't full, and max_scan rows.
    """
    page_size = min(page_size, 100)
    v = F.try_parse_json("payload")
    wrapper = F.try_variant_get(v, "$.items[0]", "variant")
    items = list_at(v, "$.items")
    (total, bad_total), (limit, bad_limit), (offset, bad_offset) = (whole_number(wrapper, f"$.{f}") for f in ("TotalJobsCount", "Limit", "Offset"))
    rows = F.coalesce(list_at(wrapper, "$.requisitionList"), F.array().cast("array<variant>"))
    shape = first_error((items.isNull(), "items must be a list"), (F.try_variant_get(wrapper, "$.requisitionList", "variant").isNotNull() & list_at(wrapper, "$.requisitionList").isNull(), "requisitionList must be a list"), *[(bad, f"{f} must be a non-negative integer") for bad, f in ((bad_total, "TotalJobsCount"), (bad_limit, "Limit"), (bad_offset, "Offset"))])
    df = landed.select("source_id", "page", F.size(rows).alias("n"), total.alias("total"), limit.alias("row_limit"), offset.alias("row_offset"), identities(rows, "$.Id", "$.Title", "$.PrimaryLocation", "$.PostedDate").alias("print"), shape.alias("shape"))
    order = Window.partitionBy("source_id").orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"expected": F.coalesce(F.sum("n").over(before), F.lit(0)), "nth": F.row_number().over(order), "times": F.row_number().over(Window.partitionBy("source_id", "print").orderBy("page"))})
    asked = F.least(F.lit(page_size), F.lit(max_scan) - F.col("expected"))
    upto = F.col("expected") + F.col("n")
    error = first_error(
        (F.col("nth") > max_pages, f"exceeded max_pages={max_pages}"), (F.col("shape") != "", F.col("shape")),
        (F.col("row_offset") != F.col("expected"), F.concat(F.lit("returned Offset="), F.col("row_offset"), F.lit(" for requested offset="), F.col("expected"))),
        ((F.col("row_limit") > asked) | (F.col("n") > F.col("row_limit")), "returned contradictory Limit metadata"), (F.col("total") < upto, "returned contradictory TotalJobsCount"), ((F.col("n") > 0) & (F.col("times") > 1), "repeated a pagination page"),
    )
    ends = (F.col("n") == 0) | F.coalesce(upto >= F.col("total"), F.lit(False)) | (F.col("n") < asked) | (upto >= max_scan)
    return settled(df, error, ends).select("source_id", "page", "n", "expected", "outcome", "error")


def lever_pages(landed: DataFrame, page_size: int = 100, max_pages: int = 30) -> DataFrame:
    """source_id, page, n, expected, outcome, error of pages that are plain lists, asked for by skip and limit.

    Errors: a payload that is no list, a page met before, more pages than max_pages. A page that isn't full ends the source.
    """
    rows = list_at(F.try_parse_json("payload"), "$")
    some = F.coalesce(rows, F.array().cast("array<variant>"))
    df = landed.select("source_id", "page", F.size(some).alias("n"), rows.isNull().alias("other"), identities(some, "$.id", "$.text", "$.hostedUrl").alias("print"))
    order = Window.partitionBy("source_id").orderBy("page")
    df = df.withColumns({"expected": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "nth": F.row_number().over(order), "times": F.row_number().over(Window.partitionBy("source_id", "print").orderBy("page"))})
    error = first_error((F.col("nth") > max_pages, f"exceeded max_pages={max_pages}"), (F.col("other"), "returned invalid Lever data"), ((F.col("n") > 0) & (F.col("times") > 1), "repeated a pagination page"))
    return settled(df, error, F.col("n") < page_size).select("source_id", "page", "n", "expected", "outcome", "error")


def workday_pages(landed: DataFrame, page_size: int = 20, max_scan: int = 3000, max_pages: int = 40, repeat: str = "fail") -> DataFrame:
    """source_id, term, page, n, expected, outcome, error of search pages with a column term; page counts over a source.

    A term's pages end with an empty or short page or the announced total. A page met before in its term is an error of the
    source, or with repeat="stop_search_term" a warning that ends the term. Over all terms of a source, max_scan rows and
    max_pages pages end it, the latter with a warning.
    """
    if repeat not in ("fail", "stop_search_term"):
        raise ValueError("repeat must be fail or stop_search_term")
    v = F.try_parse_json("payload")
    rows = F.coalesce(list_at(v, "$.jobPostings"), F.array().cast("array<variant>"))
    total, bad = whole_number(v, "$.total")
    df = landed.select("source_id", "term", "page", F.size(rows).alias("n"), total.alias("total"), bad.alias("bad"), list_at(v, "$.jobPostings").isNull().alias("other"), identities(rows, "$.externalPath", "$.title", "$.locationsText").alias("print"))
    in_term = Window.partitionBy("source_id", "term").orderBy("page")
    df = df.withColumns({"expected": F.coalesce(F.sum("n").over(in_term.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "times": F.row_number().over(Window.partitionBy("source_id", "term", "print").orderBy("page"))})
    again = (F.col("n") > 0) & (F.col("times") > 1)
    message = F.concat(F.lit("repeated a pagination page at offset="), F.col("expected"))
    error = first_error((F.col("other"), "jobPostings must be a list"), (F.col("bad"), "total must be a non-negative integer"), (again & F.lit(repeat == "fail"), message))
    warned = F.when(again & F.lit(repeat != "fail"), F.concat(message, F.lit("; stopped this search term"))).otherwise("")
    upto = F.col("expected") + F.col("n")
    terms = settled(df, error, (F.col("n") == 0) | F.coalesce((F.col("total") > 0) & (upto >= F.col("total")), F.lit(False)) | (F.col("n") < page_size), warned, ("source_id", "term"))
    # over the terms of a source: what its reached pages add up to, and the first error
    reached = F.col("outcome") != UNUSED
    before = Window.partitionBy("source_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    out = terms.withColumns({"_rows": F.coalesce(F.sum(F.when(F.col("outcome") == READ, F.col("n"))).over(before), F.lit(0)), "_pages": F.coalesce(F.count_if(reached).over(before), F.lit(0)), "_failed": F.coalesce(F.max(F.col("outcome") == ERROR).over(before), F.lit(False))})
    over, full = F.col("_failed") | (F.col("_rows") >= max_scan) | (F.col("_pages") > max_pages), reached & (F.col("_pages") == max_pages)
    outcome = F.when(over, UNUSED).when(full, WARNING).otherwise(F.col("outcome"))
    told = F.when(over, "").when(full, f"stopped at configured max_pages={max_pages}").otherwise(F.col("error"))
    return out.select("source_id", "term", "page", "n", "expected", outcome.alias("outcome"), told.alias("error"))


def trusted(landed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The landed pages that were read, of sources without an error."""
    failed = verdicts.where(F.col("outcome") == ERROR).select("source_id").distinct()
    taken = verdicts.where(F.col("outcome") == READ).select("source_id", "page")
    return landed.join(taken, ["source_id", "page"], "left_semi").join(failed, "source_id", "left_anti")
