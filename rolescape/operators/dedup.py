"""Cross-source duplicates and the summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolescape.functions.dates import iso
from rolescape.functions.text import first_filled, normalize, number, text

#: The order in which the ledger is read; it breaks ties.
LEDGER_ORDER = ("found_at desc", "company", "title", "job_key")


def ledger_order(df: DataFrame) -> list[Column]:
    return [F.desc(c.split()[0]) if c.endswith("desc") else F.asc(c) for c in LEDGER_ORDER if c.split()[0] in df.columns]


def duplicate_group(df: DataFrame) -> Column:
    """Twenty hex digits over role, company, place and date (or 120 characters of description)."""
    day = F.left(text(df["published_at"]), F.lit(10))
    parts = [normalize(first_filled(df["normalized_role"], df["title"])), normalize(df["company"]), normalize(first_filled(df["city"], df["location"], df["country"])), F.when(day != "", day).otherwise(F.left(normalize(df["description"]), F.lit(120)))]
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(20))


def best_order(df: DataFrame) -> list[Column]:
    """Which row of a group stands for it: the best scored and newest; ties fall to the smallest (company, title, key)."""
    found = text(df["found_at"]) if "found_at" in df.columns else F.lit("")
    return [F.desc(number(df["match_score"])), F.desc(text(df["published_at"])), F.desc(text(df["last_seen_at"])), F.desc(found), F.asc("company"), F.asc("title"), F.asc("job_key")]


def group_sizes(df: DataFrame) -> DataFrame:
    """duplicate_group, source_count of rows with a duplicate_group: counted before the shuffle."""
    return df.groupBy("duplicate_group").agg(F.count("*").alias("source_count"))


def best_rows(df: DataFrame) -> DataFrame:
    """The row that stands for each duplicate_group; a task keeps one of each group before the shuffle."""
    return best_per(df, "duplicate_group", *best_order(df))


def representatives(jobs: DataFrame) -> DataFrame:
    """One row of each duplicate group, the best scored and newest, with the group's size, sources and URLs.

    Sizes and best rows are cut down to one row of a group and task before they are shuffled; sources and URLs are gathered
    for groups of more than one row alone.
    """
    df = jobs.withColumn("duplicate_group", duplicate_group(jobs))
    sizes = group_sizes(df)
    seen = -F.coalesce(F.unix_micros(iso(df["found_at"])), F.lit(0)) if "found_at" in df.columns else F.lit(0)
    order = F.struct(seen.alias("f"), df["company"].alias("c"), df["title"].alias("t"), df["job_key"].alias("j"))
    said = df.select("duplicate_group", text(df["source_name"]).alias("source"), F.when(text(df["apply_url"]) != "", F.struct(order.alias("o"), df["apply_url"].alias("u"))).alias("link"))
    many = said.join(sizes.where("source_count > 1").select("duplicate_group"), "duplicate_group", "left_semi")
    lists = many.groupBy("duplicate_group").agg(
        F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("source"), F.lit("")))), "; ").alias("sources"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_set("link")), lambda x: x["u"])), "\n").alias("urls"),
    )
    out = best_rows(df).join(sizes, "duplicate_group").join(lists, "duplicate_group", "left")
    keep = [F.col(c) for c in jobs.columns if c != "duplicate_status"]
    return out.select(
        *keep, "duplicate_group", "source_count", F.coalesce("sources", text(F.col("source_name"))).alias("duplicate_sources"), F.coalesce("urls", text(F.col("apply_url"))).alias("all_apply_urls"),
        F.when(F.col("source_count") > 1, "cross_source_duplicate").otherwise("unique").alias("duplicate_status"),
    )


def representatives_sorted(jobs: DataFrame) -> DataFrame:
    """The representatives as the workbook lists them."""
    return representatives(jobs).orderBy(F.desc("match_score"), F.desc("published_at"), "company", "title", "job_key")


def variants(jobs: DataFrame) -> DataFrame:
    """All rows of groups with more than one row, with the group's size."""
    df = jobs.withColumn("duplicate_group", duplicate_group(jobs))
    return df.join(group_sizes(df).where("source_count > 1"), "duplicate_group").orderBy("duplicate_group", "source_name", "company", "title", "job_key")


def summary_by(jobs: DataFrame, column: str) -> DataFrame:
    """Rows, critical and high ones, and the newest posting for each value; empty is Unspecified."""
    key = F.when(text(jobs[column]) == "", "Unspecified").otherwise(jobs[column]).alias(column)
    out = jobs.groupBy(key).agg(F.count("*").alias("jobs"), F.count_if(jobs["priority"].isin("critical", "high")).alias("critical_high"), F.max(text(jobs["published_at"])).alias("newest_posting"))
    return out.orderBy(F.desc("critical_high"), F.desc("jobs"), column)


def best_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order; the rows before it in a partition are dropped before the shuffle."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in an order; a null is a key of its own."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with each row's place in an order, from 0, without one task that sees all rows.

    Rows are dealt by ranges of the order and written once by a checkpoint, so the ranges can't change; a row's place
    is its place in its range and the rows of the ranges before, a number for each range.
    """
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", at).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def dealt_shards(df: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """Distinct rows by keys with the shard that takes them in turn."""
    return numbered(df.dropDuplicates(keys), keys).withColumn("shard", F.pmod("position", F.lit(shards)).cast("long")).drop("position")
