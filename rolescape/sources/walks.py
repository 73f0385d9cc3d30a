"""Walks over landed pages: sitemaps by breadth, and sites by a first-in-first-out frontier with a cap for each site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolescape.functions.urls import host, is_web, matches_pattern
from rolescape.shared import written


def within(df: DataFrame, url: str, allowed: Sequence[str] | None) -> DataFrame:
    """Rows whose URL is a web address and whose host is the site or one of the allowed ones."""
    own = F.lower(host(F.col(url)))
    same = own == F.col("site")
    return df.where(is_web(F.col(url)) & (same if not allowed else same | own.isin(*[d.lower() for d in allowed])))


def sitemap_walk(roots: DataFrame, links: DataFrame, allowed: Sequence[str] | None = None, max_depth: int = 10, max_sitemaps: int | None = None, patterns: Sequence[str] = (), max_items: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sitemaps, pages) that are reached from roots (source_id, url) over landed sitemaps (url, is_index, loc).

    sitemaps has source_id, url, depth, position: each sitemap once for a source, at its smallest depth, in the order of a
    queue; at most max_sitemaps of a source. pages has source_id, url, position: the web addresses of their entries that
    match a pattern, each once, in order of the sitemaps, at most max_items. Only hosts of the root or allowed ones are
    followed. A round is a join of the newest sitemaps with the links; cycles end it, since a sitemap is visited once.
    """
    start = roots.select("source_id", "url", F.lower(host(F.col("url"))).alias("site"))
    newest = written(within(start, "url", allowed).select("source_id", "site", "url", F.lit(0).alias("depth"), F.array(F.lit(0).cast("long")).alias("route")).dropDuplicates(["source_id", "url"]), "sitemaps")
    seen, known = newest, links.select("url", "is_index", "loc", F.col("loc_at").cast("long").alias("loc_at"))
    for depth in range(1, max_depth + 1):
        step = newest.join(known.where("is_index"), "url").select("source_id", "site", F.col("loc").alias("url"), F.lit(depth).alias("depth"), F.concat("route", F.array("loc_at")).alias("route"))
        step = within(step, "url", allowed).join(seen.select("source_id", "url"), ["source_id", "url"], "left_anti")
        first = step.groupBy("source_id", "site", "url", "depth").agg(F.min("route").alias("route"))
        newest = written(first.select(*seen.columns), "sitemaps")
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    order = Window.partitionBy("source_id").orderBy("depth", "route", "url")
    queue = seen.withColumn("position", F.row_number().over(order) - 1)
    if max_sitemaps is not None:
        queue = queue.where(F.col("position") < max_sitemaps)
    queue = written(queue, "sitemap-queue")
    entries = queue.join(known.where("NOT is_index"), "url").select("source_id", "site", F.col("loc").alias("url"), F.struct("position", "loc_at").alias("at"))
    entries = within(entries, "url", allowed)
    if patterns:
        entries = entries.where(matches_pattern(F.col("url"), patterns))
    pages = entries.groupBy("source_id", "url").agg(F.min("at").alias("at"))
    pages = pages.withColumn("position", F.row_number().over(Window.partitionBy("source_id").orderBy("at")) - 1)
    if max_items is not None:
        pages = pages.where(F.col("position") < max_items)
    return queue.select("source_id", "url", "depth", "position"), pages.select("source_id", "url", "position")


def frontier_crawl(seeds: DataFrame, links: DataFrame, max_pages: int = 8) -> DataFrame:
    """target, url, position: the landed pages a crawl visits for each target, in the order of its queue.

    seeds are (target, position, url), links (url, position, href) of landed pages; a URL without a landed page is not visited and
    takes no place. The queue is first in, first out: the seeds in order, then the links of each visited page in order, each
    URL once; a target ends at max_pages pages. A round visits all pages a target's queue holds, so the rounds are at most
    max_pages, and no target's queue ever holds more than the pages of max_pages visits link to.
    """
    landed = written(links.select("url").distinct(), "landed")
    hops = links.where("href IS NOT NULL").select("url", F.col("position").cast("long").alias("link"), "href")
    once = lambda df, order: df.groupBy("target", "url").agg(F.min(order).alias("place"))
    queue = once(seeds.select("target", "url", F.col("position").cast("long").alias("p")), F.struct(F.lit(0).cast("long").alias("from"), F.col("p").alias("link"))).join(landed, "url", "left_semi")
    visited = None
    for _ in range(max_pages):
        before = visited.groupBy("target").agg(F.count("*").alias("done")) if visited is not None else None
        ranked = queue.withColumn("nth", F.row_number().over(Window.partitionBy("target").orderBy("place", "url")))
        ranked = ranked.join(before, "target", "left") if before is not None else ranked.withColumn("done", F.lit(0).cast("long"))
        ranked = ranked.withColumn("position", F.coalesce("done", F.lit(0)) + F.col("nth") - 1).where(F.col("position") < max_pages)
        newest = written(ranked.select("target", "url", F.col("position").cast("long").alias("position")), "visited")
        if newest.isEmpty():
            break
        visited = newest if visited is None else visited.unionByName(newest)
        more = newest.join(hops, "url").select("target", F.col("href").alias("url"), F.struct(F.col("position").alias("from"), F.col("link")).alias("p"))
        queue = once(more, "p").join(landed, "url", "left_semi").join(visited.select("target", "url"), ["target", "url"], "left_anti")
    if visited is None:
        return seeds.sparkSession.createDataFrame([], "target string, url string, position long")
    return visited.select("target", "url", "position")
