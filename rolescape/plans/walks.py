"""Named queries over landed pages in order: paging contracts, sitemap walks, crawls."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from rolescape.plans.adapters import table
from rolescape.plans.catalog import query
from rolescape.sources import html, paging, walks

#: What is wrong with a source, by its number modulo 7: nothing, an offset that is ignored, a page that comes again, a total
#: that is too small, a limit below its rows, a total that is no number, too many pages.
SIZE, PAGES = 20, 8

_LISTED = f"""listed AS (SELECT l_suppkey AS s, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS r FROM lineitem),
 sized AS (SELECT s, count(*) AS whole FROM listed GROUP BY s),
 paged AS (SELECT s, r // {SIZE} AS page, count(*) AS n FROM listed GROUP BY 1, 2),
 shown AS (SELECT s, page, whole, s % 7 AS c, CASE WHEN s % 7 = 2 AND page = 1 THEN (SELECT p.n FROM paged p WHERE p.s = paged.s AND p.page = 0) ELSE n END AS n FROM paged JOIN sized USING (s))"""


@query(f"""WITH {_LISTED}, base AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY s ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS expected FROM shown),
 judged AS (SELECT *, CASE WHEN page >= {PAGES} THEN 'exceeded max_pages={PAGES}' WHEN c = 5 AND page = 1 THEN 'TotalJobsCount must be a non-negative integer' WHEN c = 1 AND page > 0 THEN 'returned Offset=0 for requested offset=' || expected
   WHEN c = 4 AND page = 2 AND n > 3 THEN 'returned contradictory Limit metadata' WHEN c = 3 AND expected + n > 50 THEN 'returned contradictory TotalJobsCount' WHEN c = 2 AND page = 1 THEN 'repeated a pagination page' ELSE '' END AS error,
   n < {SIZE} OR expected + n >= CASE WHEN c = 3 THEN 50 ELSE whole END AS last FROM base),
 ended AS (SELECT *, coalesce(bool_or(error <> '' OR last) OVER (PARTITION BY s ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM judged)
 SELECT CAST(s AS VARCHAR) AS source_id, page, n, expected, CASE WHEN over THEN 'unused' WHEN error <> '' THEN 'error' ELSE 'read' END AS outcome, CASE WHEN over THEN '' ELSE error END AS error FROM ended""")
def paging_contracts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("id")) - 1)
    whole = rows.groupBy("s").agg(F.count("*").alias("whole"))
    pages = rows.withColumn("page", F.floor(F.col("r") / SIZE).cast("long")).groupBy("s", "page").agg(F.array_sort(F.collect_list("id")).alias("ids")).join(whole, "s")
    c, page = F.col("s") % 7, F.col("page")
    first = pages.where("page = 0").select("s", F.col("ids").alias("first"))
    pages = pages.join(first, "s").withColumn("ids", F.when((c == 2) & (page == 1), F.col("first")).otherwise(F.col("ids")))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    total: Column = F.when((c == 5) & (page == 1), '"many"').otherwise(F.when(c == 3, F.lit(50)).otherwise(F.col("whole")).cast("string"))
    offset = F.when(c == 1, F.lit(0)).otherwise(page * SIZE).cast("string")
    limit = F.when((c == 4) & (page == 2), F.lit(3)).otherwise(F.lit(SIZE)).cast("string")
    # a page that comes again says no offset, so that it is known by its rows alone
    said = F.concat_ws(",", field("TotalJobsCount", total), field("Limit", limit), F.when(~((c == 2) & (page == 1)), field("Offset", offset)), field("requisitionList", F.to_json(F.transform("ids", lambda i: F.struct(i.cast("string").alias("Id"), F.lit("Clerk").alias("Title"))))))
    landed = pages.select(F.col("s").cast("string").alias("source_id"), "page", F.concat(F.lit('{"items":[{'), said, F.lit("}]}")).alias("payload"))
    return paging.oracle_pages(landed, SIZE, 100_000, PAGES).select("source_id", "page", F.col("n").cast("long").alias("n"), F.col("expected").cast("long").alias("expected"), "outcome", "error")


#: Each link of a page leads to the page whose number its href's length and its place give; every third page is an index.
_GRAPH = """size AS (SELECT count(*) AS pages FROM pages), found AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1) AS h FROM pages), hops AS (SELECT page_id, unnest(range(len(h))) AS spot, h FROM found),
 graph AS (SELECT page_id AS a, spot, (page_id * 3 + len(h[spot + 1]) * 11 + spot * 7) % pages AS b FROM hops, size)"""


def graph(spark, d):
    p = table(spark, d, "pages")
    n = p.count()
    found = html.links(p, "page_id", "html")
    return found.select(F.col("page_id").alias("a"), F.col("position").alias("at"), ((F.col("page_id") * 3 + F.length("href") * 11 + F.col("position") * 7) % n).alias("b"))


def address(c: str) -> Column:
    return F.concat(F.lit("https://site.example/"), F.col(c).cast("string"))


@query(f"""WITH RECURSIVE {_GRAPH}, walk AS (SELECT p.page_id AS source, p.page_id AS page, 0 AS depth FROM pages p WHERE page_id % 30 = 0 UNION SELECT source, g.b, depth + 1 FROM walk JOIN graph g ON g.a = page AND page % 3 = 0 WHERE depth < 5),
 reached AS (SELECT source, page, min(depth) AS depth FROM walk GROUP BY 1, 2)
 SELECT 's' || source AS source_id, 'https://site.example/' || page AS url, CAST(depth AS INTEGER) AS depth FROM reached""")
def sitemap_walk(spark, d):
    g = graph(spark, d)
    links = g.select(address("a").alias("url"), (F.col("a") % 3 == 0).alias("is_index"), address("b").alias("loc"), F.col("at").alias("loc_at"))
    roots = table(spark, d, "pages").where("page_id % 30 = 0").select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("source_id"), address("page_id").alias("url"))
    return walks.sitemap_walk(roots, links, max_depth=5)[0].select("source_id", "url", "depth")


@query(f"""WITH RECURSIVE {_GRAPH}, hop AS (SELECT DISTINCT ON (a, b) a, b, spot FROM graph ORDER BY a, b, spot), grown AS (SELECT a, list(b ORDER BY spot) AS next FROM hop GROUP BY a),
 queue AS (SELECT page_id AS target, [page_id] AS q, 0 AS i FROM pages WHERE page_id % 10 = 0
  UNION ALL SELECT target, list_concat(q, list_filter(coalesce(next, []), lambda x: NOT list_contains(q, x))), i + 1 FROM queue LEFT JOIN grown ON grown.a = q[i + 1] WHERE i < 8 AND i < len(q)),
 done AS (SELECT target, q FROM queue QUALIFY row_number() OVER (PARTITION BY target ORDER BY i DESC) = 1), each AS (SELECT target, q, unnest(range(least(len(q), 8))) AS spot FROM done)
 SELECT 't' || target AS target, 'https://site.example/' || q[spot + 1] AS url, spot AS position FROM each""")
def frontier_crawl(spark, d):
    g = graph(spark, d)
    every = table(spark, d, "pages")
    links = every.select(address("page_id").alias("url"), "page_id").join(g, F.col("page_id") == F.col("a"), "left").select("url", F.col("at").alias("position"), F.when(F.col("b").isNotNull(), address("b")).alias("href"))
    seeds = every.where("page_id % 10 = 0").select(F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("target"), F.lit(0).alias("position"), address("page_id").alias("url"))
    return walks.frontier_crawl(seeds, links, 8)
