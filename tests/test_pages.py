"""Paging contracts, walks, dictionaries and broken pages on small inputs."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from rolescape.functions import phrases
from rolescape.operators import contacts, matching
from rolescape.sources import html, paging, walks

LANDED = "source_id string, page int, payload string"


def wrapped(rows, total=None, limit=2, offset=None, **more):
    fields = {"TotalJobsCount": total, "Limit": limit, "Offset": offset, "requisitionList": rows} | more
    return json.dumps({"items": [{k: v for k, v in fields.items() if v is not None}]})


def ids(*names):
    return [{"Id": n, "Title": "Engineer"} for n in names]


def test_oracle_paging_contracts(spark):
    sources = {
        "two pages": ([wrapped(ids("1", "2"), 3, offset=0), wrapped(ids("3"), 3, offset=2), wrapped(ids("9"), 3, offset=3)], ["read", "read", "unused"], ""),
        "repeated": ([wrapped(ids("1", "2"), 10), wrapped(ids("1", "2"), 10)], ["read", "error"], "repeated a pagination page"),
        "no list": (['{"items": "not-a-list"}'], ["error"], "items must be a list"),
        "no json": (["<html>"], ["error"], "items must be a list"),
        "empty": ([wrapped([], 0)], ["end"], ""),
        "one": ([wrapped(ids("1"), 1)], ["read"], ""),
        "offset": ([wrapped([], 0, Offset="invalid")], ["error"], "Offset must be a non-negative integer"),
        "limit": ([wrapped([], 0, limit=-1)], ["error"], "Limit must be a non-negative integer"),
        "total": ([wrapped([], "not-a-number")], ["error"], "TotalJobsCount must be a non-negative integer"),
        "ignored offset": ([wrapped(ids("1", "2"), 4, offset=0), wrapped(ids("1", "2"), 4, offset=0)], ["read", "error"], "returned Offset=0 for requested offset=2"),
        "more than the limit": ([wrapped(ids("1", "2", "3"), 4)], ["error"], "returned contradictory Limit metadata"),
        "less than came": ([wrapped(ids("1", "2"), 1)], ["error"], "returned contradictory TotalJobsCount"),
        "rows of another shape": ([json.dumps({"items": [{"requisitionList": 3}]})], ["error"], "requisitionList must be a list"),
        "too many": ([wrapped(ids(str(2 * i), str(2 * i + 1)), 50) for i in range(4)], ["read", "read", "read", "error"], "exceeded max_pages=3"),
    }
    landed = spark.createDataFrame([(s, i, p) for s, (pages, _, _) in sources.items() for i, p in enumerate(pages)], LANDED).repartition(4)
    got = paging.oracle_pages(landed, page_size=2, max_pages=3)
    rows = sorted(map(tuple, got.select("source_id", "page", "outcome", "error").collect()))
    for s, (_, outcomes, error) in sources.items():
        own = [r for r in rows if r[0] == s]
        assert [r[2] for r in own] == outcomes and "".join(r[3] for r in own) == error, s
    taken = {(r["source_id"], r["page"]) for r in paging.trusted(landed, got).collect()}
    assert taken == {("two pages", 0), ("two pages", 1), ("one", 0)}
    full = spark.createDataFrame([("s", 0, wrapped(ids("1", "2", "3"), 50, 3)), ("s", 1, wrapped(ids("4"), 50, 3))], LANDED)
    assert [r["outcome"] for r in paging.oracle_pages(full, page_size=20, max_scan=3).orderBy("page").collect()] == ["read", "unused"]
    assert paging.oracle_pages(landed.limit(0)).collect() == []


def test_lever_and_workday_paging(spark):
    row = lambda *names: json.dumps([{"id": n} for n in names])
    landed = spark.createDataFrame([("a", 0, row("1", "2")), ("a", 1, row("3")), ("a", 2, row("4")), ("b", 0, row("1", "2")), ("b", 1, row("1", "2")), ("c", 0, "{}")], LANDED)
    got = {(r["source_id"], r["page"]): (r["outcome"], r["error"]) for r in paging.lever_pages(landed, page_size=2).collect()}
    assert got == {("a", 0): ("read", ""), ("a", 1): ("read", ""), ("a", 2): ("unused", ""), ("b", 0): ("read", ""), ("b", 1): ("error", "repeated a pagination page"), ("c", 0): ("error", "returned invalid Lever data")}
    jobs = lambda *paths, total=None: json.dumps({"jobPostings": [{"externalPath": p} for p in paths]} | ({} if total is None else {"total": total}))
    pages = [("x", jobs("/1", "/2")), ("x", jobs("/1", "/2")), ("y", jobs("/1", "/2", total=3)), ("y", jobs("/3", total=3)), ("y", jobs("/4"))]
    df = spark.createDataFrame([("w", t, i, p) for i, (t, p) in enumerate(pages)], "source_id string, term string, page int, payload string")
    stop = {r["page"]: (r["outcome"], r["expected"]) for r in paging.workday_pages(df, 2, repeat="stop_search_term").collect()}
    assert stop == {0: ("read", 0), 1: ("warning", 2), 2: ("read", 0), 3: ("read", 2), 4: ("unused", 3)}
    assert [r["outcome"] for r in paging.workday_pages(df, 2).orderBy("page").collect()] == ["read", "error", "unused", "unused", "unused"]
    assert [r["outcome"] for r in paging.workday_pages(df, 2, max_pages=3, repeat="stop_search_term").orderBy("page").collect()] == ["read", "warning", "read", "warning", "unused"]
    assert [r["outcome"] for r in paging.workday_pages(df, 2, max_scan=4, repeat="stop_search_term").orderBy("page").collect()] == ["read", "warning", "read", "unused", "unused"]
    with pytest.raises(ValueError):
        paging.workday_pages(df, repeat="other")


def test_sitemap_walk_in_queue_order(spark):
    site = "https://a.example/"
    rows = [("0", True, "1"), ("0", True, "2"), ("0", True, "https://b.example/x"), ("0", True, "https://c.example/y"), ("1", True, "0"), ("1", True, "3"), ("2", False, "jobs/1"), ("2", False, "about"), ("3", False, "jobs/2"), ("3", False, "jobs/1"), ("3", False, "ftp://a.example/jobs/3"), ("https://b.example/x", False, "jobs/9")]
    full = lambda x: x if ":" in x else site + x
    links = spark.createDataFrame([(full(a), i, full(b), n) for n, (a, i, b) in enumerate(rows)], "url string, is_index boolean, loc string, loc_at int")
    roots = spark.createDataFrame([("s", site + "0"), ("s", site + "0"), ("none", "ftp://a.example/0")], "source_id string, url string")
    maps, pages = walks.sitemap_walk(roots, links, allowed=["B.example"], patterns=["/jobs/"])
    assert [(r["url"], r["depth"]) for r in maps.orderBy("position").collect()] == [(site + "0", 0), (site + "1", 1), (site + "2", 1), ("https://b.example/x", 1), (site + "3", 2)]
    assert [r["url"] for r in pages.orderBy("position").collect()] == [site + "jobs/1", site + "jobs/9", site + "jobs/2"]
    maps, pages = walks.sitemap_walk(roots, links, max_sitemaps=3, max_items=1)
    assert [r["url"] for r in maps.orderBy("position").collect()] == [site + "0", site + "1", site + "2"] and [r["url"] for r in pages.collect()] == [site + "jobs/1"]


@pytest.mark.parametrize("seed", range(2))
def test_crawl_equals_a_plain_queue(spark, seed):
    rng = random.Random(seed)
    pages = [f"p{i}" for i in range(25)]
    hrefs = {p: [rng.choice([*pages, "gone"]) for _ in range(rng.randrange(0, 5))] for p in pages}
    seeds = {f"t{i}": [rng.choice([*pages, "gone"]) for _ in range(3)] for i in range(8)}
    want = set()
    for target, first in seeds.items():
        queue, done = deque(first), []
        while queue and len(done) < 6:
            p = queue.popleft()
            if p in hrefs and p not in done:
                done.append(p)
                queue += hrefs[p]
        want |= {(target, p, i) for i, p in enumerate(done)}
    rows = [(p, i, h) for p, hs in hrefs.items() for i, h in enumerate(hs)] + [(p, None, None) for p, hs in hrefs.items() if not hs]
    links = spark.createDataFrame(rows, "url string, position int, href string")
    start = spark.createDataFrame([(t, i, p) for t, ps in seeds.items() for i, p in enumerate(ps)], "target string, position int, url string")
    assert {tuple(r) for r in walks.frontier_crawl(start, links, 6).collect()} == want


def test_a_large_dictionary_finds_what_expressions_find(spark):
    rng = random.Random(3)
    aliases = ["of the", "of  The", "c++", "l&t", "e3d", "the", "3d model", "model", "a.b", "(x)"] + [f"{rng.choice('abc')}{i} {rng.choice('de')}" for i in range(300)]
    words = ["of", "the", "\tthe", "c++", "L&T", "e3d", "ae3d", "3d", "\n model", "a.b", "axb", "(x)", "é", "thé", "a1", "b2", "c3", "d", "e", " "]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(80)] + [(80, None), (81, "")]
    df = spark.createDataFrame(texts, "id long, t string")
    lowered = F.lower("t")
    plain = F.array_compact(F.array(*[F.when(phrases.contains_phrase(lowered, a), F.lit(i)) for i, a in enumerate(aliases[:40])]))
    rows = df.select("id", phrases.found(lowered, aliases[:40]).alias("x"), F.coalesce(plain, F.array().cast("array<int>")).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in rows) and sum(len(r["x"]) for r in rows) > 100
    groups = tuple((f"g{i % 7}", (a,)) for i, a in enumerate(aliases))
    got = df.select(matching.first_match(lowered, groups[:30]).alias("x"), matching.first_by_pattern(F.coalesce(lowered, F.lit("")), groups[:30]).alias("y"), matching.all_matches(lowered, groups).alias("z")).collect()
    assert all(r["x"] == r["y"] for r in got) and any(r["z"] for r in got)


def test_json_ld_of_any_type_depth_and_shape(spark):
    post = {"@type": ["Thing", "JobPosting"], "title": "Designer", "skills": "<b>e3d</b>"}
    deep = "[" * 30000 + "]" * 30000
    pages = [
        (1, f'<script type="application/ld+json; charset=utf-8">{json.dumps({"@graph": [post]})}</script>'),
        (2, f'<script type="application/ld+json">{deep}</script><script type="Application/LD+JSON">{json.dumps(post | {"hiringOrganization": {"name": "Acme"}})}</script>'),
        (3, '<script type="application/ld+json">{"a": </script>'), (4, None), (5, "<![bad <a href='x'>y</a>"),
    ]
    df = spark.createDataFrame(pages, "k long, html string")
    assert {(r["k"], r["title"], r["company"], r["skills_text"]) for r in html.postings(df, "k", "html", company="Given").collect()} == {(1, "Designer", "Given", "e3d"), (2, "Designer", "Acme", "e3d")}
    nested = {"@graph": [{"n": 1}, [{"n": 2, "@graph": [{"n": 3}]}]], "n": 4}
    assert [x["n"] for x in html.flatten(nested)] == [1, 3, 2, 4]


def test_a_page_that_fails_leaves_the_others(spark):
    def fails(m):
        if m == "bad":
            raise RecursionError
        yield (m,)

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "k long, html string").coalesce(1)
    assert {tuple(r) for r in html.per_page(df, "k", "html", fails, "m string", ["m"]).collect()} == {(1, "a"), (3, "c")}


def test_contact_files_by_their_own_headers(spark, tmp_path):
    for shard, text in {"a": "organization,email,country\nAcme,a@x.example,IN\n", "b": 'email,organization\r\nb@x.example,"Be, Inc"\r\n', "c": "email,organization\n"}.items():
        (tmp_path / shard).mkdir()
        (tmp_path / shard / "All_Official_Contacts.csv").write_text(text)
    got = contacts.read_outputs(spark, str(tmp_path)).select("organization", "email", "country")
    assert sorted(map(tuple, got.collect())) == [("Acme", "a@x.example", "IN"), ("Be, Inc", "b@x.example", "")]
