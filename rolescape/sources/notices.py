"""Notice scans over landed pages: links of a listing with their context, titles and documents, as postings.

A page is read once into an outline: the text pieces in order, and for each element the range of pieces and of elements in
it. Every link becomes a row with its address, its words, the texts around it and the headings before it. What counts as
a notice, which text is its context, which words are its title and which of several links to a document stays are column
expressions over those rows. The base rules take the text of the nearest row, list item, article, section or block; the
adaptive ones also know cards by their class, look into markup that scripts hold between backticks, and leave auxiliary
links out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolescape import schemas
from rolescape.functions import notices
from rolescape.functions.text import contains_any, first_filled, text
from rolescape.functions.urls import host, is_web

#: Elements that hold a link's context, classes of cards, and link words that are no title there.
AROUND = ("tr", "li", "article", "section", "div")
CARDS = frozenset(("vacancy-card", "job-card", "notice-card", "opening-card", "career-card"))
ADAPTIVE_GENERIC = ("click here", "details", "download", "advertisement", "view", "brief", "apply online")
HEADINGS = ("h1", "h2", "h3", "h4", "strong")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Bounds of markup inside scripts: characters of a script and of a fragment, and fragments of a page.
SCRIPT_CHARS, FRAGMENT_CHARS, FRAGMENTS = 5_000_000, 2_000_000, 50
#: Headings before a link that can name it, and characters of a context that can.
HEADINGS_BEFORE, TITLE_CHARS, LEAST_TITLE = 3, 300, 8


class Outline(HTMLParser):
    """Elements are numbered as they open, so what an element holds are the numbers up to where it closes."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        #: tag, first piece, piece after the last, element after the last
        self.tags: list[str] = []
        self.first: list[int] = []
        self.after: list[int] = []
        self.beyond: list[int] = []
        self.cards: set[int] = set()
        self.headings: list[int] = []
        self.scripts: dict[int, list[str]] = {}
        #: element, address, the open elements around it from the outside in
        self.links: list[tuple[int, str, tuple[int, ...]]] = []
        self.open: list[int] = []
        self.feed(markup)
        self.close()
        while self.open:
            self.shut(self.open.pop())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        me, said = len(self.tags), dict(attrs)
        self.tags.append(tag)
        self.first.append(len(self.pieces))
        self.after.append(len(self.pieces))
        self.beyond.append(me + 1)
        if CARDS.intersection((said.get("class") or "").casefold().split()):
            self.cards.add(me)
        if tag in HEADINGS:
            self.headings.append(me)
        if tag == "a" and "href" in said:
            self.links.append((me, (said["href"] or "").strip(), tuple(self.open)))
        if tag not in VOID:
            self.open.append(me)

    def handle_endtag(self, tag: str) -> None:
        if any(self.tags[e] == tag for e in self.open):
            while self.tags[self.open[-1]] != tag:
                self.shut(self.open.pop())
            self.shut(self.open.pop())

    def shut(self, element: int) -> None:
        self.after[element], self.beyond[element] = len(self.pieces), len(self.tags)

    def handle_data(self, data: str) -> None:
        inside = self.tags[self.open[-1]] if self.open else ""
        if inside == "script":
            self.scripts.setdefault(self.open[-1], []).append(data)
        elif inside != "style":
            self.pieces.append(data)

    def text(self, element: int) -> str:
        """All text in an element, pieces parted by one space; scripts and styles have none."""
        return " ".join(" ".join(self.pieces[self.first[element] : self.after[element]]).split())

    def held(self, element: int | None) -> dict[str, str] | None:
        """An element's text and its first heading's, or None."""
        if element is None:
            return None
        n = bisect_right(self.headings, element)
        inner = n < len(self.headings) and self.headings[n] < self.beyond[element]
        return {"text": self.text(element), "heading": self.text(self.headings[n]) if inner else ""}

    def rows(self) -> Iterator[tuple]:
        """href, words, card (the nearest row, item, article, section or card), block (the nearest element with text, rows
        first, blocks last) and the headings before the link, the nearest first."""
        for me, href, around in self.links:
            inward = around[::-1]
            card = next((e for e in inward if self.tags[e] in AROUND[:4] or e in self.cards), None)
            block = next((e for tag in AROUND for e in [next((x for x in inward if self.tags[x] == tag), None)] if e is not None and self.text(e)), None)
            n = bisect_right(self.headings, me)
            yield href, self.text(me), self.held(card), self.held(block), [self.text(h) for h in self.headings[max(0, n - HEADINGS_BEFORE) : n][::-1]]


def fragments(outline: Outline) -> list[str]:
    """Markup with links that scripts hold between backticks."""
    raw = ("".join(parts) for parts in outline.scripts.values())
    found = (x for s in raw if len(s) <= SCRIPT_CHARS for x in re.findall("`([^`]*)`", s))
    return [x for x in found if "<a" in x.casefold() and len(x) <= FRAGMENT_CHARS][:FRAGMENTS]


HELD = pa.struct([("text", pa.string()), ("heading", pa.string())])
ANCHORS = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("target", pa.string()), ("words", pa.string()), ("card", HELD), ("block", HELD), ("before", pa.list_(pa.string())), ("error", pa.string())])
ANCHORS_DDL = "part int, nth int, target string, words string, card struct<text:string,heading:string>, block struct<text:string,heading:string>, before array<string>, error string"


def page_anchors(url: str, markup: str, scripts: bool) -> list[tuple]:
    page = Outline(markup)
    parts = [page, *map(Outline, fragments(page))] if scripts else [page]
    return [(i, n, urljoin(url, href), *rest, "") for i, part in enumerate(parts) for n, (href, *rest) in enumerate(part.rows())]


def anchors(pages: DataFrame, key: str, url: str, markup: str, scripts: bool = True) -> DataFrame:
    """key, url, part, nth, target, words, card, block, before, error: every link of each page, and with `scripts` those of the
    markup in its scripts. A page that can't be read is one row with an error; a null page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.schema([batch.schema.field(0), batch.schema.field(1), *ANCHORS])
            for k, u, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    found = page_anchors(u or "", m or "", scripts)
                except Exception as e:  # one bad page must not end the batch
                    found = [(-1, -1, "", "", None, None, [], f"{type(e).__name__}: {e}"[:1000])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((k, u, *x) for x in found), strict=True), kinds, strict=True)], schema=kinds)

    kind = pages.schema[key].dataType.simpleString()
    named = pages.select(F.col(key).alias(key), F.col(url).cast("string").alias("url"), F.col(markup).cast("string").alias("markup"))
    return named.mapInArrow(run, f"{key} {kind}, url string, {ANCHORS_DDL}")


def spoken(adaptive: bool) -> tuple[Column, Column]:
    """A link's context and the heading in it: the card's if it says anything, else the block's, else the link's words."""
    words, card, block = F.col("words"), F.col("card"), F.col("block")
    said = F.nullif(card["text"], F.lit("")) if adaptive else F.lit(None).cast("string")
    heading = F.when(said.isNotNull(), card["heading"]).otherwise(block["heading"])
    return F.coalesce(said, block["text"], words), F.coalesce(heading, F.lit(""))


def title(adaptive: bool) -> Column:
    """What a notice is called, from the columns words, context, heading and before; empty if nothing says."""
    words, heading = F.col("words"), F.col("heading")
    rest = F.trim(F.left("context", F.lit(TITLE_CHARS)))
    long = F.length(words) >= LEAST_TITLE
    if adaptive:
        return F.when((heading != "") & contains_any(F.lower(words), ADAPTIVE_GENERIC), heading).when(long, words).otherwise(first_filled(heading, rest))
    named = F.get(F.filter("before", lambda h: contains_any(F.lower(h), notices.INCLUDE)), F.lit(0))
    return F.when(long & ~F.lower(words).isin(*notices.GENERIC), words).otherwise(F.coalesce(named, rest))


def links(pages: DataFrame, key: str, url: str, markup: str, domains: Sequence[str] = (), adaptive: bool = True, include: Sequence[str] = notices.INCLUDE, exclude: Sequence[str] = notices.EXCLUDE, follow_ups: bool = False, patterns: Sequence[str] = (), max_items: int | None = 100) -> DataFrame:
    """key, position, target, title, context, error of the notices of each landed listing, at most max_items of one.

    A notice leads to a web address on one of the domains, or without any on the listing's own host, and has an including and,
    unless follow-ups are wanted, no excluding term in its words or its context. Of several links to one address the first
    that counts stays. A page that can't be read gives one row with an error and no target; a null page gives none.
    """
    found = anchors(pages, key, url, markup, scripts=adaptive)
    context, heading = spoken(adaptive)
    rows = found.where("error = ''").withColumns({"context": context, "heading": heading})
    at, target = F.lower(host(F.col("target"))), F.col("target")
    around = F.lower(F.concat_ws(" ", "words", "context"))
    low = lambda terms: [t.lower() for t in terms]
    wanted = is_web(target) & (at.isin(*low(domains)) if domains else at == F.lower(host(F.col("url")))) & contains_any(around, low(include))
    if not follow_ups and exclude:
        wanted = wanted & ~contains_any(around, low(exclude))
    if patterns:
        wanted = wanted & contains_any(F.lower(target), patterns)
    if adaptive:
        wanted = wanted & ~notices.is_auxiliary(F.col("words"))
    rows = rows.where(wanted).withColumn("title", title(adaptive)).where("title <> ''")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "target").orderBy("part", "nth"))).where("_n = 1")
    placed = first.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("part", "nth")) - 1)
    if max_items is not None:
        placed = placed.where(F.col("position") < max_items)
    bad = found.where("error <> ''").select(key, F.lit(-1).alias("position"), "target", F.lit("").alias("title"), F.lit("").alias("context"), "error")
    return placed.select(key, "position", "target", "title", "context", "error").unionByName(bad)


def jobs(found: DataFrame, documents: DataFrame, source_name: str, company: str, country: str = "India", location: str = "India", sector: str = "") -> DataFrame:
    """Postings of notices (links()) with the text of their document (documents: target, body); a notice without one stays."""
    d = documents.select("target", F.col("body").alias("document")).groupBy("target").agg(F.min("document").alias("document"))
    df = found.where("error = ''").join(d, "target", "left")
    said = F.concat_ws("\n", F.nullif(text(F.col("context")), F.lit("")), F.nullif(text(F.col("document")), F.lit("")))
    what = F.lit("Public recruitment notice")
    named = {"title": F.col("title"), "company": F.lit(company), "country": F.lit(country), "location": F.lit(location), "sector": F.lit(sector), "source_name": F.lit(source_name), "apply_url": F.col("target"), "source_url": F.col("target"), "job_type": what, "employment_type": what}
    named |= {"description": F.concat(F.lit("Notice kind: "), notices.kind(F.concat_ws("\n", "title", said)), F.lit("\n"), said), "published_at": first_filled(notices.published(said), notices.posted(said)), "closing_at": notices.closing(said)}
    return schemas.conform(df.select(*[c.alias(n) for n, c in named.items()]), schemas.JOB)
