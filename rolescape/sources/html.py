"""HTML as text, links, titles, JSON-LD postings and addresses, on the standard library's parser.

Parsing markup has no native form; it runs in Arrow batches, one call for a batch of payloads.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that end a line, and tags whose content is no text.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("script style noscript template".split())
DROPPED = frozenset("nav header footer form".split())
#: Titles that tell nothing.
GENERIC_TITLES = frozenset(("career site", "careers", "job details", "jobs", "oracle careers"))


class Page(HTMLParser):
    """Collects visible text, links with their anchor text, the title, the first h1, meta contents and JSON-LD bodies."""

    def __init__(self, drop: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.drop, self.depth, self.hidden = drop, 0, 0
        self.parts: list[str] = []
        #: The text of the main element (or of the first one in that role), its tag, and how deep it is open.
        self.main: list[str] | None = None
        self.main_tag, self.main_open = "", 0
        self.links: list[tuple[str, str]] = []
        self.href: str | None = None
        self.anchor: list[str] = []
        self.open: list[str] = []
        self.found = {"title": [], "h1": []}
        self.metas: dict[str, str] = {}
        self.json_ld: list[str] = []
        self.ld: list[str] | None = None
        self.cloudflare: list[str] = []

    def add(self, piece: str) -> None:
        self.parts.append(piece)
        if self.main_open:
            self.main.append(piece)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if self.main_open and tag == self.main_tag:
            self.main_open += 1
        elif not self.depth and (self.main is None and a.get("role", "") == "main" or tag == "main" != self.main_tag):
            self.main, self.main_tag, self.main_open = [], tag, 1
        if tag == "script" and (a.get("type") or "").split(";")[0].strip().lower() == "application/ld+json":
            self.ld = []
        if "data-cfemail" in a:
            self.cloudflare.append(a["data-cfemail"])
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in self.drop:
            self.depth += 1
        elif tag == "a" and a.get("href"):
            self.close_link()
            self.href, self.anchor = a["href"], []
        elif tag == "meta" and a.get("content"):
            self.metas.setdefault((a.get("property") or a.get("name", "")).lower(), a["content"])
        if tag in self.found:
            self.open.append(tag)
        if tag in BLOCKS:
            self.add("\n")

    def close_link(self) -> None:
        if self.href is not None:
            self.links.append((self.href, " ".join("".join(self.anchor).split())))
        self.href = None

    def handle_endtag(self, tag: str) -> None:
        if self.main_open and tag == self.main_tag:
            self.main_open -= 1
        if tag == "script" and self.ld is not None:
            self.json_ld.append("".join(self.ld))
            self.ld = None
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.drop:
            self.depth = max(0, self.depth - 1)
        elif tag == "a":
            self.close_link()
        if tag in self.open:
            self.open.remove(tag)
        if tag in BLOCKS:
            self.add("\n")

    def handle_data(self, data: str) -> None:
        if self.ld is not None:
            self.ld.append(data)
        for tag in self.open:
            self.found[tag].append(data)
        if self.hidden or "title" in self.open:
            return
        if self.href is not None:
            self.anchor.append(data)
        if not self.depth:
            self.add(data)

    def lines(self, main: bool = False) -> str:
        rows = (" ".join(x.split()) for x in "".join(self.main if main and self.main is not None else self.parts).split("\n"))
        return "\n".join(x for x in rows if x)


def parse(markup: str | None, drop: frozenset[str] = frozenset()) -> Page:
    page = Page(drop)
    page.feed(markup or "")
    page.close()
    page.close_link()
    return page


def to_text(markup: str | None) -> str:
    """Visible text, a line for each block; entities resolved, also doubly escaped ones in plain text."""
    if not markup:
        return ""
    raw = html.unescape(markup) if "<" not in markup else markup
    return parse(raw).lines()


def html_text(markup: Column) -> Column:
    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(to_text)

    return convert(markup)


#: Characters of markup whose results are handed on together.
RESULT_CHARS = 4 << 20


def per_page(df: DataFrame, key: str, markup: str, fn, ddl: str, names: list[str]) -> DataFrame:
    """Rows that fn(page) yields for each document, behind its key; a page that can't be parsed yields none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size, own = [], 0, [batch.schema.field(key).type, *kinds]
            for k, m in zip(batch.column(key), batch.column(markup), strict=True):
                try:
                    out += [(k.as_py(), *row) for row in fn(m.as_py())]
                except Exception:  # one bad page must not end the others
                    continue
                size += len(m.as_py() or "")
                if size > RESULT_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), own, strict=True)] if out else [pa.array([], t) for t in own], [key, *names])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), own, strict=True)], [key, *names])

    kind = df.schema[key].dataType.simpleString()
    kinds = [pa.int32() if part.split()[1] == "int" else pa.string() for part in ddl.split(", ")]
    return df.select(key, markup).mapInArrow(run, f"{key} {kind}, {ddl}")


def links(df: DataFrame, key: str, markup: str) -> DataFrame:
    """key, position, href, anchor of every link."""
    return per_page(df, key, markup, lambda m: [(i, h, t) for i, (h, t) in enumerate(parse(m).links)], "position int, href string, anchor string", ["position", "href", "anchor"])


def titles(df: DataFrame, key: str, markup: str) -> DataFrame:
    """key, title: the first heading, else the social title, else the title tag, without a career site's ending; a generic one is empty."""

    def one(m: str | None) -> list[tuple[str]]:
        p = parse(m)
        h1, t = (" ".join("".join(p.found[x]).split()) for x in ("h1", "title"))
        social = (" ".join(p.metas.get(x, "").split()) for x in ("og:title", "twitter:title"))
        found = re.sub(r"(?i)\s+(?:job details|careers|career site).*$", "", next(filter(None, (h1, *social, t)), "")).strip()
        return [("" if found.lower() in GENERIC_TITLES else found,)]

    return per_page(df, key, markup, one, "title string", ["title"])


def body_text(df: DataFrame, key: str, markup: str) -> DataFrame:
    """key, body: visible text of the main element, or of a page without one, without navigation, header, footer and forms."""
    return per_page(df, key, markup, lambda m: [(parse(m, DROPPED).lines(main=True),)], "body string", ["body"])


def flatten(value: Any) -> Iterator[dict[str, Any]]:
    """All objects of a JSON-LD document, lists and @graph opened, what a graph holds before the object around it."""
    todo = [(value, False)]
    while todo:
        x, opened = todo.pop()
        if isinstance(x, list):
            todo += [(y, False) for y in reversed(x)]
        elif isinstance(x, dict):
            if opened or not isinstance(x.get("@graph"), list):
                yield x
            else:
                todo += [(x, True), (x["@graph"], False)]


def said(value: Any, separator: str = "; ") -> str:
    """A JSON value as text: lists joined, nothing as empty."""
    if isinstance(value, list):
        return separator.join(x for x in (said(v) for v in value) if x)
    return "" if value is None or isinstance(value, dict) else str(value).strip()


def address(value: Any) -> str:
    at = value.get("address", value) if isinstance(value, dict) else value
    if not isinstance(at, dict):
        return said(at)
    return ", ".join(x for x in (said(at.get(k)) for k in ("addressLocality", "addressRegion", "postalCode", "addressCountry")) if x)


def pay(value: Any) -> str:
    if not isinstance(value, dict):
        return ""
    amount = value.get("value")
    low, high, unit = (amount.get("minValue", amount.get("value")), amount.get("maxValue"), said(amount.get("unitText"))) if isinstance(amount, dict) else (amount, None, "")
    figures = "–".join(str(x) for x in (low, high) if x is not None)
    return " ".join(x for x in (said(value.get("currency")), figures, f"per {unit}" if unit else "") if x) if figures else ""


def postings(df: DataFrame, key: str, markup: str, company: str = "") -> DataFrame:
    """JobPosting objects in a page's JSON-LD: key and title, company, location, description, url, dates and texts.

    A posting without an organization's name gets the given company; a script that is no JSON, or nested too deep, has none.
    """
    names = ["title", "company", "location", "description", "apply_url", "published_at", "closing_at", "job_type", "salary_text", "experience_text", "skills_text"]

    def found(m: str | None) -> Iterator[tuple]:
        for raw in parse(m).json_ld:
            try:
                document = json.loads(raw)
            except (ValueError, RecursionError):
                continue
            for x in flatten(document):
                kinds = x.get("@type")
                if "jobposting" not in [str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])] or not said(x.get("title")):
                    continue
                org, places = x.get("hiringOrganization"), x.get("jobLocation")
                where = [address(p) for p in (places if isinstance(places, list) else [places])] + (["Remote"] if said(x.get("jobLocationType")).upper() == "TELECOMMUTE" else [])
                yield said(x["title"]), (said(org.get("name")) if isinstance(org, dict) else said(org)) or company, " / ".join(w for w in where if w), to_text(said(x.get("description"))), said(x.get("url")), said(x.get("datePosted")), said(x.get("validThrough")), said(x.get("employmentType")), pay(x.get("baseSalary")), to_text(said(x.get("experienceRequirements"))), to_text(said(x.get("skills")))

    return per_page(df, key, markup, found, ", ".join(f"{n} string" for n in names), names)


def contact_candidates(df: DataFrame, key: str, markup: str) -> DataFrame:
    """key, raw, method, context of addresses in mailto links, Cloudflare codes, text and spelled-out text, in that order."""
    from rolescape.functions.emails import EMAIL, OBFUSCATED

    def found(m: str | None) -> Iterator[tuple[str, str, str]]:
        page = parse(m)
        visible = " ".join(page.lines().split())
        for href, anchor in page.links:
            if href.lower().startswith("mailto:"):
                for raw in re.split("[,;]", href[7:].split("?", 1)[0]):
                    yield raw, "mailto", anchor[:400]
        for code in page.cloudflare:
            if re.fullmatch("([0-9a-fA-F]{2}){2,}", code):
                data = bytes.fromhex(code)
                yield "".join(chr(b ^ data[0]) for b in data[1:]), "cloudflare_obfuscation", ""
        for x in re.finditer(EMAIL, m or ""):
            yield x[0], "plaintext", visible[max(0, visible.find(x[0]) - 160) :][:400]
        for x in re.finditer(OBFUSCATED, visible):
            yield f"{x[1]}@{x[2]}.{x[3]}", "text_obfuscation", visible[max(0, x.start() - 160) : x.end() + 160][:400]

    return per_page(df, key, markup, found, "raw string, method string, context string", ["raw", "method", "context"])
