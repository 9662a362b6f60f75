"""Pages: titles, content and links, as expressions and with a parser."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import urls
from .text import clean

# Elements that hold no content.
NOISE = ("script", "style", "nav", "footer", "header", "noscript")
# Where each site keeps its content.
SELECTORS = {
    "pubmed.ncbi.nlm.nih.gov": ("main", "article", "section.abstract", "div.abstract-content"),
    "medlineplus.gov": ("main", "article", "#topic-summary", "body"),
    "who.int": ("main", "article", "div.sf_colsIn", "body"),
    "nih.gov": ("main", "article", "div.article-content", "body"),
    "scielo.org": ("main", "article", "#articleText", "body"),
}
# Where other sites keep it, and the length beyond which a selector's content ends the search.
DEFAULT_SELECTORS = ("main", "article", "body")
ENOUGH = 120
REFERENCES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _decoded(text: Column) -> Column:
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _text(html: Column) -> Column:
    return clean(_decoded(F.regexp_replace(html, "<[^>]+>", " ")))


def only_listed(html: Column) -> Column:
    """Html whose other ampersands are text to a parser, too: it decodes ``REFERENCES`` alone, with their
    semicolons, where it would also take ``&amp`` and all other names."""
    names = "|".join(name[1:] for name, _ in REFERENCES)
    return F.regexp_replace(html, f"&(?!{names})", "&amp;")


def without_noise(html: Column) -> Column:
    t = F.coalesce(html, F.lit(""))
    for tag in NOISE:
        t = F.regexp_replace(t, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", " ")
    return F.regexp_replace(t, r"(?s)<!--.*?-->", " ")


def title(html: Column) -> Column:
    return _text(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def first_of(html: Column, tags: Sequence[str] = DEFAULT_SELECTORS, enough: int | None = ENOUGH) -> Column:
    """Text of the first of the elements that is long enough, else of the last that there is; with
    ``enough`` None simply of the first that there is."""
    bare = without_noise(html)
    found = {t: F.regexp_extract(bare, rf"(?is)<{t}(?:\s[^>]*)?>(.*?)(?:</{t}\s*>|\z)", 1) for t in tags}
    there = {t: F.rlike(bare, F.lit(rf"(?is)<{t}(\s[^>]*)?>")) for t in tags}
    if enough is None:
        out = F.lit("")
        for t in reversed(tags):
            out = F.when(there[t], _text(found[t])).otherwise(out)
        return out
    out = F.lit("")
    for t in tags:
        out = F.when(there[t], _text(found[t])).otherwise(out)
    for t in reversed(tags):
        out = F.when(there[t] & (F.length(_text(found[t])) > enough), _text(found[t])).otherwise(out)
    return out


def hrefs(html: Column) -> Column:
    """Distinct trimmed hrefs of links, character references decoded, empty ones dropped."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(_decoded(x))), lambda x: x != ""))


def links(url: Column, html: Column) -> Column:
    """Distinct http links of a page, of any form (absolute, //host, /path, path, ../path, ?query),
    resolved against its url, without fragments."""
    full = F.transform(hrefs(html), lambda h: urls.join(url, h))
    return F.array_distinct(F.filter(full, lambda x: F.rlike(x, F.lit("(?i)^https?://"))))


def _parse(html: str, selectors: Sequence[str]) -> tuple[str, str]:
    from html.parser import HTMLParser

    void = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}

    class Parser(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.open: list[tuple[str, set[str]]] = []
            self.noise, self.title, self.in_title, self.seen_title = 0, [], False, False
            self.texts: dict[str, list[str]] = {}
            self.done: set[str] = set()

        def handle_starttag(self, tag, attrs):
            if tag in void:
                return
            a = dict(attrs)
            names = {tag, "#" + (a.get("id") or "")} | {f"{tag}.{c}" for c in (a.get("class") or "").split()}
            self.noise += tag in NOISE
            hit = {s for s in selectors if s in names and s not in self.texts} if not self.noise else set()
            for s in hit:
                self.texts[s] = []
            self.open.append((tag, hit))
            if tag == "title" and not self.seen_title and not self.noise:
                self.in_title = self.seen_title = True

        def handle_endtag(self, tag):
            if tag not in {t for t, _ in self.open}:
                return
            while self.open:
                t, hit = self.open.pop()
                self.done |= hit
                self.noise -= t in NOISE
                if t == "title":
                    self.in_title = False
                if t == tag:
                    break

        def handle_data(self, data):
            if self.noise:
                return
            if self.in_title:
                self.title.append(data)
            for s, parts in self.texts.items():
                if s not in self.done:
                    parts.append(data)

    p = Parser()
    p.feed(html)
    p.close()
    content = ""
    for s in selectors:
        if s in p.texts:
            content = " ".join(" ".join(p.texts[s]).split())
            if len(content) > ENOUGH:
                break
    return " ".join(" ".join(p.title).split()), content


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("content", StringType())]))
def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(title, content) of html by the selectors of a domain, with a real parser."""
    for htmls, domains in batches:
        yield pd.DataFrame([_parse(h or "", SELECTORS.get(d, DEFAULT_SELECTORS)) for h, d in zip(htmls, domains)], columns=["title", "content"])
