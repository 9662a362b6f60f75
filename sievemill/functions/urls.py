"""Urls as column expressions, and the policies of fetching as plain functions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def _parts(url: Column) -> tuple[Column, Column, Column, Column]:
    u = F.trim(F.coalesce(url, F.lit("")))

    def part(pattern: str) -> Column:
        return F.regexp_extract(u, pattern, 1)

    rest = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"
    return F.lower(part(r"^([a-zA-Z][a-zA-Z0-9+.-]*):")), F.lower(part(rest + "//([^/?#]*)")), part(rest + r"(?://[^/?#]*)?([^?#]*)"), part(r"^[^?#]*(\?[^#]*)")


def normalize(url: Column, empty_path: str = "/") -> Column:
    """Scheme and host in lower case; no parameters, fragment or trailing slash; the query stays.
    A path that is empty, or a slash only, becomes ``empty_path``; null or '' is ''."""
    scheme, host, path, query = _parts(url)
    path = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), "/+$", "")
    path = F.when(path == "", F.lit("/") if empty_path else F.when(_parts(url)[2] == "/", "/").otherwise("")).otherwise(path)
    query = F.when(query == "?", "").otherwise(query)
    out = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path, query)
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").otherwise(out)


def _dots(path: Column) -> Column:
    """A path without '.' and '..' segments, as a url has it."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(held: Column, part: Column) -> Column:
        up = F.when(F.size(held) > 1, F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(held)
        return F.when(part == "..", up).when(part == ".", held).otherwise(F.concat(held, F.array(part)))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))), F.array(F.lit("")), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.contains(path, F.lit("/.")), F.array_join(kept, "/")).otherwise(path)


def join(base: Column, href: Column) -> Column:
    """The address of ``href`` on the page ``base``, without its fragment; other schemes stay as they are."""
    b, h = F.trim(F.coalesce(base, F.lit(""))), F.regexp_replace(F.trim(F.coalesce(href, F.lit(""))), "#.*$", "")
    scheme, site = F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path, query = F.regexp_extract(b, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(b, r"(\?[^#]*)", 1)
    own, rest = F.regexp_extract(h, r"^([^?]*)", 1), F.regexp_extract(h, r"^[^?]*(\?.*)?$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1))
    return (
        F.when(F.rlike(h, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme, h))
        .when(h == "", F.concat(site, path, query))
        .when(own == "", F.concat(site, path, rest))
        .when(F.startswith(own, F.lit("/")), F.concat(site, _dots(own), rest))
        .otherwise(F.concat(site, _dots(F.concat(folder, own)), rest))
    )


def is_http(url: Column) -> Column:
    return F.coalesce(F.rlike(F.trim(url), F.lit(r"(?i)^https?://[^/?#]+")), F.lit(False))


def is_valid(url: Column) -> Column:
    """Any scheme, with a host."""
    return F.coalesce(F.rlike(F.trim(url), F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+")), F.lit(False))


def host(url: Column) -> Column:
    """The host in lower case, without user or port."""
    return F.regexp_replace(F.regexp_replace(_parts(url)[1], "^.*@", ""), r":\d*$", "")


def in_domain(url: Column, domain: Column) -> Column:
    """The host is the domain or one below it."""
    d = F.lower(domain)
    return (host(url) == d) | F.endswith(host(url), F.concat(F.lit("."), d))


def is_allowed(url: Column, domains: Column) -> Column:
    """in_domain for any of an array."""
    return F.exists(domains, lambda d: in_domain(url, d))


def related(url: Column, base: Column) -> Column:
    """One host equals the other or is below it, in either direction."""
    a, b = host(url), host(base)
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def quote_plus(text: Column) -> Column:
    """Form encoding, with '~' kept and '*' encoded."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


# Search addresses that a query's own crawl begins with.
SEARCHES = ("https://pubmed.ncbi.nlm.nih.gov/?term=", "https://search.scielo.org/?q=")


def seeds(query: Column, searches: Sequence[str] = SEARCHES) -> Column:
    """Addresses of a query in each search, as an array."""
    q = quote_plus(F.lower(query))
    return F.array(*[F.concat(F.lit(s), q) for s in searches])


@F.pandas_udf(StringType())
def resolve(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """urljoin(base, href) without its fragment, for any form of href."""
    from urllib.parse import urldefrag, urljoin

    def one(base: str | None, href: str | None) -> str | None:
        try:
            return urldefrag(urljoin(base or "", (href or "").strip()))[0]
        except ValueError:
            return None

    for bases, hrefs in parts:
        yield pd.Series([one(b, h) for b, h in zip(bases, hrefs)])


def should_retry(status: int | None, attempt: int, most: int = 3) -> bool:
    """Timeouts (no status) and server errors are tried again; other failures are final."""
    return attempt < most and (status is None or 500 <= status < 600)


def backoff(attempt: int, base: float = 1.8) -> float:
    return base**attempt


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("text/html")), F.lit(False))


#: Parsed rules that a task remembers.
ROBOTS_KEPT = 1000


def robots_allowed(pages: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """pages (url, ...) with ``allowed`` by the robots.txt of the url's host; rules: (host, robots), a
    row a host, and a host without one allows all.  Rules come to the pages by a join, and a task
    parses each text once."""

    @F.pandas_udf(BooleanType())
    def allow(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from functools import lru_cache
        from urllib.robotparser import RobotFileParser

        @lru_cache(ROBOTS_KEPT)
        def parsed(text: str) -> RobotFileParser:
            p = RobotFileParser()
            p.parse(text.splitlines())
            return p

        for found, texts in batches:
            yield pd.Series([t is None or parsed(t).can_fetch(agent, u or "") for u, t in zip(found, texts)])

    netloc = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    keyed = rules.select(F.lower("host").alias("robots_host"), "robots").dropDuplicates(["robots_host"])
    out = pages.withColumn("robots_host", netloc).join(keyed, "robots_host", "left")
    return out.withColumn("allowed", allow("url", "robots")).drop("robots_host", "robots")
