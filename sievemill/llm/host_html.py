"""Main text of pages by suffix arrays over hosts (operator 6).

A page becomes blocks of text with the zone each stands in: what markup calls an article, the rest,
or what it calls something else (menus, headers, footers, asides, forms, adverts, notices, reader
comments; scripts and styles give no text).  The token streams of a host's pages are concatenated,
and a suffix array over them finds what is repeated on distinct pages.  Substrings of ``LONG`` tokens
and more count; they cover just the tokens that their repeated runs of ``LONG`` tokens cover, so the
array is sorted (by prefix doubling) so far and no further; a page has a run if a token of it may be
main text there.  A page without an article loses the blocks that lie wholly in runs that several pages
have outside articles, which may reach over blocks, and of others what a
repeated run inside the block covers; its unique runs stay.  Inside an article, repetition on a few
pages is not evidence against text (copies and quotations are main text too), but blocks that lie
wholly in runs on more than half of the host's pages are its template and go, unless they are half of
the article's words: then it is a copy.  Where a class or id only hints that a block is something
else, repetition on two pages is enough.

A host of many pages has several arrays of about ``SHARD_BYTES``, and what they find is put together:
each array tells the runs that can decide something (all that reach outside articles, and those on
more than ``TELLING`` of its pages) with their numbers of pages, these are added up over the host, and
each array then covers by the host's numbers; an array with nothing to tell is done at once.  So a text
does not depend on how a host was split.

Cases: null or empty html gives empty text; a url without a host belongs to the host ''; a very long
page is parsed whole, and may fill an array alone; repeated rows (and ties) give equal rows, and copies
of a page under one id are one page to the suffix array; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import persist

LONG = 8
SHARD_BYTES = 2 << 20
#: Hosts are sized by buckets of their hashes, so that the sizes to broadcast have a fixed number; a
#: host in a full bucket gets more arrays than it needs, which does not change its texts.
HOST_BUCKETS = 1 << 20
#: A run on more than half of a host's pages, and on so many at least, is its template.
TEMPLATE_PAGES = 5
#: A run on more than half of a host's pages is on more than this share of each array's: pages are
#: dealt by hash.
TELLING = 1 / 8
OUTPUT = "page_id {}, url string, text string, n_chars long"

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_OTHER = frozenset("nav footer aside form button select iframe svg canvas object noscript template head menu dialog audio video map".split())
_RAW = frozenset("script style textarea title xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo related replies reply share sharing sidebar social sponsor sponsored subscribe widget".split())
_ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Words of _NAMES that wrappers of main text have, too.
_VAGUE = frozenset("notice notices related replies reply share sharing social widget".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_ARTICLES = re.compile(r"<(?:article|main)\b", re.I)
#: DOUBTED: in an article, in an element whose name only hints at something else.
ARTICLE, REST, OTHER, DOUBTED = 0, 1, 2, 3


def _says_other(name: str, attributes: str) -> int:
    """2 if a role or a whole class or id says that an element isn't main text, 1 if a word of one
    hints at it, which repetition has to confirm; the id of a heading is made of its own words."""
    found = 0
    for kind, *values in _ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), "".join(values).lower()
        if kind == "id" and name in _HEADINGS:
            continue
        for whole in value.split():
            if whole in (_ROLES if kind == "role" else _NAMES - _VAGUE):
                return 2
            if kind != "role" and not _NAMES.isdisjoint(re.split(r"[^a-z]+", whole)):
                found = 1
    return found


def blocks_of(html: str) -> list[tuple[str, int]]:
    """(text, zone) of a page's blocks in page order, white space made single spaces."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    inside, skipped, depth, at, zone = 0, "", 0, 0, REST
    named, doubted, doubts = False, "", 0  # whether a class or id began the skip; a doubted element
    single = len(_ARTICLES.findall(html)) == 1

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((text, zone))
            held.clear()

    def now() -> int:
        return OTHER if skipped else REST if not inside else DOUBTED if doubted else ARTICLE

    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in _RAW and not closing:
            end = re.compile(rf"</{name}\s*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in _BLOCKS or name in _OTHER:
            flush()
        main = not closing and (name == "main" or (name == "div" and attributes and _MAIN.search(attributes) is not None))
        if skipped and (named or skipped == "form") and (main or (name == "article" and not closing and single)):
            flush()  # it was a wrapper of the main text
            skipped = ""
        if skipped:
            if name == skipped and name not in _VOID:
                depth += -1 if closing else 1
            elif (skipped == "p" and name in _BLOCKS) or (closing and name in ("article", "main", "body")):
                depth = 0
            if depth <= 0:
                flush()
                skipped = ""
            if skipped or (closing and name not in ("article", "main")):
                zone = now()
                continue
        if doubted and (name in ("article", "main") or main):
            flush()
            doubted = ""
        elif doubted == name:
            doubts += -1 if closing else 1
            if doubts <= 0:
                flush()
                doubted = ""
        if closing:
            if name in ("article", "main"):
                flush()
                inside = max(0, inside - 1)
        elif name not in _VOID:
            if name in ("article", "main"):
                flush()
                inside += 1
            elif main:
                if not inside:
                    flush()
                    inside += 1
            else:
                says = _says_other(name, attributes) if attributes and name not in ("html", "body") else 0
                if name in _OTHER or (name == "header" and not inside) or says == 2:
                    flush()
                    skipped, depth, named = name, 1, name not in _OTHER and name != "header"
                elif says and not doubted:
                    flush()
                    doubted, doubts = name, 1
        zone = now()
    flush()
    return out


def run_pages(tokens: np.ndarray, page: np.ndarray, masks: tuple[np.ndarray, ...] = (), long: int = LONG) -> list[np.ndarray]:
    """On how many distinct pages the run of ``long`` tokens that begins at each token is: in all, and
    for each mask where it has a token of the mask; 0 where the page ends first.

    tokens: numbers of all pages' tokens one after the other; page: the page of each, ascending.
    Ranks of the suffixes' first 1, 2, 4, ... tokens order the array.
    """
    n = len(tokens)
    out = [np.zeros(n, np.int64) for _ in range(len(masks) + 1)]
    if n < long:
        return out
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    last = np.searchsorted(page, page, side="right")  # where its page ends
    size = 1
    while size < long:
        step = min(size, long - size)
        ahead = np.arange(n) + step
        following = np.where(ahead + size <= last, rank[np.minimum(ahead, n - 1)], 0)
        _, rank = np.unique(rank * (n + 1) + following, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        size += step
    starts = np.flatnonzero(np.arange(n) + long <= last)
    if not len(starts):
        return out
    order = starts[np.argsort(rank[starts], kind="stable")]  # the suffix array, as far as runs go
    group, own = rank[order], page[order]  # a group's pages ascend
    begins = np.append(True, group[1:] != group[:-1])
    begin = np.flatnonzero(begins)
    sizes = np.diff(np.append(begin, len(order)))
    place = np.flatnonzero(begins | np.append(True, own[1:] != own[:-1]))  # the first of each page in each group
    for k in range(len(out)):
        here = np.ones(len(order), bool)
        if k:
            there = np.append(0, np.cumsum(masks[k - 1]))
            here = there[order + long] > there[order]
        found = np.zeros(len(order), np.int64)
        found[place] = np.logical_or.reduceat(here, place)
        out[k][order] = np.repeat(np.add.reduceat(found, begin), sizes)
    return out


def cover(starts: np.ndarray, long: int = LONG) -> np.ndarray:
    """Which tokens the runs with the marked starts cover."""
    edge = np.zeros(len(starts) + long, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + long] -= 1
    return np.cumsum(edge)[: len(starts)] > 0


def repeated(tokens: np.ndarray, page: np.ndarray, long: int = LONG) -> np.ndarray:
    """Which tokens are covered by a run of ``long`` tokens that distinct pages have."""
    return cover(run_pages(tokens, page, (), long)[0] > 1, long)


class Streams(NamedTuple):
    """The token streams of some pages of a host, one after the other."""

    pages: list[list[tuple[str, int]]]  # blocks and zones of each row
    where: list[tuple[int, int, int]]  # (row, block, tokens) of each block
    order: np.ndarray  # places of the tokens, page by page (rows of one id are one page)
    tokens: np.ndarray  # in that order, like the rest
    page: np.ndarray
    block: np.ndarray
    counted: np.ndarray  # whether a token may be main text
    loose: np.ndarray  # whether it may be, outside articles or in a doubted block
    words: np.ndarray  # a hash of each number's word
    n: int  # distinct pages


def streams(ids: list, htmls: list[str | None]) -> Streams:
    from xxhash import xxh64_intdigest

    pages = [blocks_of(h or "") for h in htmls]
    number: dict[str, int] = {}
    numbers: dict[object, int] = {}
    tokens, page, where = [], [], []
    for k, blocks in enumerate(pages):
        own = numbers.setdefault((ids[k],) if ids[k] is not None else k, len(numbers))
        for b, (text, _) in enumerate(blocks):
            words = text.split(" ")
            tokens += [number.setdefault(w, len(number)) for w in words]
            page += [own] * len(words)
            where.append((k, b, len(words)))
    token, own = np.array(tokens, dtype=np.int64), np.array(page, dtype=np.int64)
    order = np.argsort(own, kind="stable")
    block = np.repeat(np.arange(len(where)), [size for _, _, size in where])[order]
    hashes = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in number], dtype=np.uint64)
    zone = np.array([pages[k][b][1] for k, b, _ in where], dtype=np.int64)[block] if len(block) else np.zeros(0, np.int64)
    return Streams(pages, where, order, token[order], own[order], block, zone != OTHER, (zone == REST) | (zone == DOUBTED), hashes, len(numbers))


def _has_article(blocks: list[tuple[str, int]]) -> bool:
    return any(zone in (ARTICLE, DOUBTED) for _, zone in blocks)


def run_hashes(s: Streams, long: int = LONG) -> np.ndarray:
    """A hash of the run that begins at each token, as a signed number."""
    h = s.words[s.tokens] if len(s.tokens) else np.zeros(0, np.uint64)
    out = np.zeros(len(h), np.uint64)
    for k in range(min(long, len(h))):
        out[: len(h) - k] = out[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def told_runs(s: Streams, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct runs that an array tells its host's others, and the pages that have them
    in what may be main text, and in what of it is loose."""
    _, text, loose = counts
    tell = (loose > 0) | (text > TELLING * s.n)
    hashes, first = np.unique(run_hashes(s)[tell], return_index=True)
    return hashes, text[tell][first], loose[tell][first]


Known = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def main_texts(ids: list, htmls: list[str | None], known: Known | None = None) -> list[str]:
    """The main texts of one host's pages, or of some of them: then ``known`` has the runs that its
    arrays told (hashes, ascending, and the pages that have them), and the host's pages."""
    s = streams(ids, htmls)
    return _texts(s, run_pages(s.tokens, s.page, (s.counted, s.loose)), known)


def _texts(s: Streams, counts: list[np.ndarray], known: Known | None = None) -> list[str]:
    every, text, loose = counts
    n = s.n
    if known is not None:
        hashes, in_text, in_loose, n = known
        if len(hashes):
            own = run_hashes(s)
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            found = (hashes[at] == own) & (every > 0)
            text, loose = np.where(found, in_text[at], text), np.where(found, in_loose[at], loose)
    change = np.append(0, s.block[1:] != s.block[:-1]) if len(s.block) else s.block
    unit = np.cumsum(change)
    inside = np.arange(len(loose)) + LONG <= np.searchsorted(unit, unit, side="right")
    covered, shared, template = (np.empty(len(loose), dtype=bool) for _ in range(3))
    covered[s.order] = cover((loose > 1) & inside)
    shared[s.order] = cover(loose > 1)
    template[s.order] = cover(text >= max(TEMPLATE_PAGES, n // 2 + 1))
    kept: list[list[str]] = [[] for _ in s.pages]
    articles: list[list[tuple[str, int, bool]]] = [[] for _ in s.pages]
    at = 0
    has_article = [_has_article(blocks) for blocks in s.pages]
    for k, b, size in s.where:
        text, zone = s.pages[k][b]
        if has_article[k]:
            if zone == ARTICLE or (zone == DOUBTED and not shared[at : at + size].all()):
                articles[k].append((text, size, bool(template[at : at + size].all())))
        elif zone == REST and not shared[at : at + size].all():
            unique = ~covered[at : at + size]
            if unique.all():
                kept[k].append(text)
            elif unique.any():
                kept[k].append(" ".join(w for w, u in zip(text.split(" "), unique.tolist()) if u))
        at += size
    for k, blocks in enumerate(articles):
        copy = 2 * sum(size for _, size, own in blocks if own) >= sum(size for _, size, _ in blocks)
        kept[k] += [text for text, _, own in blocks if copy or not own]
    return ["\n".join(x) for x in kept]


def _unpacked(table: pa.Table) -> tuple[list, list]:
    return table["page_id"].to_pylist(), [None if h is None else zlib.decompress(h).decode() for h in table["packed"].to_pylist()]


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("page_id", "ascending"), ("url", "ascending"), ("packed", "ascending")])


def _rows(table: pa.Table, texts: list[str]) -> dict[str, object]:
    return {"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}


def _host(key: tuple, table: pa.Table) -> pa.Table:
    table = _sorted(table)
    return pa.table(_rows(table, main_texts(*_unpacked(table))))


def _first(key: tuple, table: pa.Table) -> pa.Table:
    """An array that has nothing to tell needs nothing from the others: its texts.  Any other: the runs
    that it tells, after a row with the number of its pages."""
    table = _sorted(table)
    s = streams(*_unpacked(table))
    counts = run_pages(s.tokens, s.page, (s.counted, s.loose))
    hashes, text, loose = told_runs(s, counts)
    place = {"host": key[0].as_py(), "shard": key[1].as_py()}
    if not len(hashes):
        out = _rows(table, _texts(s, counts))
        rows = table.num_rows
        rest = {"run": pa.nulls(rows, pa.int64()), "pages": np.full(rows, s.n, np.int32), "loose": pa.nulls(rows, pa.int32())}
    else:
        rows = len(hashes) + 1
        out = {"page_id": pa.nulls(rows, table["page_id"].type), "url": pa.nulls(rows, pa.string()), "text": pa.nulls(rows, pa.string()), "n_chars": pa.nulls(rows, pa.int64())}
        rest = {"run": pa.array([None, *hashes.tolist()], pa.int64()), "pages": np.append(s.n, text).astype(np.int32), "loose": np.append(0, loose).astype(np.int32)}
    return pa.table({k: np.full(rows, v, np.int64) for k, v in place.items()} | out | rest)


def _informed(key: tuple, table: pa.Table, runs: pa.Table) -> pa.Table:
    table, runs = _sorted(table), runs.sort_by([("run", "ascending")])
    told = runs.filter(runs["run"].is_valid())
    n = runs.filter(runs["run"].is_null())["pages"].to_pylist()
    known = (*(told[c].to_numpy().astype(np.int64) for c in ("run", "pages", "loose")), n[0] if n else 0)
    return pa.table(_rows(table, main_texts(*_unpacked(table), known)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = [None if h is None else zlib.compress(h.encode(), 1) for h in batch.column(2).to_pylist()]
        yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "packed": pa.array(html, pa.binary()), "host": batch.column(3), "shards": batch.column(4), "shard": batch.column(5)})


def extract(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    own = pages.select("page_id", "url", "html").withColumn("host", host)
    own = own.withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(HOST_BUCKETS)))
    sizes = own.groupBy("bucket").agg(F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) / shard_bytes).alias("shards"))
    sizes = persist(sizes, "host-sizes")
    digest = F.when(F.col("page_id").isNull(), F.xxhash64("url", "html")).otherwise(F.xxhash64("page_id"))
    shards = F.greatest("shards", F.lit(1)).cast("long")
    dealt = own.join(F.broadcast(sizes), "bucket").select("page_id", "url", "html", "host", shards.alias("shards"), F.pmod(digest, shards).alias("shard"))
    kind = pages.schema["page_id"].dataType.simpleString()
    packed = dealt.mapInArrow(_pack, f"page_id {kind}, url string, packed binary, host string, shards long, shard long")
    output, columns = OUTPUT.format(kind), ["page_id", "url", "text", "n_chars"]
    whole = packed.filter("shards = 1").select("host", "page_id", "url", "packed").groupBy("host").applyInArrow(_host, output)
    if sizes.filter("shards > 1").isEmpty():
        return whole
    split = packed.filter("shards > 1").select(F.xxhash64("host").alias("host"), "shard", "page_id", "url", "packed")
    first = persist(split.groupBy("host", "shard").applyInArrow(_first, f"host long, shard long, {output}, run long, pages int, loose int"), "arrays")
    out = whole.unionByName(first.filter("text IS NOT NULL").select(columns))
    told = first.filter("text IS NULL").select("host", "shard", "run", "pages", "loose")
    if told.isEmpty():
        return out
    # the pages of arrays that had nothing to tell count, too: one row of each says how many they are
    quiet = first.filter("text IS NOT NULL").groupBy("host", "shard").agg(F.max("pages").alias("pages")).groupBy("host").agg(F.sum("pages").alias("quiet"))
    added = told.groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.sum("loose").alias("loose"), F.collect_list("shard").alias("shards")).filter("run IS NULL OR pages > 1")
    added = added.join(quiet, "host", "left").withColumn("pages", F.col("pages") + F.when(F.col("run").isNull(), F.coalesce("quiet", F.lit(0))).otherwise(0))
    added = added.select("host", F.explode("shards").alias("shard"), "run", "pages", "loose")
    again = split.join(told.filter("run IS NULL").select("host", "shard"), ["host", "shard"], "left_semi")
    return out.unionByName(again.groupBy("host", "shard").cogroup(added.groupBy("host", "shard")).applyInArrow(_informed, output))
