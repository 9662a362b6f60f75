"""Fetching policy and the way from pages to a corpus."""

import pytest
from pyspark.sql import functions as F

from sievemill.operators import build, retrieve, vector
from sievemill.schema import SEED
from sievemill.sources import web


@pytest.mark.parametrize("answers,want", [
    ([(200, "text/html; charset=utf-8", "x")], (200, "x", None, 1)),
    ([None, (503, "", ""), (200, "text/html", "y")], (200, "y", None, 3)),
    ([None, None, None], (None, None, "fetch_failed", 3)),
    ([(404, "text/html", "")], (404, None, "fetch_failed", 1)),
    ([(200, "application/pdf", "z")], (200, None, "non_html_content_type", 1)),
])
def test_fetch_policy(answers, want):
    left, pauses = iter(answers), []
    assert web.fetch_one("u", lambda _: next(left), sleep=pauses.append) == want
    assert pauses == [1.8, 1.8**2][: want[3] - 1]


def test_fetch_on_executors(spark):
    got = web.fetch(spark.createDataFrame([("a",), ("b",)], "url string"), lambda u: (200, "text/html", u * 2) if u == "a" else None, base=0.0, delay=0.0).orderBy("url").collect()
    assert [(r.html, r.reason, r.attempts) for r in got] == [("aa", None, 1), (None, "fetch_failed", 3)]


def _page(body, *links):
    return f"<html><head><title>T</title></head><body><article>{body}</article>" + "".join(f'<a href="{x}">l</a>' for x in links) + "</body></html>"


def test_build_corpus_and_expand(spark):
    text = "heart disease and treatment of the patient " * 20
    pages = spark.createDataFrame([
        ("http://h.org/", _page(text + "one", "/a", "/b", "/c", "http://other.org/x")), ("http://h.org/a", _page(text + "ONE!")), ("http://h.org/b", _page("short")),
        ("http://h.org/c", _page(text + "three")), ("http://other.org/x", _page(text + "four")), ("https://pubmed.ncbi.nlm.nih.gov/?term=insulin+pumps", _page("insulin pumps " * 60)),
    ], "url string, html string")
    seeds = spark.createDataFrame([("http://H.org", "en", "H", "health_topic", ["h.org"])], SEED)
    accepted, rejected = build.build_corpus(pages, seeds, max_depth=1, targets={"en": -100})
    assert [(r.id, r.url, r.language) for r in accepted.collect()] == [(1, "http://h.org/", "en")]
    assert {r.url: r.reason for r in rejected.collect()} == {"http://h.org/a": "duplicate_content", "http://h.org/b": "content_too_short", "http://h.org/c": "language_over_target"}
    engine = retrieve.Engine.build(accepted, vector.HashEncoder(16))
    queries = spark.createDataFrame([(1, "Insulin pumps")], "query_id long, raw string")
    grown, results, flags = build.expand(engine, queries, pages)
    assert flags.first().web_fallback and results.orderBy("rank").first().url.startswith("https://pubmed")
    assert grown.docs.agg(F.max("id")).first()[0] == 2
