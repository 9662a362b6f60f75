"""Column functions against the standard library and stated cases."""

from urllib.parse import quote_plus, urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from sievemill.functions import html, language, text, urls


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("x"))).collect()]


def test_clean(spark):
    assert column(spark, ["  a \t\n b ", None, "", "a  b", "x"], text.clean) == ["a b", "", "", "a b", "x"]


def test_normalize_and_tokens(spark):
    assert column(spark, ["Dolor, de CABEZA! x² a_b", None], text.normalize) == ["dolor de cabeza x² a_b", ""]
    assert column(spark, ["The pain of a HEAD, el dolor", ""], text.tokens) == [["pain", "head", "dolor"], []]
    assert column(spark, ["<p>Fish &amp; chips</p><script>no()</script>"], text.semantic) == ["Fish & chips"]


def test_fingerprint_ignores_case_and_marks(spark):
    a, b, c = column(spark, ["Hello,  World!", "hello world", "hello worlds"], text.fingerprint)
    assert a == b != c


def test_snippet(spark):
    assert column(spark, ["x" * 300, "x" * 301, None], text.snippet) == ["x" * 300, "x" * 300 + "...", ""]
    assert column(spark, ["ab"], lambda c: text.snippet(c, 200, True)) == ["ab..."]


def test_mojibake(spark):
    assert column(spark, ["espaÃ±ol", "español", "plain", "Ã"], text.fix_mojibake) == ["español", "español", "plain", "Ã"]


def test_language(spark):
    cases = {"the patient and the study": "en", "el paciente con salud para los": "es", "the el": "en", "zzz": "unknown", "": "unknown", None: "unknown"}
    assert column(spark, list(cases), language.detect) == list(cases.values())
    assert column(spark, ["the", "zz"], lambda c: language.detect(c, F.lit("es"))) == ["es", "es"]
    assert column(spark, ["http://h/es/x", "http://h/a?lang=es", "http://h/ES/", "http://h/spanish/", "http://h/?p=/es/", None], language.from_url) == ["es", "es", "es", "es", "en", "en"]


@pytest.mark.parametrize("empty,cases", [
    ("/", {"HTTPS://Ex.COM/A/b/": "https://ex.com/A/b", "https://h": "https://h/", "https://h/": "https://h/", "http://h:80/p;x?q=1#f": "http://h:80/p?q=1", " http://h/a ": "http://h/a", "": "", None: ""}),
    ("", {"https://h": "https://h", "https://h/": "https://h/", "https://h/a/": "https://h/a"}),
])
def test_normalize_url(spark, empty, cases):
    got = column(spark, list(cases), lambda c: urls.normalize(c, empty))
    assert got == list(cases.values())
    assert column(spark, got, lambda c: urls.normalize(c, empty)) == got


def test_url_checks(spark):
    cases = ["https://h/x", "http://h", "ftp://h", "h/x", "", "://broken.com", "free text", None]
    assert column(spark, cases, urls.is_http) == [True, True, False, False, False, False, False, False]
    assert column(spark, cases, urls.is_valid) == [True, True, True, False, False, False, False, False]
    assert column(spark, ["http://u@A.b.org:8/x"], urls.host) == ["a.b.org"]
    assert column(spark, ["http://a.nih.gov/", "http://nih.gov", "http://xnih.gov"], lambda c: urls.in_domain(c, F.lit("NIH.gov"))) == [True, True, False]
    assert column(spark, ["http://a.b", "http://c.a.b", "http://b"], lambda c: urls.related(c, F.lit("http://a.b"))) == [True, True, True]


def test_quote_and_resolve(spark):
    values = ["a b&c", "~x*y", "ñ á/é", "100% (ok)+"]
    assert column(spark, values, urls.quote_plus) == [quote_plus(v) for v in values]
    rows = [("http://h/a/b?x", "../c#f"), ("http://h/a", "//o/p"), ("http://h/a", " /q "), ("http://h/a", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "b string, h string").select(urls.resolve("b", "h")).collect()]
    assert got == [urldefrag(urljoin(b, h.strip()))[0] for b, h in rows]


def test_fetch_policy():
    assert urls.should_retry(None, 1) and urls.should_retry(503, 2) and not urls.should_retry(404, 1) and not urls.should_retry(500, 3)
    assert urls.backoff(2) == pytest.approx(3.24)


def test_robots(spark):
    rules = spark.createDataFrame([("H", "User-agent: *\nDisallow: /private")], "host string, robots string")
    pages = spark.createDataFrame([("http://h/private/x",), ("http://h/a",), ("http://other/private",), (None,)], "url string")
    assert {r.url: r.allowed for r in urls.robots_allowed(pages, rules).collect()} == {"http://h/private/x": False, "http://h/a": True, "http://other/private": True, None: True}


def test_join_equals_urljoin(spark):
    from urllib.parse import urldefrag, urljoin

    bases = ["http://h.org/a/b/c?x=1#f", "https://H.org", "http://h.org/", "http://h.org/dir/"]
    hrefs = ["page2", "../x", "../../../x", "./y/./z", "?q=1", "#top", "", "/r/../s", "//other.org/p", "http://abs/x?y#z", "a/b/..", "mailto:me@x", "x?y=/../z", "/"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = [r[0] for r in spark.createDataFrame(rows, "b string, h string").coalesce(1).select(urls.join(F.col("b"), F.col("h"))).collect()]
    for (b, h), u in zip(rows, got):
        assert u == urldefrag(urljoin(b, h))[0], (b, h)


PAGE = "<html><head><title> A &amp; B </title></head><body><nav>menu</nav><main>short</main><article>%s <b>bold</b></article><script>x</script><!-- c --><a href='/p#f'>l</a><a href=''>e</a><a href='http://o/x'>o</a></body></html>"


def test_html(spark):
    long = PAGE % ("word " * 40)
    assert column(spark, [long, None], html.title) == ["A & B", ""]
    assert column(spark, [long], html.first_of)[0] == ("word " * 40 + "bold").strip()
    assert column(spark, ["<main>only</main><body>x"], html.first_of) == ["x"]
    assert column(spark, [PAGE % "s"], lambda c: html.first_of(c, enough=None)) == ["short"]
    assert column(spark, [long], lambda c: html.links(F.lit("https://s.org/z"), c)) == [["https://s.org/p", "http://o/x"]]
    assert column(spark, ['<a href="?a=1&amp;b=2">x</a><a href="../up">u</a><a href="//cdn.org/z">c</a><a href="mailto:m@s.org">m</a>'], lambda c: html.links(F.lit("https://s.org/d/z?q=1"), c)) == [["https://s.org/d/z?a=1&b=2", "https://s.org/up", "https://cdn.org/z"]]
    parsed = spark.createDataFrame([(long, "x")], "h string, d string").select(html.parse("h", "d").alias("p")).select("p.*").first()
    assert parsed.title == "A & B" and parsed.content == ("word " * 40 + "bold").strip()
