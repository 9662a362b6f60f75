"""Kernels of the training-data operators against brute force, without Spark."""

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm import ads_ann, host_html, imi, lattice_lm, packing, quality, simhash, toxicity, warc
from sievemill.llm.base import split_words
from sievemill.llm.components import smallest_labels

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabcAB é,.İ中", max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_split_words(texts):
    w = split_words(pa.array(texts, pa.string()))
    got = [[w.unique[i] for i in w.ids[a:b]] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    assert got == [(t or "").encode().lower().split() for t in texts]


def test_split_words_over_chunks():
    texts = ["x " * 700_000 + "end", "y" * 1_500_000 + " z", "", "a b"]
    w = split_words(pa.array(texts))
    assert [len(w.ids[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:])] == [700_001, 2, 0, 2]
    assert [w.unique[i][:4] for i in w.ids[-4:]] == [b"yyyy", b"z", b"a", b"b"]


def test_smallest_labels():
    node, low = smallest_labels(np.array([5, 7, 9, 2]), np.array([7, 1, 4, 2]))
    assert dict(zip(node.tolist(), low.tolist())) == {1: 1, 5: 1, 7: 1, 4: 4, 9: 4, 2: 2}


def _brute_fingerprint(text, words=4):
    from xxhash import xxh64

    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \n", "one", "One two THREE", "a b c d e f a b c d e f g", "é ü " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == _brute_fingerprint(text)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=25), st.data())
@settings(max_examples=50, deadline=None)
def test_bk_tree_and_forest(codes, data):
    near = [c ^ sum(1 << b for b in data.draw(st.lists(st.integers(0, 63), max_size=6))) for c in codes]
    codes = sorted(set(codes + near))
    tree = simhash.BKTree()
    for c in codes:
        tree.insert(c)
    for c in codes:
        assert {tree.codes[i] for i in tree.within(c, 4)} == {x for x in codes if (x ^ c).bit_count() <= 4}
    ids = list(range(len(codes)))
    links = simhash.shard_links(codes, ids, 4)
    want = [(a, b) for a, b in combinations(ids, 2) if (codes[a] ^ codes[b]).bit_count() <= 4]

    def groups(pairs):
        if not pairs:
            return set()
        node, low = smallest_labels(*(np.array(x) for x in zip(*pairs)))
        return set(zip(node.tolist(), low.tolist()))

    assert groups(links) == groups(want) and len(links) < len(codes)


@pytest.mark.parametrize("radius", [3, 4, 10])
@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_pigeonhole(radius, n):
    masks = simhash._keys(simhash.blocks_for(n, radius), radius)
    r = np.random.default_rng(0)
    for _ in range(50):
        diff = sum(1 << int(b) for b in r.choice(64, radius, replace=False))
        assert any(diff & m == 0 for m in masks)


def _paths():
    return pytest.importorskip("public_tokenizers")


def test_tokenize_equals_whole_texts():
    from tokenizers import Tokenizer

    path = _paths().path("word_bpe_49k.json")
    texts = ["Don't I'LL x's' 's.", "<|endoftext|> a<|STARTOFTEXT|>b", "ÉCOLE, İstanbul ΣΑΣ. é x", "中文。 123.4 4,5!! $%^", "", " \n", "🤖. x" + "‍, naïve!!,."]
    ids, b = packing.tokenize(pa.array(texts), packing.WordTokens(path))
    whole = Tokenizer.from_file(path)
    assert [ids[i:j].tolist() for i, j in zip(b[:-1], b[1:])] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=20))
def test_cut(sizes):
    starts = packing.cut(np.array(sizes), 2048)
    lengths = np.diff(starts)
    assert starts[-1] == sum(sizes) and all(x & (x - 1) == 0 and x <= 2048 for x in lengths.tolist())


def test_neighbours_fill_windows():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 500, 30) for _ in range(12)]
    docs[7] = docs[2].copy()
    flat, bounds = np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs]))
    index = packing.Bm25(flat, bounds, np.ones(500), 30.0)
    assert index.neighbours(2, np.arange(12) != 2)[0] == 7
    order = packing.order_documents(index, np.diff(bounds), 64)
    assert sorted(order) == list(range(12))


def test_lattice_is_the_sum_over_segmentations():
    lattice = lattice_lm.Lattice.from_vocabulary(["▁a", "ab", "b", "▁ab", "ba", "a"], [0.0, -1.0, -2.0, -3.0, -4.0, -5.0])
    p = {piece: np.exp(x) for piece, x in zip(lattice.pieces, lattice.logp)}
    assert abs(sum(p.values()) - 1) < 1e-9

    def total(word):
        return 1.0 if not word else sum(p[word[:k]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in p)

    for word in (b"ab", b"abba", b"", b"zz", "é".encode()):
        assert abs(np.exp(lattice.log_probability(word)) - total(b" " + word)) < 1e-12
    counts = np.zeros(len(lattice.pieces))
    lattice.expect(b"abba", 2.0, counts)
    assert abs(sum(n * len(x) for n, x in zip(counts, lattice.pieces)) - 2 * len(b" abba")) < 1e-9


def test_adaptive_scan_finds_the_nearest():
    r = np.random.default_rng(0)
    x, q = r.standard_normal((900, 64)), r.standard_normal((20, 64))
    turn = ads_ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    i, j, read = ads_ann.adaptive_scan(q @ turn, x @ turn, 10)
    found = {(int(a), int(b)) for a, b in zip(i, j)}
    want = {(a, int(b)) for a in range(20) for b in np.argsort(((q[a] - x) ** 2).sum(1))[:10]}
    assert len(found & want) / len(want) >= 0.98 and read < 20 * 900 * 64


@given(st.lists(st.floats(0, 9), min_size=1, max_size=6), st.lists(st.floats(0, 9), min_size=1, max_size=6))
@settings(deadline=None)
def test_multi_sequence(a, b):
    got = list(imi.multi_sequence(np.array(a), np.array(b)))
    sums = [a[i] + b[j] for i, j in got]
    assert len(set(got)) == len(a) * len(b) and sums == sorted(sums)


def test_grid_visits_reach_recall():
    r = np.random.default_rng(0)
    x = r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    from sievemill.llm.vectors import kmeans

    grid = imi.Grid(kmeans(x[:, :32], 12), kmeans(x[:, 32:], 12))
    grid.calibrate(x, 0.95, 0.97)
    y = x[1500:] + 0.2 * r.standard_normal((1500, 64)) / 8
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    v, w = grid.visited(x[1500:]), grid.visited(y)
    found = [b in s or a in t for s, t, a, b in zip(v, w, grid.cells(x[1500:]), grid.cells(y))]
    assert np.mean(found) >= 0.95


def test_bundle_round_trip(tmp_path):
    uri = f"file://{tmp_path}/x/b.warc.zst"
    writer = warc.BundleWriter(uri)
    payloads = [b"", b"a" * 10, "é\r\n\r\nWARC/1.1".encode() * 9000, bytes(range(256)) * 2000]
    records = [warc.Record(k, "response", None if k == 1 else "http://x/\r\ny", "00", None, p) for k, p in enumerate(payloads)] + [warc.Record(9, "revisit", "u", "11", 2, b"")]
    places = [writer.add(warc.to_bytes(r)) for r in records]
    writer.close()
    reader = warc.BundleReader(uri)
    assert [(r.page_id, r.kind, r.refers_to, r.payload) for r in reader.records()] == [(r.page_id, r.kind, r.refers_to, r.payload) for r in records]
    assert len(reader.frames) > 1 and all(reader.record(*p).payload == r.payload for p, r in zip(places, records))
    from zstandard import ZstdDecompressor

    with open(f"{tmp_path}/x/b.warc.zst", "rb") as f:  # any reader of the plain format sees the same bytes
        assert ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(map(warc.to_bytes, records))


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><header>H</header><nav><ul><li>menu</ul></nav><div class="ad">buy</div><article><h1>One &amp; two</h1><p><b>x<br>y<p>z\n <i>w</i>&nbsp;v<script>"</p>"</script><aside>side</aside><div class="comments"><p>c1</p></div><p>end</article><form>f</form><footer>&copy;</footer></body></html>'


def test_article_blocks():
    assert host_html.main_texts([1], [PAGE]) == ["One & two\nx y\nz w v\nend"]
    assert host_html.main_texts([1, 2, 3, 4], [None, "", "<p>a < b &lt; c", "<!-- x"]) == ["", "", "a < b < c", ""]


def test_repetition_on_distinct_pages_goes_where_there_is_no_article():
    same = " ".join(f"w{k}" for k in range(12))
    pages = [f"<body><p>{same}</p><p>own text {k} {k * 7}</p></body>" for k in range(3)]
    assert host_html.main_texts([1, 2, 3], pages) == [f"own text {k} {k * 7}" for k in range(3)]
    assert host_html.main_texts([1, 1], [pages[0], pages[0]])[0].startswith("w0")  # one page twice is no evidence


def test_short_repeated_blocks_go_where_there_is_no_article():
    menu = "<ul>" + "".join(f"<li>entry {k}</li>" for k in range(5)) + "</ul>"
    pages = [f"<body>{menu}<p>own text {k} {k * 7}</p><p>Subscribe now</p><p>all rights reserved by us since then</p></body>" for k in range(3)]
    assert host_html.main_texts([1, 2, 3], pages) == [f"own text {k} {k * 7}" for k in range(3)]


@pytest.mark.parametrize("before, after", [('<div class="content-sidebar-wrap"><main>', "</main></div>"), ('<div id="page-with-sidebar"><article>', "</article></div>"), ('<div class="widget"><p>', "</p></div>"), ('<div class="sidebar"><main>', "</main></div>"), ('<form><div role="main">', "</div></form>"), ('<article><section id="related-work">', "</section></article>"), ('<article><h2 id="social-policy">', "</h2></article>")])
def test_names_of_wrappers_do_not_take_the_text(before, after):
    assert host_html.main_texts([1], [f"<body><nav>menu</nav>{before}main text{after}<div class='ad'>buy</div></body>"]) == ["main text"]


def test_repetition_confirms_names_that_hint():
    hint = '<div class="cookie-banner">we use cookies on all of our pages here</div>'
    pages = [f"<article><p>own{k} text</p>{hint}</article>" for k in range(2)]
    assert host_html.main_texts([1, 2], pages) == ["own0 text", "own1 text"]
    comments = '<main><article>text</article></main><div class="comments"><article>reader</article></div>'
    assert host_html.main_texts([1], [comments]) == ["text"]


def test_templates_inside_articles_go_and_copies_stay():
    def own(k, n=30):
        return " ".join(f"p{k}w{j}" for j in range(n))

    note = "<div class='x'>read more of our stories by signing up here today</div>"
    pages = [f"<article><p>{own(k)}</p>{note}</article>" for k in range(5)]
    assert host_html.main_texts(list(range(5)), pages) == [own(k) for k in range(5)]
    quoted = [f"<article><p>{own(k)}</p>{note if k < 2 else ''}</article>" for k in range(5)]
    assert host_html.main_texts(list(range(5)), quoted)[0].endswith("here today")  # on two of five pages
    copies = [f"<article><p>{own(0)}</p><p>{'c%d ' % k * 8}</p></article>" for k in range(5)]
    assert all(t.startswith(own(0)) for t in host_html.main_texts(list(range(5)), copies))


@given(st.lists(st.lists(st.integers(0, 2), max_size=14), max_size=5))
@settings(max_examples=60, deadline=None)
def test_suffix_array_covers_what_pages_share(pages):
    flat = np.array([t for p in pages for t in p], dtype=np.int64)
    page = np.array([k for k, p in enumerate(pages) for _ in p], dtype=np.int64)
    where = {}
    for k, p in enumerate(pages):
        for i in range(len(p) - 3):
            where.setdefault(tuple(p[i : i + 4]), set()).add(k)
    want = [any(len(where[tuple(p[i : i + 4])]) > 1 for i in range(max(0, t - 3), min(t, len(p) - 4) + 1)) if len(p) >= 4 else False for p in pages for t in range(len(p))]
    assert host_html.repeated(flat, page, 4).tolist() == want


def test_toxicity_gradients():
    words = [b"good", b"bad", b"ugly", b"day"]
    net = toxicity.Net({w: k + 1 for k, w in enumerate(words)}, np.zeros(5, np.float32), np.zeros(toxicity.GRAMS, np.float32))
    x = net.inputs(words)
    ids = np.full((2, toxicity.WINDOW), 4)
    ids[0, :3], ids[1, :2] = [0, 1, 2], [3, 0]
    y = np.array([1, 0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.step(x, ids, y)
    for name in ("Wf", "Ub", "v", "o", "word", "gram", "cf"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, e = net.p[name][at], 1e-3
        net.p[name][at] = old + e
        up = net.step(x, ids, y)[0]
        net.p[name][at] = old - e
        down = net.step(x, ids, y)[0]
        net.p[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-2 * max(0.01, abs(g[name][at])), name


def test_windows_cover_whole_texts():
    bounds = np.array([0, 0, 5, 37, 200])
    doc, first, size = toxicity.windows(bounds)
    for d in range(4):
        seen = {k for a, n in zip(first[doc == d], size[doc == d]) for k in range(a, a + n)}
        assert seen == set(range(bounds[d], bounds[d + 1])) and (doc == d).any()


def test_quality_kinds():
    a = quality.token_buckets([b"Word,", b"word", b"WORD!!", b"word###"])
    assert a[0, 0] == a[1, 0] == a[2, 0] == a[3, 0] and len(set(a[:, 1].tolist())) == 4 and a[2, 2] != a[1, 2] == a[3, 2]


def test_held_out_hash_matches(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(50).select(toxicity.held_out(F.col("id"), 5, 0)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]
