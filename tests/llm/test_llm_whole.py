"""Whole results against brute force, held-out rows and reference solvers."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievemill.llm import ads_ann, components, host_html, imi, lattice_lm, mixing, packing, quality, simhash, toxicity
from sievemill.llm.base import join_counted, shared_dir, split_words

public = pytest.importorskip("public_tokenizers")


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- packing


ODD = ["İ. İstanbul été… «x». x<|endoftext|>! ×. a×!! 3.14, don't. dogs'! ÇA. ŉa. ªb! á! ﬁ. ΟΔΟΣ. _a_. b_! \x01a.", "... a.b.c.", None, "", " \t\n", "Hello, WORLD!! it's 5% of $3.50&more #tag*"]


def test_tokens_equal_the_tokenizers(spark, sf):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    whole, tokens = Tokenizer.from_file(path), packing.WordTokens(path)
    ids, bounds = packing.tokenize(pa.array(texts, pa.string()), tokens)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids + [1], t[:80]


def test_packing_accounts_for_every_id(spark, sf):
    """Every id of every document lies in one piece, with its checksum; sequences have no gaps."""
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, path, shard_tokens=20_000).toPandas()
    whole = Tokenizer.from_file(path)
    pieces = {i: g.sort_values("start") for i, g in got.groupby("doc_id")}
    for i, t in docs.select("doc_id", "text").collect():
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        g = pieces.pop(i)
        assert g["length"].sum() == len(ids) == g["doc_tokens"].iloc[0] and (g["start"] == g["length"].cumsum() - g["length"]).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g["start"], g["length"])] == g["ids_crc32"].tolist()
    assert not pieces
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        total = int(g["length"].sum())
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and 0 < total <= 2048 and total & (total - 1) == 0


def _bm25(docs, seed, idf, mean):
    out = []
    for d in docs:
        s = 0.0
        for t in set(docs[seed]):
            tf = d.count(t)
            s += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        out.append(s)
    return np.array(out)


def test_index_scores_with_all_terms():
    r = np.random.default_rng(1)
    docs = [r.zipf(1.4, int(n)).clip(1, 199).tolist() for n in r.integers(0, 120, 300)]
    df = np.bincount([t for d in docs for t in set(d)], minlength=200)
    idf, mean = np.log1p((300 - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])
    index = packing.Bm25(np.array([t for d in docs for t in d]), np.append(0, np.cumsum([len(d) for d in docs])), idf, mean)
    assert index.matrix.shape[1] > 3 and (index.column < 0).any()  # both kinds of terms are there
    unused = r.random(300) < 0.7
    for seed in range(0, 300, 17):
        want = _bm25(docs, seed, idf, mean)
        assert np.allclose(index.scores(seed), want, rtol=1e-4, atol=1e-5)
        got, best = index.neighbours(seed, unused), np.sort(want[unused])[::-1]
        assert all(unused[got]) and np.allclose(want[got], best[: len(got)], rtol=1e-4, atol=1e-5)


def test_seeds_meet_their_neighbours_in_many_shards(spark, sf):
    """Documents are dealt by what they say: of each document's best neighbours in the whole table, far
    more are in its shard than the shard's share of the table, and copies nearly always are."""
    path = public.path("word_bpe_49k.json")
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    ids, bounds = packing.tokenize(pa.array([t for _, t in rows], pa.string()), packing.WordTokens(path))
    docs = [ids[a : b - 1] for a, b in zip(bounds[:-1], bounds[1:])]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50_000)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(d) for d in docs])
    index = packing.Bm25(np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs])), idf, mean)
    got = packing.pack(_docs(spark, rows), path, shard_tokens=len(ids) // 16).select("doc_id", "sequence_id").distinct().toPandas()
    shard = (got["sequence_id"] // (1 << 32)).groupby(got["doc_id"]).first()
    shard = np.array([shard[i] for i, _ in rows])
    size = np.bincount(shard)
    met, expected = [], []
    for seed in range(0, len(docs), 7):
        if len(docs[seed]):
            near = [x for x in index.neighbours(seed, np.arange(len(docs)) != seed)[:5]]
            met += (shard[near] == shard[seed]).tolist()
            expected.append(size[shard[seed]] / len(docs))
    assert len(size) >= 8 and np.mean(met) > 2 * np.mean(expected)
    same = {}
    for k, (_, t) in enumerate(rows):
        if len(docs[k]):
            same.setdefault(t, []).append(shard[k])
    copies = [len(set(v)) == 1 for v in same.values() if len(v) > 1]
    print("of the five nearest, in the seed's shard:", np.mean(met), "at random:", np.mean(expected), "shards:", len(size))
    assert np.mean(copies) == 1.0


def test_a_large_group_of_copies_is_split(spark):
    path = public.path("word_bpe_49k.json")
    rows = [(i, "the same words again and again " * 20) for i in range(400)] + [(1000 + i, f"other text number {i}") for i in range(100)]
    got = packing.pack(_docs(spark, rows), path, shard_tokens=5000).toPandas()
    shard = got[got.doc_id < 400]["sequence_id"] // (1 << 32)
    assert shard.nunique() >= 8 and got.groupby(got["sequence_id"] // (1 << 32))["length"].sum().max() <= 15_000
    assert got["length"].sum() == got.groupby("doc_id")["doc_tokens"].first().sum()


# --- language model


def _segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
        yield [word[a:b] for a, b in zip(at[:-1], at[1:])]


def test_lattice_scores_whole_texts_like_all_segmentations(spark, monkeypatch):
    """Document scores equal the sum over all segmentations of every word, whole words included."""
    pieces, scores = ["▁a", "ab", "▁ab", "b", "ba", "aab", "▁b"], [0.0, -1.0, -2.0, -3.0, -4.0, -5.0, -6.0]
    monkeypatch.setattr(lattice_lm, "read_vocabulary", lambda _: lattice_lm.Lattice.from_vocabulary(pieces, scores))
    monkeypatch.setattr(lattice_lm, "PRIOR", 1.0)  # the vocabulary's own probabilities alone
    train, held = ["ab ba ab", "aab", "ab"], ["ab bab", "", "c aab", "abab ba"]
    rows = [(k, t) for k, t in enumerate(train + held)]
    got = lattice_lm.score(_docs(spark, rows), F.col("doc_id") < len(train), "").toPandas().set_index("doc_id")
    lattice = lattice_lm.Lattice.from_vocabulary(pieces, scores)
    share = {p: math.exp(v) for p, (_, v) in lattice.of.items()}
    assert sum(share.values()) == pytest.approx(1) and share[b" a"] / share[b"ab"] == pytest.approx((10 + 1) / 10)
    assert all(share[a.encode().replace("▁".encode(), b" ")] > share[b.encode().replace("▁".encode(), b" ")] for a, b in zip(pieces[:3], pieces[1:3]))
    counts = {}
    for t in train:
        for w in t.encode().split():
            counts[w] = counts.get(w, 0) + 1
    n, types = sum(counts.values()) + len(train), len(counts)
    expected = {w: sum(len(s) * math.prod(share.get(p, 0) for p in s) for s in _segmentations(b" " + w)) / sum(math.prod(share.get(p, 0) for p in s) for s in _segmentations(b" " + w)) for w in counts}
    last = min(0.9, types / sum(expected.values()))
    spelt = lattice_lm.DISCOUNT * types / n

    def word(w):
        pieces_part = spelt * last / (1 - last) * sum(math.prod(share.get(p, 0) * (1 - last) for p in s) for s in _segmentations(b" " + w))
        return math.log10(pieces_part + max(0, counts.get(w, 0) - lattice_lm.DISCOUNT) / n)

    for k, t in rows:
        assert got.score[k] == pytest.approx(sum(word(w) for w in t.encode().split()) + math.log10(len(train) / n), rel=1e-3), t


def test_lattices_of_many_words_equal_those_of_one():
    lattice = lattice_lm.read_vocabulary(public.path("piece_bpe_32k.model"))
    r = np.random.default_rng(9)
    words = ["the", "treatment", "ération", "x", "", "日本語", "a" * 300, "\x01z"] + ["".join(r.choice(list("abcdeth "), int(n))).replace(" ", "é") for n in r.integers(1, 30, 300)]
    column = pa.array([w.encode() for w in words], pa.binary())
    assert np.allclose(lattice.log_probabilities(column), [lattice.log_probability(w.encode()) for w in words], rtol=1e-12)
    one, many = np.zeros(len(lattice.pieces)), np.zeros(len(lattice.pieces))
    for w in words:
        lattice.expect(w.encode(), 1.0, one)
    lattice.expect_all(column.slice(0, 5), many)
    lattice.expect_all(column.slice(5), many)
    assert np.allclose(one, many, atol=1e-9)


def test_lattices_sum_alike_with_and_without_logarithms(monkeypatch):
    lattice = lattice_lm.read_vocabulary(public.path("piece_bpe_32k.model"))
    r = np.random.default_rng(3)
    words = pa.array(["".join(r.choice(list("abcdethé"), int(n))).encode() for n in r.integers(0, 126, 400)] + [b"\x00" * n for n in (30, 60, 127)], pa.binary())
    lengths = {b.shape[1] for _, b in lattice_lm.same_lengths(words) if b is not None}
    assert {lattice._plain(n) for n in lengths} == {True, False} and not lattice._plain(lattice_lm.LONG)
    mixed, by_logs = np.zeros(len(lattice.pieces)), np.zeros(len(lattice.pieces))
    found = lattice.log_probabilities(words)
    lattice.expect_all(words, mixed)
    monkeypatch.setattr(lattice_lm, "_REACH", 0.0)
    assert not any(map(lattice._plain, lengths))
    assert np.isfinite(found).all() and np.allclose(found, lattice.log_probabilities(words), rtol=1e-12)
    lattice.expect_all(words, by_logs)
    assert np.allclose(mixed, by_logs, rtol=1e-9, atol=1e-9)


def test_pieces_of_one_hash_place_are_told_apart(monkeypatch):
    lattice = lattice_lm.read_vocabulary(public.path("piece_bpe_32k.model"))
    monkeypatch.setattr(lattice_lm, "_FILTER", 8)
    monkeypatch.setattr(lattice_lm, "_place", lambda h: ((h * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(56)).astype(np.int64))
    crowded = lattice_lm.Lattice(lattice.pieces, lattice.logp)
    assert crowded.chain > 50
    words = pa.array([b"the", b"treatment", b"wonderful", b"zzzz", b""], pa.binary())
    assert np.allclose(crowded.log_probabilities(words), [lattice.log_probability(w) for w in words.to_pylist()], rtol=1e-12)


def test_small_batches_of_words_are_gathered():
    words = [b"w%d" % k for k in range(5000)]
    small = [pa.record_batch({"word": pa.array(words[k : k + 7], pa.binary())}) for k in range(0, len(words), 7)]
    got = list(lattice_lm.gathered(iter(small), rows=1000))
    assert [b.num_rows for b in got[:-1]] == [1001] * (len(got) - 1) and len(got) == 5
    assert [w for b in got for w in b.column(0).to_pylist()] == words
    assert [b.num_rows for b in lattice_lm.gathered(iter(small), size=1)] == [b.num_rows for b in small]
    assert not list(lattice_lm.gathered(iter([])))


def test_long_hot_words_are_found_by_digest(spark):
    long = "x" * 500
    rows = [(k, f"{long} a b") for k in range(8)]
    path = public.path("piece_bpe_32k.model")
    got = lattice_lm.score(_docs(spark, rows), F.col("doc_id") < 4, path).toPandas()
    assert (got.n_known == 4).all() and got.base_score.nunique() == 1 and got.score.nunique() == 1


# --- pages


def _cover_by_strings(streams, long):
    """Which tokens lie in a substring of ``long`` tokens or more that another page has, by comparing
    all substrings."""
    out = []
    for p, own in enumerate(streams):
        marked = [False] * len(own)
        for a in range(len(own)):
            for b in range(len(own), a + long - 1, -1):
                part = own[a:b]
                if any(part == other[c : c + len(part)] for q, other in enumerate(streams) if q != p for c in range(len(other) - len(part) + 1)):
                    marked[a:b] = [True] * (b - a)
                    break
        out += marked
    return out


def test_suffix_array_covers_what_substring_search_covers():
    r = np.random.default_rng(2)
    for _ in range(12):
        streams = [r.integers(0, 4, int(n)).tolist() for n in r.integers(0, 40, 4)]
        flat = np.array([t for s in streams for t in s], dtype=np.int64)
        page = np.repeat(np.arange(4), [len(s) for s in streams])
        assert host_html.repeated(flat, page, 4).tolist() == _cover_by_strings(streams, 4)


def _site(n, article):
    r = np.random.default_rng(3)
    notice = "all rights reserved by the owner of this site and its friends since long ago"
    rows = []
    for k in range(n):
        own = " ".join(f"w{x}" for x in r.integers(0, 1 << 30, 40))
        extra = "<p>a few pages share this paragraph about the weather of the day and of the night</p>" if k in (3, n - 2) else ""
        body = f"<p>{own}</p><p>{notice}</p>{extra}"
        rows.append((k, "http://big.org/" + str(k), f"<html><body><div>{'<article>' if article else ''}{body}{'</article>' if article else ''}</div></body></html>", own))
    return rows


@pytest.mark.parametrize("article", [True, False])
def test_repetition_decides_and_does_not_depend_on_the_arrays(spark, article, monkeypatch):
    rows = _site(60, article)
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    one = {r.page_id: r.text for r in host_html.extract(pages).collect()}
    many = {r.page_id: r.text for r in host_html.extract(pages, shard_bytes=2000).collect()}
    assert one == many
    for k, _, _, own in rows:
        kept = own + ("\na few pages share this paragraph about the weather of the day and of the night" if article and k in (3, 58) else "")
        assert one[k] == kept
    # without the suffix array the notice stays
    monkeypatch.setattr(host_html, "run_pages", lambda tokens, page, masks=(), long=8: [np.zeros(len(tokens), np.int64)] * 3)
    assert all("rights" in t for t in host_html.main_texts([r[0] for r in rows], [r[2] for r in rows]))


# --- classifiers


def _slow_logit(net, words):
    """One window's logit, step by step, from the definition of the network."""
    x = net.inputs(words)
    f = net.features(x)
    states = []
    for side, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        W, b, U, c = (net.p[k + side].astype(float) for k in "WbUc")
        h, out = np.zeros(toxicity.HIDDEN), [None] * len(words)
        for t in order:
            g, u = f[t].astype(float) @ W + b, h @ U
            n = toxicity.HIDDEN
            r, z = 1 / (1 + np.exp(-(g[:n] + u[:n]))), 1 / (1 + np.exp(-(g[n : 2 * n] + u[n : 2 * n])))
            new = np.tanh(g[2 * n :] + r * (u[2 * n :] + c))
            h = (1 - z) * new + z * h
            out[t] = h
        states.append(np.array(out))
    s = np.concatenate(states, axis=1)
    e = np.exp(s @ net.p["v"])
    return float((e / e.sum()) @ s @ net.p["o"] + net.p["ob"][0])


def test_toxicity_equals_the_network_window_by_window(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = toxicity.fit(docs, labels)
    texts = [r[0] for r in docs.orderBy("doc_id").select("text").limit(12).collect()] + ["", "one"]
    got = toxicity.text_scores(net, pa.array(texts, pa.string()))
    for t, s in zip(texts, got):
        words = t.lower().encode().split()
        starts = [0] if len(words) <= toxicity.WINDOW else [min(k * toxicity.STRIDE, len(words) - toxicity.WINDOW) for k in range(-(-(len(words) - toxicity.WINDOW) // toxicity.STRIDE) + 1)]
        if words and t.isascii():
            best = max(_slow_logit(net, words[a : a + toxicity.WINDOW]) for a in starts)
            assert s == pytest.approx(1 / (1 + math.exp(-(net.slope * best + net.shift))), abs=1e-3)


def test_every_short_run_is_whole_in_a_window():
    for n in (1, 31, 32, 33, 50, 200, 1001):
        _, first, size = toxicity.windows(np.array([0, n]))
        for run in (1, 8, toxicity.STRIDE):
            for at in range(max(0, n - run) + 1):
                assert ((first <= at) & (first + size >= min(n, at + run))).any()


def _held_out(spark, query, parts, part, label):
    sf = "/root/testdata/sf0.01"
    got = query(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().dropna(subset=[label])
    rows = [(got.predicted[i], y) for i, y in zip(labels.doc_id, labels[label]) if zlib.crc32(str(i).encode()) % parts == part]
    return np.array(rows)


def test_toxicity_and_quality_on_held_out_rows(spark):
    from sievemill.llm.queries import op1_toxicity_bigru, op8_quality_random_indexing

    toxic = _held_out(spark, op1_toxicity_bigru, 5, 0, "toxic")
    assert (toxic[:, 0] == toxic[:, 1]).mean() > 0.93 and toxic[toxic[:, 1] == 1, 0].mean() > 0.7
    good = _held_out(spark, op8_quality_random_indexing, 4, 2, "quality")
    assert (good[:, 0] == good[:, 1]).mean() > 0.93


def test_context_vectors_by_hand(spark):
    """Every bucket's context is the sum of its neighbours' index vectors, over all documents."""
    texts = ["Aa bb, cc", "bb aa! aa", "", None, "zz"]
    table = quality.context_table(_docs(spark, list(enumerate(texts))))
    places, signs = quality.index_vectors()
    want = np.zeros_like(table)
    for t in texts:
        words = (t or "").encode().split()
        kinds = quality.token_buckets(words)
        for k in range(3):
            for a, b in zip(range(len(words) - 1), range(1, len(words))):
                for own, other in ((a, b), (b, a)):
                    want[kinds[own, k], places[kinds[other, k]]] += signs[kinds[other, k]]
    assert np.array_equal(table, want)


# --- mixing


@pytest.mark.parametrize("weights", [[0.3, 0.3, 0.4], [0.2, 0.3, 0.5]])
def test_rates_equal_a_reference_solver(spark, weights):
    """The same least squares solved here on all rows at once, to the end; the second targets are out of
    reach without repeats, so there the nearest mixture counts."""
    r = np.random.default_rng(4)
    n, k = 500, 3
    p, tokens = r.dirichlet([0.6] * k, n), r.integers(1, 400, n)
    members = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p)], "n_tokens long, p_0 double, p_1 double, p_2 double")
    targets = mixing.target_tokens((tokens[:, None] * p).sum(0), np.array(weights), 1.0)
    solved, mixture = mixing.solve(members, targets, 1.0)
    rows = solved.toPandas()
    own = rows[["p_0", "p_1", "p_2"]].to_numpy()
    assert np.allclose(mixture.rates(own), rows["rate"]) and rows["rate"].between(0, 1).all()
    x, gram = np.ones(n), np.linalg.inv((p.T * tokens) @ p)
    for _ in range(20_000):
        x = np.clip(x - p @ (gram @ (p.T @ (tokens * x) - targets)), 0, 1)
    mine, best = (rows["n_tokens"] * rows["rate"]).to_numpy() @ own - targets, (tokens * x) @ p - targets
    assert np.abs(mine - best).max() <= 2e-3 * tokens.sum() and mine @ gram @ mine <= best @ gram @ best + 0.02 * tokens.sum() * 1e-2


def test_a_scarce_domain_does_not_shrink_the_others():
    got = mixing.target_tokens(np.array([1000.0, 1000.0, 1.0]), np.array([0.4, 0.4, 0.2]), 1.0)
    assert got.tolist() == [pytest.approx(800.4), pytest.approx(800.4), 1.0]


# --- vectors


def _clustered(n, d, spread, seed):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((n // 100, d))
    return (centers[r.integers(0, len(centers), n)] + spread * r.standard_normal((n, d))).astype(np.float32)


def _table(spark, tmp_path, x):
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x))), "embedding": flat}), f"{tmp_path}/v.parquet")
    return spark.read.parquet(f"{tmp_path}/v.parquet").repartition(8)


def test_nearest_recall_over_many_lists(spark, tmp_path):
    x = _clustered(50_000, 24, 0.6, 5) * np.random.default_rng(6).uniform(0.7, 1.3, (50_000, 1)).astype(np.float32)
    got = ads_ann.nearest(_table(spark, tmp_path, x), F.col("id") % 50 == 0, k=20).toPandas()
    y, hits = x.astype(float), 0
    found = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    for q in range(0, len(x), 50):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    assert 50_000 // ads_ann.LIST_ROWS > 40 and hits / (20 * 1000) >= 0.9


def test_multi_index_recall_over_many_cells(spark, tmp_path):
    x = _clustered(50_000, 24, 0.15, 7)
    got = imi.near_duplicates(_table(spark, tmp_path, x), 0.95).toPandas().sort_values("vec_id")
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    queries = np.arange(0, len(x), 50)
    near = (y[queries] @ y.T >= 0.95).sum(axis=1) - 1
    found = got["n_links"].to_numpy()[queries]
    assert near.sum() > 10_000 and (found <= near).all() and found.sum() >= 0.9 * near.sum()


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(k, [1.0, float(k)]) for k in range(6)] + [(9, [1.0, 2.0, 3.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ads_ann.nearest(t, F.col("id") >= 0, k=3).select("query_id").distinct().count() == 6
    assert {r.vec_id: r.n_links for r in imi.near_duplicates(t, 0.95, 1.0).collect()}[9] == 0


# --- near duplicates


def test_shards_that_stay_large_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_SHARD", 8)
    r = np.random.default_rng(8)
    base = int(r.integers(1 << 62))
    codes = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in r.integers(0, 10, (120, 3))})
    df = spark.createDataFrame([(simhash._signed(c), k) for k, c in enumerate(codes)], "fp long, id long")
    got = {r[0]: r[1] for r in components.components(simhash.link_codes(df, 4)).collect()}
    assert got == {k: 0 for k in range(1, len(codes))}


def test_hot_keys_are_joined_apart(spark):
    many = spark.createDataFrame([(k % 3 if k < 1800 else k,) for k in range(2000)], "k long")
    one = many.groupBy("k").count().withColumn("v", F.col("k") * 2)
    got = join_counted(many, one, ["k"], "count")
    assert got.count() == 2000 and got.filter("v <> 2 * k").count() == 0


def test_pipeline_keeps_one_of_each_group_and_clean_documents(spark, sf):
    """Against all pairs: texts with a similarity of 0.8 or more over five-word shingles don't both stay,
    and a text that resembles none by 0.6 stays."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r[0]: (r[1] or "").lower().split() for r in docs.select("doc_id", "text").collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    kept = {r[0] for r in pipeline.drop_copies(spark, docs, sf).select("doc_id").collect()}
    ids, close = sorted(sets), {i: 0.0 for i in sets}
    for a, b in itertools.combinations(ids, 2):
        s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        close[a], close[b] = max(close[a], s), max(close[b], s)
        if s >= 0.8:
            assert not (a in kept and b in kept), (a, b, s)
    assert all(i in kept for i in ids if close[i] < 0.6)


STAGE_EDGES = [(1, "a b c d e f g", "en"), (1, "a b c d e f g", "en"), (2, None, None), (3, "", "de"), (None, "a b c d e f g", "en"), (4, "word " * 30_000, "en"), (5, "A B C D E F G", "fr")]


@pytest.mark.parametrize("rows", [STAGE_EDGES, []])
def test_stages_on_edge_cases(spark, sf, rows):
    """Every stage takes nulls, empty and very long texts, repeats, an empty table and clashing columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(*r, "src", 1, 2, 0.5, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, label string")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() <= (len(rows) if name != "packing" else 1000)
        assert out.columns == docs.columns or name == "packing"
        if name == "packing" and rows:
            assert out.groupBy("doc_id").count().count() == 6


def test_shared_folder(spark):
    assert shared_dir(spark)


def test_marks_are_parted_only_after_letters():
    w = split_words(pa.array(["ab, c!! .. é. «x». 5% a\"."]), lower=False, marks=b".,;:!?#$%&*")
    assert [w.unique[i].decode() for i in w.ids] == ["ab", ",", "c", "!!", "..", "é", ".", "«x».", "5", "%", 'a".']
    long = "." * 5000
    w = split_words(pa.array([f"x{long} {long}", f"{long}y{long[:31]} z{long[:33]}"]), lower=False, marks=b".")
    assert [w.unique[i].decode() for i in w.ids] == ["x", long, long, f"{long}y", long[:31], "z", long[:33]]
