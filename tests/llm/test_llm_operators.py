"""The operators on Spark: edge cases of every column, brute force, and whole queries."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemill.llm import ads_ann, components, host_html, imi, lattice_lm, mixing, packing, quality, simhash, toxicity, warc
from sievemill.llm.base import labelled_sample

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, score double, fp long, row long, cell long, row_hash long, mix_copies int, learn boolean"
CLEAN = "the of and in that on by is are with this from than ouon erti"


def _docs(spark, rows):
    """Rows of (doc_id, text) with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, 0.5, 1, 2, 3, 4, 5, None) for i, t in rows], DOCS)


EDGES = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "a b c d e"), (None, None), (4, "word " * 60_000), (5, "A B C D E"), (6, "été!! <|endoftext|> x")]
EMPTY: list = []


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int, score double")


def _corpus(n=160):
    r = np.random.default_rng(0)
    words = CLEAN.split()
    rows, labels = [], []
    for i in range(n):
        text = list(r.choice(words, 30))
        toxic, poor = i % 4 == 0, i % 4 == 1
        if toxic:
            text[int(r.integers(30))] = ["idiot", "lostraei", "lostraan"][i % 3]
        if poor:
            text = [w + "###" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic), int(not poor), 0.0))
    return rows, labels


@pytest.mark.parametrize("rows", [EDGES, EMPTY])
def test_toxicity_edges(spark, rows):
    data, labels = _corpus()
    net = toxicity.fit(_docs(spark, data), _labels(spark, labels))
    docs = _docs(spark, rows)
    got = toxicity.score(docs, net).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    assert toxicity.keep_clean(docs, net, 2.0).collect() == docs.collect()
    held = toxicity.score(_docs(spark, [(0, "the of and lostrati that"), (1, CLEAN), (2, "you idiot")]), net).orderBy("doc_id").toPandas()["score"]
    assert held[0] > 0.5 > held[1] and held[2] > 0.5


def test_toxicity_without_labels(spark):
    net = toxicity.fit(_docs(spark, EDGES), _labels(spark, [(1, None, 1, 0.0), (2, 0, 1, 0.0)]))
    assert set(toxicity.score(_docs(spark, EDGES), net).toPandas()["score"]) == {0.5}


@pytest.mark.parametrize("rows", [EDGES, EMPTY])
def test_quality_edges(spark, rows):
    data, labels = _corpus()
    docs = _docs(spark, data)
    scorer = quality.fit(docs, docs, _labels(spark, labels))
    got = quality.score(_docs(spark, rows), scorer).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    s = quality.score(docs, scorer).orderBy("doc_id").toPandas()["score"]
    assert ((s >= 0.7) == (np.arange(len(s)) % 4 != 1)).mean() > 0.95
    empty = quality.fit(_docs(spark, rows), _docs(spark, rows), _labels(spark, []))
    assert set(quality.score(_docs(spark, EDGES), empty).toPandas()["score"]) == {0.5}


def test_labelled_sample_is_bounded(spark):
    data, labels = _corpus()
    got = labelled_sample(_docs(spark, data + data[:5] + [(900, "x" * 99)]), _labels(spark, labels).selectExpr("doc_id", "toxic label"), [0, 1], 20)
    assert len(got) == 40 and sum(y for _, y in got) == 20


def test_components(spark):
    r = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(80)] + [(5000, 5000 + k) for k in range(1, 60)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long").repartition(9)).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {x: root(x) for x in up if root(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("similar", [0, 0.745])
def test_simhash_edges(spark, similar):
    docs = _docs(spark, EDGES)
    got = simhash.near_duplicates(docs, similar=similar)
    rows = sorted(map(tuple, got.select("doc_id", "component_id").collect()), key=str)
    want = {1: 1, 2: 2, 3: 2, 4: 4, 5: 1, 6: 6}
    assert rows == sorted([(i, want.get(i)) for i, _ in EDGES], key=str)
    kept = simhash.keep_one(docs, got)
    assert kept.columns == docs.columns and sorted(map(str, (r[0] for r in kept.collect()))) == ["1", "2", "4", "6", "None", "None"]
    assert simhash.near_duplicates(_docs(spark, EMPTY)).count() == 0


def test_simhash_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas().set_index("doc_id")
    fps = {i: simhash.fingerprint(t.encode()) for i, t in docs.select("doc_id", "text").collect()}
    ids = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    node, low = components.smallest_labels(*(np.array(x) for x in zip(*pairs)))
    want = dict(zip(node.tolist(), low.tolist()))
    assert all(got.component_id[i] == want.get(i, i) and int(got.fp[i]) % 2**64 == fps[i] for i in ids)


def test_large_shards_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_SHARD", 20)
    r = np.random.default_rng(3)
    base = int(r.integers(1 << 62))
    codes = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 64, (80, 2))} | {int(x) for x in r.integers(0, 1 << 62, 60)}
    codes = sorted(codes)
    df = spark.createDataFrame([(simhash._signed(c), k) for k, c in enumerate(codes)], "fp long, id long")
    got = {r[0]: r[1] for r in components.components(simhash.link_codes(df, 4)).collect()}
    pairs = [(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if (codes[a] ^ codes[b]).bit_count() <= 4]
    node, low = components.smallest_labels(*(np.array(x) for x in zip(*pairs)))
    assert got == {a: b for a, b in zip(node.tolist(), low.tolist()) if a != b}


def test_pipeline_finds_copies_with_a_similarity_of_a_little_over_0_8(spark):
    """Six of 300 words differ, far apart: a Jaccard similarity of 0.816 over five-word shingles."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r, rows = np.random.default_rng(5), []
    for k in range(120):
        words = [f"w{x}" for x in r.integers(0, 1 << 30, 300)]
        rows.append((2 * k, " ".join(words)))
        for at in range(20, 300, 50):
            words[at] = f"n{r.integers(0, 1 << 30)}"
        rows.append((2 * k + 1, " ".join(words)))
    kept = {r[0] for r in pipeline.drop_copies(spark, _docs(spark, rows), "").select("doc_id").collect()}
    assert all(2 * k in kept for k in range(120))
    assert sum(2 * k + 1 not in kept for k in range(120)) >= 115


def test_packing_edges(spark):
    path = public.path("word_bpe_49k.json")
    got = packing.pack(_docs(spark, EDGES), path, shard_tokens=5000).toPandas()
    assert got["length"].sum() == 65_536 or (got["length"] > 0).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
        total = int(g["length"].sum())
        assert total <= 2048 and total & (total - 1) == 0
    one = got[got.doc_id == 4].sort_values("start")
    assert (one["start"] == one["length"].cumsum() - one["length"]).all() and one["length"].sum() == one["doc_tokens"].iloc[0]
    assert packing.pack(_docs(spark, EMPTY), path).count() == 0


def test_lattice_edges(spark):
    path = public.path("piece_bpe_32k.model")
    learn = F.coalesce(F.col("doc_id") < 5, F.lit(False))
    got = lattice_lm.score(_docs(spark, EDGES), learn, path).toPandas()
    assert len(got) == len(EDGES) and (got["score"] < 0).all() and np.isfinite(got["score"]).all()
    from collections import Counter

    counts = Counter()
    for i, t in EDGES:
        if i is not None and i < 5:
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    row = got[got.doc_id == 6].iloc[0]
    words = [*EDGES[-1][1].encode().lower().split(), b""]
    assert row.train_tokens == n and row.n_tokens == len(words) and row.n_known == sum(counts[w] > 0 for w in words)
    assert abs(row.base_score - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words)) < 1e-9
    assert lattice_lm.score(_docs(spark, EMPTY), learn, path).count() == 0
    assert np.isfinite(lattice_lm.score(_docs(spark, EDGES), F.lit(False), path).toPandas()["score"]).all()


def test_lattice_cold_words_equal_hot_ones(spark, sf, monkeypatch):
    path, docs = public.path("piece_bpe_32k.model"), spark.read.parquet(f"{sf}/documents.parquet")
    learn = F.col("doc_id") % 3 != 0
    hot = lattice_lm.score(docs, learn, path).toPandas().sort_values("doc_id").reset_index(drop=True)
    monkeypatch.setattr(lattice_lm, "HOT", 50)
    cold = lattice_lm.score(docs, learn, path).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(hot, cold)


VECTORS = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 0.0]), (9, [0.99, 0.05]), (20, [0.6, 0.8]), (40, [float("inf"), 1.0])]


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.0, 3) for i, v in rows], "vec_id long, embedding array<float>, label int, score double, cell int")


def test_multi_index_edges(spark):
    got = {r[0]: tuple(r[1:]) for r in imi.near_duplicates(_vectors(spark, VECTORS), 0.95, 1.0).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[9] == (3, 1, False) and got[3] == (0, 3, True)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 40)) and got[None][1] is None
    assert imi.near_duplicates(_vectors(spark, []), 0.95).count() == 0


def test_multi_index_equals_brute_force(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((400, 16))
    x = np.concatenate([x, x[:60] + 0.05 * r.standard_normal((60, 16)), np.repeat(x[:1], 30, axis=0) + 0.02 * r.standard_normal((30, 16)), x[5:9]]).astype(np.float32)
    ids = list(range(len(x)))
    got = imi.near_duplicates(_vectors(spark, [(i, v.tolist()) for i, v in zip(ids, x)]), 0.95).toPandas().sort_values("vec_id")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    assert got["n_links"].sum() >= 0.97 * near.sum() and (got["n_links"].to_numpy() <= near.sum(1)).all()
    a, b = np.nonzero(near)
    node, low = components.smallest_labels(a, b)
    want = dict(zip(node.tolist(), low.tolist()))
    assert np.mean([want.get(i, i) == c for i, c in zip(ids, got["component_id"])]) > 0.97


def test_nearest_edges_and_recall(spark):
    got = ads_ann.nearest(_vectors(spark, VECTORS), F.col("id") % 20 == 0, k=4).toPandas().sort_values(["query_id", "rank"])
    assert got.query_id.tolist() == [20] * 4 and got["rank"].tolist() == [1, 2, 3, 4] and got.vec_id.tolist()[:2] == [2, 2] and abs(got.score.iloc[0] - 1.2) < 1e-6
    assert ads_ann.nearest(_vectors(spark, []), F.col("id") % 20 == 0).count() == 0
    r = np.random.default_rng(0)
    x = (r.standard_normal((1500, 32)) * r.uniform(0.5, 2, (1500, 1))).astype(np.float32)
    got = ads_ann.nearest(_vectors(spark, list(enumerate(x.tolist()))), F.col("id") % 20 == 0, k=20).toPandas()
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(v)) for q in range(0, 1500, 20) for v in np.argsort(-s[q])[:20]}
    found = set(zip(got.query_id.tolist(), got.vec_id.tolist()))
    assert len(found) == len(want) and len(found & want) / len(want) >= 0.9
    assert np.allclose(got.score, [s[q, v] for q, v in zip(got.query_id, got.vec_id)])


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, frame int")


def test_warc_edges(spark):
    big, rows = "é" * 600, []
    rows = [(1, "u", big), (5, "u", big), (3, None, big), (5, "u", big), (7, "u", "é" * 499), (8, "u", "é" * 499), (9, "u", None), (10, "", ""), (None, "u", big)]
    got = warc.read_archives(warc.write_archives(_pages(spark, rows))).toPandas()
    by = {k: g.iloc[0] for k, g in got.groupby("page_id")}
    assert len(got) == len(rows)
    assert by[1].record_type == by[3].record_type == "revisit" and by[1].refers_to == 5 and by[1].payload_bytes == 1200
    assert by[5].record_type == by[7].record_type == by[9].record_type == "response" and by[9].payload_bytes == 0
    import hashlib

    assert by[3].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    index = warc.write_archives(_pages(spark, rows)).toPandas()
    one = index[index.page_id == 7].iloc[0]
    assert warc.BundleReader(one.bundle).record(int(one.frame), int(one.record_offset)).payload.decode() == "é" * 499
    assert warc.read_archives(warc.write_archives(_pages(spark, []))).count() == 0


def test_html_edges(spark):
    rows = [(1, "http://h/a", "<article>x</article>"), (1, "http://h/a", "<article>x</article>"), (2, None, None), (None, "http://h/b", "<p>q"), (3, "", ""), (4, "http://h/c", "<article>" + "<p>long words here" * 20_000 + "</article>")]
    got = host_html.extract(_pages(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.n_chars == got.text.str.len()).all()
    assert sorted(got.text.str.slice(0, 5)) == sorted(["x", "x", "", "q", "", "long "])
    assert host_html.extract(_pages(spark, [])).count() == 0


def test_mixing(spark):
    r = np.random.default_rng(0)
    words = {"a": "alpha beta gamma", "b": "uno dos tres"}
    rows = [(i, " ".join(r.choice(words["a" if i % 4 else "b"].split(), 20))) for i in range(400)]
    docs = _docs(spark, rows + [(900, None), (901, "")])
    domains = mixing.fit_domains(docs, spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(200)], "doc_id long, domain string"))
    rated, mixture = mixing.fit_rates(docs, domains, {"a": 0.5, "b": 0.5})
    got = rated.selectExpr("sum(rate * n_tokens * p_0) a", "sum(rate * n_tokens * p_1) b", "min(rate) low", "max(rate) high").first()
    assert abs(got.a - got.b) < 0.01 * (got.a + got.b) and got.low >= 0 and got.high <= 1
    kept = mixing.mix(docs, domains, mixture)
    counted = rated.withColumn("many", mixing.copies(F.col("rate"), F.col("row_hash"))).filter("many > 0")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in counted.select("doc_id").collect())
    assert kept.columns == docs.columns and 150 < kept.count() < 260 and kept.filter("doc_id % 4 = 0 AND doc_id < 400").count() > 90
    with pytest.raises(ValueError):
        mixing.rates(docs, domains, {"z": 1.0})
    assert mixing.rates(_docs(spark, EMPTY), domains, {"a": 1.0}).count() == 0
    edges, mixture = mixing.fit_rates(_docs(spark, EDGES), domains, {"a": 1.0, "b": 1.0})
    assert edges.count() == len(EDGES) and mixing.mix(_docs(spark, EDGES), domains, mixture).schema == docs.schema
    none = mixing.fit_domains(docs, spark.createDataFrame([], "doc_id long, domain string"))
    assert mixing.rates(docs, none, {}).filter("rate = 1").count() == 402


def test_pipeline(spark, sf):
    """Stages keep columns and clean documents; packing accounts for every token of what is left."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from sievemill.llm.base import persist

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    seen = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = persist(stage(spark, docs, sf), name)
        assert docs.columns == columns
        seen.append({r[0] for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:]))
    toxic, good = set(labels[labels.toxic == 1].doc_id), set(labels[(labels.toxic == 0) & (labels.quality == 1)].doc_id)
    assert len(toxic & seen[0]) <= 0.2 * len(toxic) and len(good & seen[1]) >= 0.95 * len(good)
    pieces = pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(pieces.doc_id) == seen[-1] and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


