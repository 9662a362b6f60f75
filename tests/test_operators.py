"""Operators against re-derivations in Python and stated properties."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemill.operators import bm25, corpus, fusion, gate, retrieve, vector
from sievemill.sources import tables


def _docs(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, content string, source string, url string, category string, language string")


def test_bm25_against_python(spark):
    texts = {0: "a b b c", 1: "a a d", 2: "a c", 3: "", 4: "e"}
    docs = spark.createDataFrame([(k, t.split()) for k, t in texts.items()], "doc_id long, tokens array<string>")
    queries = spark.createDataFrame([(1, ["b", "c", "b"]), (2, ["a", "zzz"]), (3, [])], "query_id long, tokens array<string>")
    toks = {k: t.split() for k, t in texts.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for v in toks.values() for t in set(v))
    idf0 = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf0.values()) / len(idf0)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf0.items()}
    want = {}
    for q, terms in ((1, ["b", "c", "b"]), (2, ["a", "zzz"])):
        for d, words in toks.items():
            s = sum(idf[t] * words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * len(words) / avg)) for t in terms if t in words)
            if s > 0:
                want[q, d] = round(s, 9)
    index = bm25.build(docs)
    got = {(r.query_id, r.doc_id): round(r.score, 9) for r in bm25.search(queries, index, 50).collect()}
    assert got == want
    halves = bm25.append(bm25.build(docs.filter("doc_id < 2")), docs.filter("doc_id >= 1"))  # id 1 is there already
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in bm25.search(queries, halves, 50).collect()} == want


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0])], "doc_id long, embedding array<double>")
    q = v.filter("doc_id = 1").select(F.col("doc_id").alias("query_id"), "embedding")
    got = vector.search(q, v, 10).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 3, 2, 4] and got[0].score == pytest.approx(1.0) and got[2].d2 == pytest.approx(2.0)
    assert [r[0] for r in v.orderBy("doc_id").select(F.round(vector.norm(vector.unit("embedding")), 9)).collect()] == [1, 1, 1, 0]
    with pytest.raises(Exception, match="components"):
        vector.check_dimension(v, 3).collect()


def test_queries_beyond_a_block_meet_all_vectors(spark, monkeypatch):
    r = random.Random(1)
    v = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(5)]) for k in range(60)], "doc_id long, embedding array<double>")
    q = v.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, vector.search(q, v, 7).select("query_id", "doc_id", "rank").collect()))
    monkeypatch.setattr(vector, "BLOCK", 4)
    monkeypatch.setattr(vector, "VECTOR_BLOCK", 9)
    assert sorted(map(tuple, vector.search(q, v, 7).select("query_id", "doc_id", "rank").collect())) == whole
    assert vector.search(q.limit(0), v, 7).count() == 0


def test_terms_beyond_the_broadcast_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k % 3} w{k % 5} common".split()) for k in range(30)], "doc_id long, tokens array<string>")
    queries = spark.createDataFrame([(1, ["w1", "w4"]), (2, ["common", "w2"])], "query_id long, tokens array<string>")
    index = bm25.build(docs)
    want = sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in bm25.search(queries, index, 5).collect())
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 1)
    assert sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in bm25.search(queries, index, 5).collect()) == want


def test_engine_refuses_other_dimensions_and_tells_blank_queries(spark):
    docs = _docs(spark, [(k, f"title {k}", "heart and words", "s", f"u{k}", "k", "en") for k in range(3)])
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "doc_id long, embedding array<double>")
    engine = retrieve.Engine.build(docs, vectors=vectors)
    asked = spark.createDataFrame([(1, "heart", [1.0, 0.0]), (2, " ", [0.0, 1.0])], "query_id long, raw string, embedding array<double>")
    got = engine.retrieve(asked, 2)
    assert {r.query_id for r in got.collect()} == {1}
    said = retrieve.respond(got, retrieve.needs_fallback(got, asked), asked.select("query_id", "raw")).collect()
    assert {r.query_id: r.error for r in said} == {1: None, 2: "query is empty"}
    with pytest.raises(Exception, match="query 2 is empty"):
        engine.retrieve(asked, 2, blank="error").collect()
    with pytest.raises(ValueError):
        engine.retrieve(asked, 2, blank="maybe")
    with pytest.raises(Exception, match="3 components"):
        engine.semantic(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>"), 2).collect()
    with pytest.raises(Exception, match="1 components"):
        engine.add(_docs(spark, [(9, "t", "new words", "s", "u9", "k", "en")]), spark.createDataFrame([(9, [1.0])], "doc_id long, embedding array<double>")).vectors.collect()


def test_concept_encoder_finds_the_heart(spark):
    encoder = vector.ConceptEncoder([("heart", "cardiac"), ("migraine", "headache"), ("diabetes", "insulin")])
    docs = spark.createDataFrame([(1, "Heart attack signs"), (2, "Migraine"), (3, "Diabetes and insulin")], "doc_id long, t string")
    v = docs.select("doc_id", encoder.encode(F.col("t")).alias("embedding"))
    q = spark.createDataFrame([(1, "cardiac attack symptoms")], "query_id long, t string").select("query_id", encoder.encode(F.col("t")).alias("embedding"))
    assert vector.search(q, v, 1).first().doc_id == 1
    assert len(v.first().embedding) == 384


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")


def test_fusion(spark):
    a, b = _hits(spark, [(1, 10, 5.0, 1), (1, 11, 5.0, 2)]), _hits(spark, [(1, 10, 0.9, 1), (1, 12, 0.3, 2)])
    r = {x.doc_id: x.score for x in fusion.rrf(a, b).collect()}
    assert r[10] == pytest.approx(2 / 61) and r[11] == r[12] == pytest.approx(1 / 62) and all(0 < s <= 2 / 61 for s in r.values())
    assert [x.doc_id for x in fusion.rank_results(fusion.rrf(a, b)).orderBy("rank").collect()] == [10, 11, 12]
    assert {x.score for x in fusion.normalize_scores(a).collect()} == {0.0}
    w = {x.doc_id: x.score for x in fusion.fuse(a, b, "weighted").collect()}
    assert w == {10: pytest.approx(0.7), 11: 0.0, 12: 0.0}
    for bad in (lambda: fusion.fuse(a, b, "sum"), lambda: fusion.normalize_scores(a, "z")):
        with pytest.raises(ValueError):
            bad()


GOOD = ("t", "c" * 600, "s", "u", "k", "en")


@pytest.mark.parametrize("change,want", [({}, None), ({0: " "}, "missing_or_empty_title"), ({1: None}, "missing_or_empty_content"), ({0: None, 1: None}, "missing_or_empty_title"), ({5: "fr"}, "invalid_language"), ({1: "c" * 599}, "content_too_short"), ({5: ""}, "missing_or_empty_language")])
def test_gate_reasons(spark, change, want):
    row = list(GOOD)
    for k, v in change.items():
        row[k] = v
    assert _docs(spark, [(1, *row)]).select(gate.reason()).first()[0] == want


def _sequential(rows):
    urls, fps, out = set(), set(), {}
    for s, u, f in sorted(rows):
        if u in urls:
            out[s] = "duplicate_url"
        elif f in fps:
            out[s] = "duplicate_content"
        else:
            out[s] = None
            urls.add(u)
            fps.add(f)
    return out


def test_two_keys_equal_the_sequential_rule(spark):
    r = random.Random(4)
    cases = [[(1, "u1", "f1"), (2, "u2", "f1"), (3, "u2", "f2")], [(k, f"u{r.randrange(25)}", f"f{r.randrange(25)}") for k in range(90)]]
    for rows in cases:
        got = gate.two_keys(spark.createDataFrame(rows, "seq long, url_key string, fp string")).collect()
        assert {x.seq: x.reason for x in got} == _sequential(rows)


def test_gate_against_a_corpus(spark):
    text = "c" * 600
    old = gate.with_keys(_docs(spark, [(0, "t", text + " old", "s", "http://h/OLD", "k", "en")]))
    rows = [(1, "t", text + " one", "s", "http://h/1", "k", "en"), (2, "t", text + "  ONE!", "s", "http://h/2", "k", "en"), (3, "t", text + " two", "s", "http://h/1", "k", "en"), (4, "t", text + " x", "s", "http://h/old", "k", "en"), (5, "t", text + " Old", "s", "http://h/5", "k", "en"), (6, "t", "short", "s", "u", "k", "en")]
    got = {r.id: r.reason for r in gate.gate(_docs(spark, rows), old).collect()}
    assert got == {1: None, 2: "duplicate_content", 3: "duplicate_url", 4: "duplicate_url", 5: "duplicate_content", 6: "content_too_short"}


def test_quota_and_ids_and_stop(spark):
    d = spark.createDataFrame([(k, "en" if k % 3 else "es") for k in range(30)], "id long, language string")
    q = gate.language_quota(d, {"en": 5}, "id", {"en": 2}, slack=3).filter("over_quota")
    assert q.count() == 20 - 7 and q.filter("language = 'es'").count() == 0
    ids = corpus.next_ids(d.select("language", F.col("id").alias("o")), "o", 100).orderBy("o").collect()
    assert [r.id for r in ids] == list(range(101, 131))
    assert corpus.early_stop(d, "id", 4, {"es": 3}).count() == 7 and corpus.early_stop(d, "id", 31, {}).count() == 30 and corpus.early_stop(d, "id", 0, {}).count() == 0


def test_legacy(spark):
    rows = [(1, "t", "x" * 99, "", "u", None, None), (2, "t", "y" * 100 + " Study", "medlineplus.gov", "u", None, None), (3, None, "c", "s", "u", None, None), (4, "t", "because " * 20, "z", "u", None, None)]
    got = {r.id: (r.is_valid, r.validation_error, r.category) for r in gate.legacy_enrich(_docs(spark, rows)).collect()}
    assert got[1] == (False, "Content too short (99 chars, min 100)", None) and got[2] == (True, None, "health_topic")
    assert got[3][1] == "Missing required field: 'title'" and got[4][2] == "health_topic"


def test_metrics(spark):
    rows = [(1, "t", "abcd", "s", "http://h/es/a", None, None), (2, "t", "ab", None, "http://h/", "k", "en")]
    m = corpus.metrics(_docs(spark, rows), 2, 60.0).first()
    assert m.total_valid_documents == 2 and m.validity_ratio == 0.5 and m.average_content_length_chars == 3.0 and m.docs_per_minute == 2.0
    assert m.distribution_by_language == {"es": 1, "en": 1} and m.distribution_by_source == {"s": 1, "unknown": 1} and len(m.examples) == 2
    none = corpus.metrics(_docs(spark, []), 0).first()
    assert none.average_content_length_chars == 0.0 and none.validity_ratio == 0.0


def test_reach_and_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "url string, target string")
    got = {r.url: r.depth for r in corpus.reach(edges, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    pages = spark.createDataFrame([("http://h.org/a/", '<a href="/b">x</a><a href="http://evil.com/c">y</a>'), ("http://h.org/b", ""), ("http://evil.com/c", "")], "url string, html string")
    seeds = spark.createDataFrame([("http://H.org/a", "en", "n", "k", ["h.org"])], "url string, language_hint string, source_name string, category_hint string, allowed_domains array<string>")
    assert {(r.url, r.depth, r.language_hint) for r in corpus.crawl(pages, seeds, 2).collect()} == {("http://h.org/a", 0, "en"), ("http://h.org/b", 1, "en")}


def test_engine_round_trip(spark, tmp_path):
    texts = ["heart attack symptoms", "migraine headache relief", "insulin and diabetes", None, ""]
    docs = _docs(spark, [(k, f"title {k}" if k < 3 else None, t, "s", f"u{k}", "k", "en") for k, t in enumerate(texts)] + [(None, "t", "c", "s", "u", "k", "en"), (0, "dup", "later copy", "s", "uz", "k", "en")])
    encoder = vector.HashEncoder(32)
    engine = retrieve.Engine.build(docs, encoder)
    queries = spark.createDataFrame([(1, "Heart symptoms"), (2, "diabetes"), (3, "  ")], "query_id long, raw string")
    for strategy in ("rrf", "weighted"):
        got = engine.retrieve(queries, 3, strategy).filter("rank = 1").collect()
        assert {r.query_id: r.doc_id for r in got} == {1: 0, 2: 2}
    engine.save(f"{tmp_path}/index")
    loaded = retrieve.Engine.load(spark, f"{tmp_path}/index", encoder)
    assert sorted(map(tuple, loaded.retrieve(queries, 3).collect())) == sorted(map(tuple, engine.retrieve(queries, 3).collect()))
    more = loaded.add(_docs(spark, [(0, "t", "ignored", "s", "u", "k", "en"), (9, "new", "cardiac heart arrest", "s", "u9", "k", "en")]))
    assert 9 in {r.doc_id for r in more.lexical(retrieve.preprocess(queries)).collect()}
    assert engine.similar(spark.createDataFrame([(0,)], "doc_id long"), 2).filter("doc_id = 0").count() == 0
    with pytest.raises(RuntimeError, match="missing"):
        retrieve.Engine.load(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        retrieve.Engine.build(docs.limit(0), encoder)


def test_enrich_fallback_and_response(spark):
    hits = _hits(spark, [(1, 5, 0.123456789, 1), (1, 77, 0.1, 2)])
    docs = _docs(spark, [(5, "t", "x" * 301, "s", "u", "k", "en")])
    out = retrieve.enrich(hits, docs).orderBy("rank").collect()
    assert out[0].score == 0.123457 and out[0].snippet.endswith("...") and (out[1].title, out[1].snippet, out[1].url) == ("Unknown", "", "")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    flags = retrieve.needs_fallback(hits, asked)
    assert {r.query_id: r.web_fallback for r in flags.collect()} == {1: True, 2: True}
    assert retrieve.respond(retrieve.enrich(hits, docs), flags).filter("query_id = 1").first().results[0].doc_id == 5
    e = retrieve.evaluate(hits, spark.createDataFrame([(1, 77)], "query_id long, doc_id long"), 2).first()
    assert (e.precision, e.recall, e.mrr) == (0.5, 1.0, 0.5) and e.ndcg == pytest.approx(1 / math.log2(3))


def test_sources(spark, tmp_path):
    where = tmp_path / "p" / "en" / "x"
    where.mkdir(parents=True)
    rows = [{"id": 1, "title": "t", "content": "c", "url": "http://h/es/", "fetched_at": "2024-01-01"}, {"id": 1, "title": "new", "content": "c2", "url": "http://h/", "fetched_at": "2025-01-01"}, {"title": "no id", "content": "z"}]
    for k, r in enumerate(rows):
        (where / f"doc_{k}.json").write_text(json.dumps(r))
    (where / "bad.json").write_text("{nope")
    good, errors = tables.to_index(spark, str(tmp_path / "p"))
    assert good.count() == 2 and errors.first()[0] == 1
    assert {r.language for r in tables.documents(spark, str(tmp_path / "p")).collect()} == {"es", "en"}
    assert tables.document_store(spark, str(tmp_path / "p")).first().title == "new"
    docs = _docs(spark, [(1, "t", "c", "s", "u", "k", "en")])
    tables.write_documents(docs, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").filter("language = 'en' AND category = 'k'").count() == 1
    for _ in range(2):
        tables.write_rejected(docs.withColumn("reason", F.lit("r")), f"{tmp_path}/rej")
    assert spark.read.parquet(f"{tmp_path}/rej").count() == 2
    tables.write_by_category(gate.legacy_enrich(_docs(spark, [(1, "t", "x" * 120, "ncbi.nlm.nih.gov", "u", None, None), (2, "", "", "s", "u", None, None)])), f"{tmp_path}/v", f"{tmp_path}/i")
    assert spark.read.json(f"{tmp_path}/v").first().category == "unknown" and spark.read.json(f"{tmp_path}/i").first().rejection_reason == "Field 'title' cannot be empty"


def test_stream_ingest(spark, tmp_path):
    from sievemill.streaming.ingest import ingest

    text = "c" * 600
    rows = [(1, "t", text + " a", "s", "u1", "k", "en"), (2, "t", text + " A", "s", "u2", "k", "en")]
    schema = _docs(spark, rows).schema
    for part in (rows, [(3, "t", text + " a", "s", "u3", "k", "en"), (4, "t", text + " b", "s", "u4", "k", "en")]):
        _docs(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", f"{tmp_path}/r", f"{tmp_path}/k").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/c").collect()) == [1, 4]
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2


def test_a_batch_that_runs_again_stores_nothing_twice(spark, tmp_path):
    import shutil

    from sievemill.streaming.ingest import ingest

    text = "c" * 600
    rows = [(1, "t", text + " a", "s", "u1", "k", "en"), (2, "t", text + " A", "s", "u2", "k", "en"), (3, "t", "short", "s", "u3", "k", "en")]
    _docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has lost its checkpoint, so it is batch 0 again
        ingest(spark.readStream.schema(_docs(spark, rows).schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", f"{tmp_path}/r", f"{tmp_path}/k").awaitTermination()
        shutil.rmtree(f"{tmp_path}/k")
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/c").collect()] == [1]
    assert sorted((r.id, r.reason) for r in spark.read.parquet(f"{tmp_path}/r").collect()) == [(2, "duplicate_content"), (3, "content_too_short")]


def test_small_tables_are_spread_over_cores(spark, tmp_path):
    from sievemill.scratch import spread

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(1000).repartition(9).write.parquet(f"{tmp_path}/nine")
    assert spread(spark.read.parquet(f"{tmp_path}/one")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    nine = spark.read.parquet(f"{tmp_path}/nine")
    assert spread(nine) is nine
