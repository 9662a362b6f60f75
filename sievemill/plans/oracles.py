"""DuckDB SQL that gives the same rows as the registered queries, over views named like the tables."""

from __future__ import annotations

from ..functions import html as page
from ..functions import language as lang
from ..functions import text as tx
from ..functions import urls
from ..operators import gate


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_s(w) for w in words) + "]"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"


def normalize(x: str) -> str:
    return clean(rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g')")


def tokens(x: str) -> str:
    return f"list_filter(string_split({normalize(x)}, ' '), lambda w: length(w) > 1 AND NOT list_contains({_list(tx.STOPWORDS)}, w))"


def strip_tags(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '(?is)<(script|style)[^>]*>.*?</\s*(script|style)\s*>', ' ', 'g'), '(?s)<!--.*?-->|</?[a-zA-Z][^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = f"replace({bare}, {_s(a)}, {_s(b)})"
    return f"CASE WHEN contains(coalesce({x}, ''), '<') OR contains(coalesce({x}, ''), '&') THEN {bare} ELSE coalesce({x}, '') END"


def fingerprint(x: str) -> str:
    return rf"sha1(trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')))"


def detect(x: str, hint: str | None = None) -> str:
    words = rf"string_split(regexp_replace(lower(coalesce({x}, '')), '[\s\p{{Z}}]+', ' ', 'g'), ' ')"
    n = [f"len(list_filter({words}, lambda w: list_contains({_list(m)}, w)))" for m in (lang.ENGLISH, lang.SPANISH)]
    out = f"CASE WHEN {n[0]} = 0 AND {n[1]} = 0 THEN 'unknown' WHEN {n[0]} >= {n[1]} THEN 'en' ELSE 'es' END"
    return out if hint is None else f"CASE WHEN {hint} IN ('en', 'es') THEN {hint} ELSE {out} END"


def _scheme(u: str) -> str:
    return f"lower(regexp_extract(trim({u}), '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"


def _netloc(u: str) -> str:
    return f"lower(regexp_extract(trim({u}), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1))"


def _path(u: str) -> str:
    return f"regexp_extract(trim({u}), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def host(u: str) -> str:
    return rf"regexp_replace(regexp_replace({_netloc(u)}, '^.*@', ''), ':\d*$', '')"


def normal_url(u: str, empty: str = "/") -> str:
    path = f"regexp_replace(regexp_replace({_path(u)}, ';[^/]*$', ''), '/+$', '')"
    root = "'/'" if empty else f"CASE WHEN {_path(u)} = '/' THEN '/' ELSE '' END"
    query = rf"regexp_extract(trim({u}), '^[^?#]*(\?[^#]*)', 1)"
    return f"{_scheme(u)} || '://' || {_netloc(u)} || CASE WHEN {path} = '' THEN {root} ELSE {path} END || CASE WHEN {query} = '?' THEN '' ELSE {query} END"


def in_domain(u: str, d: str) -> str:
    return f"({host(u)} = {d} OR ends_with({host(u)}, '.' || {d}))"


def _text(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in page.REFERENCES:
        out = f"replace({out}, {_s(a)}, {_s(b)})"
    return clean(out)


def without_noise(x: str) -> str:
    out = f"coalesce({x}, '')"
    for t in page.NOISE:
        out = rf"regexp_replace({out}, '(?is)<{t}(\s[^>]*)?>.*?</{t}\s*>', ' ', 'g')"
    return f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"


def _element(t: str) -> tuple[str, str]:
    return rf"regexp_matches(bare, '(?is)<{t}(\s[^>]*)?>')", _text(rf"regexp_extract(bare, '(?is)<{t}(?:\s[^>]*)?>(.*?)(?:</{t}\s*>|\z)', 1)")


def first_of(enough: int | None = page.ENOUGH) -> str:
    """Over a column ``bare``."""
    parts = [_element(t) for t in page.DEFAULT_SELECTORS]
    if enough is None:
        return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in parts) + " ELSE '' END"
    long = " ".join(f"WHEN {a} AND length({b}) > {enough} THEN {b}" for a, b in parts)
    last = " ".join(f"WHEN {a} THEN {b}" for a, b in reversed(parts))
    return f"CASE {long} {last} ELSE '' END"


TITLE = _text("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")
_HREF = "h"
for _a, _b in page.REFERENCES:
    _HREF = f"replace({_HREF}, {_s(_a)}, {_s(_b)})"
_HREFS = r"""list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), lambda h: trim(%s)), lambda h: h <> '')""" % _HREF
LINKS = f"""(SELECT DISTINCT page_id, url, link FROM (SELECT page_id, url, regexp_replace(CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || h ELSE h END, '#.*$', '') AS link
    FROM (SELECT page_id, url, unnest({_HREFS}) AS h FROM pages)) WHERE starts_with(link, 'http'))"""
EDGES = f"(SELECT DISTINCT {normal_url('url')} AS url, {normal_url('link')} AS target FROM {LINKS} WHERE regexp_matches(link, '(?i)^https?://[^/?#]+'))"


def category(source: str, content: str) -> str:
    parts = [f"WHEN contains(lower({source}), {_s(d)}) THEN {_s(c)}" for d, c in gate.DOMAIN_CATEGORIES]
    parts += [f"WHEN regexp_matches(lower({content}), {_s('|'.join(w))}) THEN {_s(c)}" for c, w in gate.KEYWORD_CATEGORIES]
    return "CASE " + " ".join(parts) + " ELSE 'generic_content' END"


DOCS = f"""(SELECT doc_id AS id, substring(text, 1, 60) AS title, text AS content, source, 'https://' || source || '.example.org/' || doc_id AS url,
    {category('source', 'text')} AS category, lang AS language FROM documents)"""


def reason() -> str:
    parts = [f"WHEN {f} IS NULL OR {clean(f)} = '' THEN 'missing_or_empty_{f}'" for f in gate.FIELDS]
    return "CASE " + " ".join(parts) + f" WHEN language NOT IN ('en', 'es') THEN 'invalid_language' WHEN length(content) < {gate.MIN_CHARS} THEN 'content_too_short' END"


def _legacy_error() -> str:
    parts = [f"WHEN {f} IS NULL THEN {_s(chr(77) + 'issing required field: ' + chr(39) + f + chr(39))}" for f in ("title", "content", "source", "url")]
    parts += [f"WHEN {clean(f)} = '' THEN {_s('Field ' + chr(39) + f + chr(39) + ' cannot be empty')}" for f in ("title", "content", "url")]
    return "CASE " + " ".join(parts) + " WHEN length(content) < 100 THEN 'Content too short (' || length(content) || ' chars, min 100)' END"


_TOKENS = f"tok AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS tokens FROM documents)"
_TITLED = f"tok AS MATERIALIZED (SELECT id AS doc_id, {tokens(strip_tags("title || '. ' || content"))} AS tokens FROM {DOCS})"
_STATS = """,
    tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
    dl AS MATERIALIZED (SELECT doc_id, CAST(len(tokens) AS BIGINT) AS dl FROM tok),
    size AS MATERIALIZED (SELECT count(*) AS nd, avg(dl) AS avgdl FROM dl),
    raw AS MATERIALIZED (SELECT term, count(*) AS n, ln(any_value(nd) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf0 FROM tf, size GROUP BY term),
    terms AS MATERIALIZED (SELECT term, n, CASE WHEN idf0 < 0 THEN 0.25::DOUBLE * (SELECT avg(idf0) FROM raw) ELSE idf0 END AS idf FROM raw)"""
_INDEX = _TOKENS + _STATS


def _rank(frm: str, k: int, score: str = "score") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, doc_id) AS rank FROM {frm}) WHERE rank <= {k})"


def _lexical(k: int = 50, ask: str = f"SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark", index: str = _INDEX) -> str:
    """CTEs that end in lex: (query_id, doc_id, score, rank)."""
    return f"""{index}, ask AS (SELECT query_id, term, count(*) AS qf FROM ({ask}) GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
        FROM ask JOIN tf USING (term) JOIN terms USING (term) JOIN dl USING (doc_id), size GROUP BY ALL),
    lex AS MATERIALIZED (SELECT * FROM {_rank('(SELECT * FROM scored WHERE score > 0)', k)})"""


def _semantic(k: int = 50) -> str:
    """CTEs that end in sem: (query_id, doc_id, d2, score, rank)."""
    return f"""vec AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS len FROM embeddings),
    near AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, greatest(0.0::DOUBLE, 2.0::DOUBLE - 2.0::DOUBLE * list_dot_product(q.v, x.v) / (q.len * x.len)) AS d2
        FROM benchmark JOIN vec q ON q.vec_id = item_id, vec x),
    sem AS MATERIALIZED (SELECT * FROM {_rank('(SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + d2) AS score FROM near)', k)})"""


def _minmax(lane: str) -> str:
    return f"(SELECT query_id, doc_id, rank, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE max(score) OVER w - min(score) OVER w END AS score FROM {lane} WINDOW w AS (PARTITION BY query_id))"


_RRF = "(SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM lex UNION ALL SELECT query_id, doc_id, rank FROM sem) GROUP BY ALL)"
_WEIGHTED = f"(SELECT query_id, doc_id, sum(score) AS score FROM (SELECT query_id, doc_id, score * 0.3::DOUBLE AS score FROM {_minmax('lex')} UNION ALL SELECT query_id, doc_id, score * 0.7::DOUBLE FROM {_minmax('sem')}) GROUP BY ALL)"


def _hits(ctes: str, frm: str) -> str:
    return f"WITH {ctes} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM {frm}"


_OLD = f"(SELECT 'https://src0.example.org/' || item_id AS url_key, {fingerprint('text')} AS fp FROM benchmark)"
_ONE = f"SELECT 0::BIGINT AS query_id, unnest({tokens(_s('the treatment of thonerha and ertion, the ertion'))}) AS term"

ORACLES: dict[str, str] = {
    "whitespace_clean": f"SELECT doc_id, {clean('text')} AS clean_text FROM documents",
    "text_normalize": f"SELECT doc_id, {normalize('text')} AS normalized FROM documents",
    "lexical_tokens": f"WITH {_TOKENS} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, tokens[1] AS first_token, tokens[-1] AS last_token FROM tok",
    "semantic_text": f"SELECT conv_id, turn, {clean(strip_tags('text'))} AS semantic FROM conversations",
    "indexed_text": f"SELECT id, sha1(title || '. ' || content) AS digest FROM {DOCS}",
    "snippets": f"SELECT id, CASE WHEN length(content) > 300 THEN substring(content, 1, 300) || '...' ELSE content END AS snippet, substring(content, 1, 200) || '...' AS api_snippet FROM {DOCS}",
    "content_fingerprint": f"SELECT doc_id, {fingerprint('text')} AS fingerprint FROM documents",
    "dup_content_groups": f"SELECT {fingerprint('text')} AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "detect_language_markers": f"SELECT doc_id, {detect('text')} AS detected, {detect('text', 'lang')} AS with_hint FROM documents",
    "detect_language_turns": f"SELECT role, {detect('text')} AS detected, count(*) AS n FROM conversations GROUP BY 1, 2",
    "language_from_url": f"SELECT page_id, CASE WHEN contains({_path('lower(url)')}, '/es/') OR contains({_path('lower(url)')}, '/spanish/') OR contains(lower(url), 'lang=es') THEN 'es' ELSE 'en' END AS language FROM pages",
    "url_normalize": f"SELECT page_id, {normal_url('url')} AS normalized FROM pages",
    "url_normalize_keep_empty_path": f"SELECT page_id, {normal_url('url', '')} AS normalized FROM pages",
    "url_checks": f"SELECT page_id, regexp_matches(trim(url), '(?i)^https?://[^/?#]+') AS http, regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') AS valid, {host('url')} AS host FROM pages",
    "url_allowed": f"SELECT page_id, {in_domain('url', _s('example.com'))} OR {in_domain('url', _s('example.org'))} AS allowed, {in_domain('url', _s('example.net'))} AS in_net FROM pages",
    "same_domain_bidirectional": f"SELECT page_id, h = 'blog.thre.example.com' OR ends_with(h, '.blog.thre.example.com') OR ends_with('blog.thre.example.com', '.' || h) AS below, h = 'example.com' OR ends_with(h, '.example.com') OR ends_with('example.com', '.' || h) AS above FROM (SELECT page_id, {host('url')} AS h FROM pages)",
    "url_encode_seeds": f"SELECT item_id, {_s(urls.SEARCHES[0])} || q AS first_seed, {_s(urls.SEARCHES[1])} || q AS second_seed FROM (SELECT item_id, replace(url_encode(lower(text)), '%20', '+') AS q FROM benchmark)",
    "html_title": f"SELECT page_id, {TITLE} AS title FROM pages",
    "html_content_regex": f"SELECT page_id, {first_of()} AS content FROM (SELECT page_id, {without_noise('html')} AS bare FROM pages)",
    "html_content_legacy": f"SELECT page_id, content, source, {category('source', 'content')} AS category FROM (SELECT page_id, lower({first_of(None)}) AS content, {host('url')} AS source FROM (SELECT page_id, url, {without_noise('html')} AS bare FROM pages))",
    "html_links": f"SELECT page_id, link FROM {LINKS}",
    "html_link_counts": f"SELECT page_id, CAST(count(link) AS BIGINT) AS n_links FROM pages LEFT JOIN {LINKS} USING (page_id) GROUP BY page_id",
    "link_indegree": f"SELECT target, count(*) AS indegree FROM {EDGES} GROUP BY target",
    "bfs_reachability": f"""WITH RECURSIVE edges AS MATERIALIZED (SELECT * FROM {EDGES}),
        walk AS (SELECT DISTINCT {normal_url('url')} AS url, 0::BIGINT AS depth FROM pages WHERE contains({normal_url('url')}, '/en/')
                 UNION SELECT target, depth + 1 FROM walk JOIN edges ON edges.url = walk.url WHERE depth < 3)
        SELECT url, min(depth) AS depth FROM walk GROUP BY url""",
    "gate_reasons": f"SELECT id, {reason()} AS reason FROM {DOCS}",
    "gate_reason_histogram": f"SELECT coalesce({reason()}, 'accepted') AS reason, count(*) AS n FROM {DOCS} GROUP BY 1",
    "dedupe_first_wins": f"SELECT min(doc_id) AS doc_id, {fingerprint('text')} AS fingerprint FROM documents GROUP BY 2",
    "anti_existing": f"SELECT id, CASE WHEN lower(trim(url)) IN (SELECT url_key FROM {_OLD}) THEN 'duplicate_url' WHEN {fingerprint('content')} IN (SELECT fp FROM {_OLD}) THEN 'duplicate_content' END AS reason FROM {DOCS}",
    "full_gate": f"""WITH checked AS (SELECT id, {reason()} AS own, {fingerprint('content')} AS fp FROM {DOCS})
        SELECT id, coalesce(own, CASE WHEN row_number() OVER (PARTITION BY own, fp ORDER BY id) > 1 THEN 'duplicate_content' END) AS reason FROM checked""",
    "language_quota": "SELECT doc_id AS id, CASE lang WHEN 'en' THEN turn > 251 WHEN 'es' THEN turn > 101 ELSE false END AS over_quota FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents)",
    "early_stop_prefix": """WITH run AS (SELECT doc_id, lang, count(*) OVER w AS n, coalesce(sum(CAST(lang = 'en' AS INT)) OVER w, 0) AS en, coalesce(sum(CAST(lang = 'es' AS INT)) OVER w, 0) AS es
            FROM documents WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        stop AS (SELECT min(doc_id) AS stop_at FROM run WHERE n >= 300 AND en >= 120 AND es >= 20)
        SELECT doc_id AS id, lang AS language FROM run, stop WHERE stop_at IS NULL OR doc_id < stop_at""",
    "id_allocation": "SELECT doc_id, 1000 + row_number() OVER (ORDER BY doc_id) AS new_id FROM documents",
    "category_infer": f"SELECT id, category FROM {DOCS}",
    "legacy_validate": f"SELECT id, error IS NULL AS is_valid, error AS validation_error, CASE WHEN error IS NULL THEN {category('source', 'content')} END AS category FROM (SELECT *, {_legacy_error()} AS error FROM {DOCS})",
    "indexability_filter": f"""WITH t AS (SELECT id, title, content, {tokens(strip_tags("title || '. ' || content"))} AS tk, {clean(strip_tags("title || '. ' || content"))} AS sem FROM {DOCS})
        SELECT id, CAST(len(tk) > 0 OR sem <> '' AS BIGINT) AS batch, CAST(title <> '' AND content <> '' AND len(tk) > 0 AND sem <> '' AS BIGINT) AS appended FROM t WHERE len(tk) > 0 OR sem <> ''""",
    "corpus_metrics": f"""WITH c AS (SELECT *, {reason()} AS reason FROM {DOCS}), g AS (SELECT * FROM c WHERE reason IS NULL)
        SELECT (SELECT count(*) FROM g) AS total_valid_documents, (SELECT count(*) FROM c WHERE reason IS NOT NULL) AS total_rejected_documents,
            (SELECT round(CAST(count(*) FILTER (reason IS NULL) AS DOUBLE) / greatest(1, count(*)), 4) FROM c) AS validity_ratio, (SELECT coalesce(round(avg(length(content)), 2), 0.0::DOUBLE) FROM g) AS average_content_length_chars,
            (SELECT round(count(*)::DOUBLE, 2) FROM g) AS docs_per_minute, """ + ", ".join(f"""(SELECT string_agg({k} || '=' || n, ';' ORDER BY {k}) FROM (SELECT {k}, count(*) AS n FROM g GROUP BY 1)) AS by_{k}""" for k in ("language", "source", "category")) + """,
            (SELECT string_agg(id || '|' || title || '|' || url, ';' ORDER BY id) FROM (SELECT * FROM g ORDER BY id LIMIT 5)) AS examples""",
    "distribution_grouping_sets": f"""SELECT 'language' AS dimension, language AS value, count(*) AS n FROM {DOCS} GROUP BY 2
        UNION ALL SELECT 'source', source, count(*) FROM {DOCS} GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM {DOCS} GROUP BY 2""",
    "term_frequencies": f"WITH {_INDEX} SELECT doc_id, term, tf FROM tf",
    "idf_table": f"WITH {_INDEX} SELECT term, n, round(idf, 6) AS idf FROM terms",
    "corpus_stats": f"WITH {_INDEX} SELECT nd, round(avgdl, 6) AS avgdl, round((SELECT avg(idf0) FROM raw), 6) AS avg_idf FROM size",
    "bm25_batch_topk": _hits(_lexical(), "lex"),
    "bm25_single_query": _hits(_lexical(10, _ONE), "lex"),
    "postings_append": f"WITH {_INDEX} SELECT term, n, round(idf, 6) AS idf FROM terms",
    "l2_normalize": "WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v, greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS len FROM embeddings) SELECT vec_id AS doc_id, round(v[1] / len, 6) AS first, round(v[-1] / len, 6) AS last, round(sqrt(list_dot_product(v, v)) / len, 6) AS length FROM u",
    "knn_batch": f"WITH {_semantic()} SELECT query_id, rank, doc_id, round(d2, 6) AS d2, round(score, 6) AS score FROM sem",
    "find_similar": _hits(_semantic(11), _rank("(SELECT query_id, doc_id, score FROM sem WHERE query_id <> doc_id)", 10)),
    "minmax_lexical": _hits(_lexical(), _minmax("lex")),
    "minmax_semantic": _hits(_semantic(), _minmax("sem")),
    "rrf_fusion": _hits(f"{_lexical()}, {_semantic()}", _rank(_RRF, 10)),
    "weighted_fusion": _hits(f"{_lexical()}, {_semantic()}", _rank(_WEIGHTED, 10)),
    "hybrid_enriched": f"""WITH {_lexical()}, {_semantic()} SELECT query_id, rank, doc_id, round(score, 6) AS score, coalesce(title, 'Unknown') AS title,
        CASE WHEN length(content) > 300 THEN substring(content, 1, 300) || '...' ELSE coalesce(content, '') END AS snippet, coalesce(source, 'Unknown') AS source, coalesce(url, '') AS url
        FROM {_rank(_RRF, 10)} LEFT JOIN {DOCS} AS d ON d.id = doc_id""",
    "lexical_only": _hits(_lexical(10), "lex"),
    "semantic_only": _hits(_semantic(10), "sem"),
    "get_texts": "SELECT doc_id, sha1(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "fallback_flag": f"""WITH {_lexical()}, {_semantic()}, best AS (SELECT query_id, count(*) AS n, max(score) AS best FROM {_rank(_WEIGHTED, 10)} GROUP BY query_id)
        SELECT item_id AS query_id, coalesce(n, 0) < 2 OR coalesce(best, 0) < 0.72 AS web_fallback FROM benchmark LEFT JOIN best ON query_id = item_id""",
    "eval_at_k": f"""WITH {_lexical(10)}, hold AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), total AS (SELECT query_id, count(*) AS n FROM hold GROUP BY 1),
        per AS (SELECT lex.query_id, sum(CAST(hold.doc_id IS NOT NULL AS INT)) AS found, max(CASE WHEN hold.doc_id IS NOT NULL THEN 1.0::DOUBLE / rank ELSE 0 END) AS mrr, sum(CASE WHEN hold.doc_id IS NOT NULL THEN 1.0::DOUBLE / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg
            FROM lex LEFT JOIN hold ON hold.query_id = lex.query_id AND hold.doc_id = lex.doc_id GROUP BY 1)
        SELECT query_id, round(coalesce(found, 0) / 10.0::DOUBLE, 6) AS precision, round(coalesce(found, 0) / n::DOUBLE, 6) AS recall, round(coalesce(mrr, 0), 6) AS mrr,
            round(coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(least(n, 10) AS BIGINT) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 6) AS ndcg FROM total LEFT JOIN per USING (query_id)""",
    "fuse_dispatch": f"""WITH {_lexical()}, {_semantic()} SELECT query_id, rank, doc_id, round(score, 6) AS score, 'rrf' AS strategy FROM {_rank(_RRF, 10)}
        UNION ALL SELECT query_id, rank, doc_id, round(score, 6), 'weighted' FROM {_rank(_WEIGHTED, 10)}""",
    "vector_dimensions": "SELECT vec_id AS doc_id, CAST(len(embedding) AS BIGINT) AS components FROM embeddings",
    "concept_axes": """WITH a AS (SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'and') AS x, contains(lower(text), 'der') OR contains(lower(text), 'die') OR contains(lower(text), 'das') AS y FROM documents)
        SELECT doc_id, CAST(x AS DOUBLE) AS axis_0, CAST(y AS DOUBLE) AS axis_1, CAST(NOT x AND NOT y AS DOUBLE) AS axis_2, 0.0::DOUBLE AS axis_3 FROM a""",
    "blank_queries": f"""SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'query is empty' END AS error, true AS web_fallback, CASE WHEN item_id % 4 <> 0 THEN CAST(len({tokens(strip_tags('text'))}) AS BIGINT) ELSE 0 END AS n_tokens FROM benchmark""",
    "robots_allowed": f"SELECT page_id, NOT (ends_with({host('url')}, 'example.org') AND starts_with({_path('url')}, '/fr/')) AS allowed FROM pages",
    "documents_round_trip": f"SELECT language, category, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, min(id) AS first_id FROM {DOCS} GROUP BY 1, 2",
    "rejected_round_trip": f"SELECT reason, count(*) AS n, max(id) AS last_id FROM (SELECT id, {reason()} AS reason FROM {DOCS}) WHERE reason IS NOT NULL GROUP BY 1",
    "category_sink": f"""WITH t AS (SELECT {_legacy_error()} AS error, {category('source', 'content')} AS category FROM {DOCS}),
        known AS (SELECT CASE WHEN category IN ({', '.join(_s(c) for c in gate.STORED_CATEGORIES)}) THEN category ELSE 'unknown' END AS category FROM t WHERE error IS NULL)
        SELECT category, NULL::VARCHAR AS error, count(*) AS n FROM known GROUP BY 1 UNION ALL SELECT NULL, error, count(*) FROM t WHERE error IS NOT NULL GROUP BY 2""",
    "raw_round_trip": f"SELECT {host('url')} AS source, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1",
    "dedupe_two_key_exact": f"""WITH RECURSIVE keyed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS turn, doc_id AS seq, source || '/' || (doc_id * 7919 % 97) AS u, {fingerprint('text')} AS f FROM documents),
        walk AS (SELECT 0::BIGINT AS turn, NULL::BIGINT AS seq, NULL::VARCHAR AS reason, []::VARCHAR[] AS us, []::VARCHAR[] AS fs
            UNION ALL SELECT k.turn, k.seq, v.reason, CASE WHEN v.reason IS NULL THEN list_append(us, k.u) ELSE us END, CASE WHEN v.reason IS NULL THEN list_append(fs, k.f) ELSE fs END
            FROM walk JOIN keyed k ON k.turn = walk.turn + 1, LATERAL (SELECT CASE WHEN list_contains(us, k.u) THEN 'duplicate_url' WHEN list_contains(fs, k.f) THEN 'duplicate_content' END AS reason) v)
        SELECT seq, reason FROM walk WHERE turn > 0""",
}
ORACLES["html_content_parser"] = f"SELECT page_id, {TITLE} AS title, {first_of()} AS content FROM (SELECT page_id, html, {without_noise('html')} AS bare FROM pages)"


def _answers(more: str) -> str:
    """An engine's answers to the items, over the documents that ``more`` chooses."""
    vec = _semantic().replace("FROM embeddings)", f"FROM embeddings JOIN (SELECT id FROM {DOCS}) ON id = vec_id)", 1)
    near = vec.replace("FROM benchmark JOIN vec q ON q.vec_id = item_id, vec x)", "FROM benchmark JOIN (SELECT vec_id, embedding::DOUBLE[] AS v, greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS len FROM embeddings) q ON q.vec_id = item_id, vec x)")
    ask = f"SELECT item_id AS query_id, unnest({tokens(strip_tags('text'))}) AS term FROM benchmark"
    index = f"all_{_TITLED}, tok AS MATERIALIZED (SELECT * FROM all_tok WHERE {more})" + _STATS
    return f"""WITH {_lexical(50, ask, index)}, {near} SELECT query_id, rank, doc_id, round(score, 6) AS score, title, source FROM {_rank(_WEIGHTED, 5)} JOIN {DOCS} AS d ON d.id = doc_id"""


ORACLES["engine_round_trip"] = _answers("true")
ORACLES["engine_append"] = _answers("doc_id < 150 OR len(tokens) > 0")
_SEEDED = f"(SELECT {normal_url('url')} AS url FROM pages WHERE {in_domain('url', _s('example.org'))} AND contains(url, '/en/'))"
_NEXT = f"SELECT DISTINCT target AS url FROM {EDGES} e JOIN {{0}} USING (url) WHERE {in_domain('target', _s('example.org'))}"
ORACLES["crawl_hints"] = f"""WITH own AS MATERIALIZED (SELECT DISTINCT {normal_url('url')} AS url FROM pages), zero AS MATERIALIZED (SELECT DISTINCT url FROM {_SEEDED}),
    one AS MATERIALIZED (SELECT * FROM ({_NEXT.format('zero')}) WHERE url NOT IN (SELECT url FROM zero)), two AS MATERIALIZED (SELECT * FROM ({_NEXT.format('one')}) WHERE url NOT IN (SELECT url FROM zero UNION SELECT url FROM one)),
    found AS (SELECT 0::BIGINT AS depth, url FROM zero UNION ALL SELECT 1, url FROM one UNION ALL SELECT 2, url FROM two)
    SELECT depth, 'en' AS language_hint, 'news' AS category_hint, count(*) AS n, min(url) AS first_url FROM found WHERE url IN (SELECT url FROM own) GROUP BY depth"""
ORACLES["stream_ingest"] = f"SELECT id, coalesce(reason, 'accepted') AS verdict FROM ({ORACLES['full_gate']})"
