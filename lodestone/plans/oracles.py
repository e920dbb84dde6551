"""SQL for DuckDB that gives the rows of the registered queries, written from the definitions."""

from __future__ import annotations

from lodestone.functions.text import STOPWORDS
from lodestone.plans.queries import DOMAIN, FILTERS, K, NOW, QUERY

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def cleaned(c: str) -> str:
    for pattern, to in (
        (r"(?s)\{\{.*?\}\}", " "),
        (r"(?s)<ref.*?>.*?</ref>", " "),
        (r"<.*?>", " "),
        (r"http\S+", " "),
        (r"\[\[.*?\|(.*?)\]\]", r"\1"),
        (r"\[\[(.*?)\]\]", r"\1"),
        (r"={2,}.*?={2,}", " "),
        (r"[^a-zA-Z0-9\s]", " "),
        (r"\s+", " "),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c})"


def words(c: str) -> str:
    return f"list_filter(string_split(lower({c}), ' '), lambda t: t <> '' AND t NOT IN ({STOP}))"


def units(x: str, bits: int = 16) -> str:
    return f"CAST(round_even(CAST({x} AS DOUBLE) * {1 << bits}, 0) AS BIGINT)"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


COSINE = f"({dot('e.embedding', 'q.embedding')} / (sqrt({dot('e.embedding', 'e.embedding')}) * sqrt({dot('q.embedding', 'q.embedding')})))"
TITLE = "string_split(coalesce(text, ''), chr(10))[1]"
INDEX = f"""
    tok AS (SELECT doc_id, {words(cleaned("coalesce(text, '')"))} AS w FROM documents),
    ttok AS (SELECT doc_id, {words(cleaned(TITLE))} AS w FROM documents),
    post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL),
    tpost AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM ttok) GROUP BY ALL),
    len AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS dl FROM tok WHERE len(w) > 0),
    st AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM len)"""
DF = "dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), tdfs AS (SELECT term, count(*) AS df FROM tpost GROUP BY term)"


def asked(query: str = "", batch: bool = False) -> str:
    source = "(SELECT item_id AS qid, text AS query FROM benchmark)" if batch else query if query.startswith("(") else f"(SELECT CAST(0 AS BIGINT) AS qid, '{query or QUERY}' AS query)"
    return f"""
    qtok AS (SELECT qid, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT qid, {words(cleaned("query"))} AS w FROM {source})),
    q AS (SELECT qid, term, count(*) AS qtf, min(pos) AS qpos FROM qtok GROUP BY ALL)"""


IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
BODY = f"""body AS (
        SELECT qid, p.doc_id, sum(qtf * {IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * coalesce(dl, 0) / avgdl))) AS score, min(qpos) AS qpos
        FROM q JOIN post p USING (term) JOIN dfs USING (term) LEFT JOIN len ON len.doc_id = p.doc_id, st GROUP BY qid, p.doc_id)"""
TITLES = f"""titles AS (
        SELECT qid, doc_id, sum(qtf * {IDF} * tf * 2.5 / (tf + 1.5)) AS score, min(qpos) AS qpos
        FROM q JOIN tpost USING (term) JOIN tdfs USING (term), st GROUP BY qid, doc_id)"""
BOTH = """hits AS (
        SELECT qid, doc_id, sum(score) AS score, min(title_only) AS title_only, min(qpos) AS qpos
        FROM (SELECT qid, doc_id, score, 0 AS title_only, qpos FROM body UNION ALL SELECT qid, doc_id, 3.0 * score, 1, qpos FROM titles) GROUP BY qid, doc_id)"""


def lexical(query: str = "", batch: bool = False) -> str:
    return f"WITH {INDEX}, {DF}, {asked(query, batch)}, {BODY}, {TITLES}, {BOTH}"


ORDER = f"ORDER BY {units('score')} DESC, title_only, qpos, doc_id"
PLAIN = f"ORDER BY {units('score')} DESC, doc_id"
RANKED = f"CAST(row_number() OVER (PARTITION BY qid {ORDER}) AS BIGINT) AS rank"
QV = "qv AS (SELECT embedding FROM embeddings WHERE vec_id = 7)"
IP = f"ip AS (SELECT e.vec_id AS doc_id, {dot('e.embedding', 'q.embedding')} AS score FROM embeddings e, qv q)"
COS = f"cosines AS (SELECT e.vec_id AS doc_id, round({COSINE}, 9) AS score FROM embeddings e, qv q)"
GEOMETRY = f"""
    dims AS (SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, 65)) AS t(k) GROUP BY ALL),
    mean AS (SELECT label, list(m ORDER BY k) AS mean FROM dims GROUP BY label),
    centre AS (SELECT label, list_transform(mean, lambda x: x / (sqrt({dot('mean', 'mean')}) + 1e-10)) AS centroid FROM mean),
    geo AS (
        SELECT e.label AS file_path, count(*) AS doc_count, any_value(centroid) AS centroid,
            max(sqrt(list_sum(list_transform(list_zip(embedding, centroid), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) ** 2)))) AS radius
        FROM embeddings e JOIN centre c USING (label) GROUP BY e.label),
    unit AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (sqrt({dot('embedding', 'embedding')}) + 1e-10)) AS u FROM qv),
    away AS (SELECT file_path, radius, sqrt(list_sum(list_transform(list_zip(u, centroid), lambda z: (z[1] - z[2]) ** 2))) AS distance FROM geo, unit),
    near AS (SELECT * FROM away WHERE distance - radius <= 0.1)"""
I8 = """
    span AS (SELECT CAST(min(list_min(embedding)) AS DOUBLE) AS lo, CAST(max(list_max(embedding)) AS DOUBLE) AS hi FROM embeddings),
    codes AS (SELECT vec_id AS doc_id, lo, hi, list_transform(embedding, lambda x: CAST(trunc((CAST(x AS DOUBLE) - lo) / (hi - lo) * 255 - 128) AS INTEGER)) AS c FROM embeddings, span)"""
LINES = "g AS (SELECT l_orderkey AS doc_id, p_name AS source, s_name AS target FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"
TURNS = "t AS (SELECT conv_id AS qid, turn, text, role AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)"
RESULTS = """
    r AS (SELECT source AS qid, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    rel AS (SELECT source AS qid, doc_id, quality + toxic AS rel FROM documents JOIN labels USING (doc_id)),
    j AS (SELECT r.qid, r.doc_id, rank, coalesce(rel, 0) AS rel FROM r LEFT JOIN rel USING (qid, doc_id))"""
MEMORIES = f"""
    m AS (
        SELECT role AS agent_id, conv_id * 1000 + turn AS memory_id, conv_id, turn, text, {NOW} - conv_id * 3600.0 - 60.0 AS created_at,
            {NOW} - conv_id * 1800.0 - turn * 10.0 AS last_accessed, 0.5 + (turn % 5) * 0.1 AS importance, v.embedding
        FROM conversations LEFT JOIN embeddings v ON v.vec_id = conv_id),
    r AS (SELECT *, exp(-0.1 * (CAST({NOW} AS DOUBLE) - last_accessed) / 86400.0) AS recency FROM m)"""
GUARDED = f"({dot('r.embedding', 'q.embedding')} / (sqrt({dot('r.embedding', 'r.embedding')}) * sqrt({dot('q.embedding', 'q.embedding')}) + 1e-10))"
FILES = """
    f AS (
        SELECT strftime(o_orderdate, '%Y-%m') AS file_path, count(*) AS doc_count, CAST(strftime(any_value(o_orderdate), '%Y') AS BIGINT) AS snapshot_id,
            CAST(strftime(any_value(o_orderdate), '%m') AS DOUBLE) AS created_at, count(*) % 3 <> 0 AS is_active
        FROM orders GROUP BY 1)"""
BATCHES = "b AS (SELECT 'u-' || user_id AS batch_id, CASE WHEN event_type = 'click' THEN 'committed' ELSE 'pending' END AS status, CAST(event_id AS DOUBLE) AS created_at FROM events), latest AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY created_at DESC) = 1)"
PARTS = "parts AS (SELECT * FROM tok WHERE doc_id % 3 < 2), parts2 AS (SELECT * FROM tok WHERE doc_id % 3 > 0), each AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM parts) GROUP BY ALL UNION ALL SELECT term, doc_id, count(*) FROM (SELECT doc_id, unnest(w) AS term FROM parts2) GROUP BY ALL)"
EXPANDED = f"""
    pool AS (SELECT * FROM (SELECT *, row_number() OVER ({ORDER}) AS place FROM hits) WHERE place <= 20),
    three AS (SELECT p.doc_id, row_number() OVER (ORDER BY c.score DESC, p.doc_id) AS place FROM pool p JOIN cosines c USING (doc_id)),
    more AS (SELECT string_agg(t, ' ' ORDER BY place) AS added FROM (SELECT place, array_to_string(list_filter(regexp_split_to_array(lower({TITLE}), '\\s+'), lambda x: x <> ''), ' ') AS t FROM three JOIN documents USING (doc_id) WHERE place <= 3) WHERE t <> '')"""


def snippet_of(column: str = "text") -> str:
    flat = f"replace(coalesce({column}, ''), chr(10), ' ')"
    cases = ""
    for w in QUERY.lower().split():
        at = f"(instr(lower({flat}), '{w}') - 1)"
        start, end = f"greatest({at} - 90, 0)", f"least({at} + 90, length({flat}))"
        cases += f" WHEN {at} >= 0 THEN CASE WHEN {start} > 0 THEN '...' ELSE '' END || substr({flat}, {start} + 1, {end} - {start}) || CASE WHEN {end} < length({flat}) THEN '...' ELSE '' END"
    return f"CASE {cases} ELSE substr({flat}, 1, 180) || '...' END"


def ltr() -> str:
    """Features by name over hits, documents and the query's words."""
    tokens = "['" + "', '".join(w for w in QUERY.split() if w not in STOPWORDS) + "']"
    return f"""{lexical()}, {QV}, raw AS (SELECT e.vec_id AS doc_id, {COSINE} AS semantic FROM embeddings e, qv q),
    x AS (
        SELECT h.doc_id, h.score AS bm25, max(h.score) OVER () AS top, coalesce(semantic, 0) AS semantic, lower(coalesce(text, '')) AS text,
            list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS ws, {tokens} AS t
        FROM hits h JOIN documents d ON d.doc_id = h.doc_id LEFT JOIN raw ON raw.doc_id = h.doc_id),
    i AS (SELECT list({IDF} ORDER BY pos) AS idfs FROM (SELECT pos, term, coalesce(df, 0) AS df, n FROM qtok LEFT JOIN dfs USING (term), st)),
    y AS (
        SELECT *, CAST(len(t) AS DOUBLE) AS ql, CAST(len(ws) AS DOUBLE) AS dl2, list_transform(t, lambda a: CAST(len(list_filter(ws, lambda b: b = a)) AS DOUBLE)) AS tfs,
            list_transform(list_filter(t, lambda a: list_contains(ws, a)), lambda a: list_position(ws, a) - 1) AS places
        FROM x, i),
    z AS (SELECT *, list_transform(list_zip(tfs, idfs), lambda p: p[1] * p[2]) AS ti, CAST(len(list_distinct(list_filter(t, lambda a: list_contains(ws, a)))) AS DOUBLE) AS cov FROM y),
    feat AS (
        SELECT doc_id, ql AS q_len, dl2 AS doc_len, cov AS coverage_count, cov / (ql + 1e-6) AS coverage_ratio,
            list_sum(tfs) AS sum_tf, list_min(tfs) AS min_tf, list_max(tfs) AS max_tf, list_avg(tfs) AS mean_tf, list_var_pop(tfs) AS var_tf,
            list_sum(idfs) AS sum_idf, list_min(idfs) AS min_idf, list_max(idfs) AS max_idf, list_avg(idfs) AS mean_idf, list_sum(idfs) / (ql + 1e-6) AS query_specificity,
            list_sum(ti) AS sum_tfidf, list_min(ti) AS min_tfidf, list_max(ti) AS max_tfidf, list_avg(ti) AS mean_tfidf, list_var_pop(ti) AS var_tfidf,
            CASE WHEN top > 0 THEN bm25 / top ELSE 0 END AS norm_bm25, semantic,
            CASE WHEN contains(text, '{QUERY}') THEN 1 ELSE 0 END AS exact_phrase,
            CASE WHEN len(list_filter(range(1, len(ws)), lambda k: ws[k] = t[1] AND ws[k + 1] = t[2])) > 0 THEN 1 ELSE 0 END AS window_match,
            len(list_filter(range(1, len(t)), lambda k: contains(text, t[k] || ' ' || t[k + 1]))) AS bigram_match,
            CASE WHEN len(places) > 1 THEN 1.0 / (list_max(places) - list_min(places) + 1) ELSE 0 END AS density,
            CASE WHEN cov > 0 THEN 1 ELSE 0 END AS bool_match,
            CASE WHEN len(places) > 0 THEN list_min(places) / (dl2 + 1e-6) ELSE 1 END AS first_pos,
            CASE WHEN len(places) > 0 THEN list_max(places) / (dl2 + 1e-6) ELSE 1 END AS last_pos, 0 AS graph_score
        FROM z)"""


FEATURES = "q_len doc_len coverage_count coverage_ratio sum_tf min_tf max_tf mean_tf var_tf sum_idf min_idf max_idf mean_idf query_specificity sum_tfidf min_tfidf max_tfidf mean_tfidf var_tfidf norm_bm25 semantic exact_phrase window_match bigram_match density bool_match first_pos last_pos graph_score".split()

ORACLES: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {cleaned(chr(34) + 'text' + chr(34))} AS cleaned FROM documents",
    "clean_html": f"SELECT page_id, {cleaned('html')} AS cleaned FROM pages",
    "normalize_text": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(9), ' '),
        '[\x{00a0}\x{2000}-\x{200b}\x{feff}]', ' ', 'g'), ' +', ' ', 'g'), '[ \r\f\v]+\n', chr(10), 'g'), '[ \r\f\v]+$', ''), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\v]+|[\s\v]+$', '', 'g') AS normalized FROM documents""",
    "tokens": f"SELECT doc_id, array_to_string({words(cleaned('text'))}, ' ') AS tokens, CAST(greatest(1, length(text) // 4) AS BIGINT) AS n_tokens FROM documents",
    "snippets": f"SELECT doc_id, {snippet_of()} AS snippet FROM documents",
    "keyword_domain": "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{k}')" for k in DOMAIN),
    "text_overlap": r"""WITH p AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM documents),
        s AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS a,
            list_distinct(list_filter(regexp_split_to_array(lower(other), '\s+'), lambda w: w <> '')) AS b FROM p WHERE other IS NOT NULL)
        SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(a), len(b)) END AS overlap FROM s""",
    "format_chunks": """WITH p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
        SELECT conv_id, turn, concat_ws(chr(10), CASE WHEN role <> '' THEN '[Section: ' || role || ']' END, CASE WHEN before <> '' THEN '(Context before: ' || substr(before, 1, 200) || ')' END,
            CASE WHEN text <> '' THEN text END) AS formatted, conv_id || '_' || turn AS chunk_id, 'doc://' || conv_id || '_' || role AS url FROM p""",
    "llm_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "term_freq": f"WITH {INDEX} SELECT term, doc_id, tf FROM post",
    "doc_freq": f"WITH {INDEX} SELECT term, count(*) AS df FROM post GROUP BY term",
    "corpus_stats": f"WITH {INDEX} SELECT n AS total_docs, avgdl AS avg_doc_length FROM st",
    "get_postings": f"WITH {INDEX} SELECT term, doc_id, tf FROM post WHERE term IN ('this', 'heed')",
    "index_round_trip": f"WITH {INDEX} SELECT term, doc_id, tf FROM post WHERE term IN ('this', 'or')",
    "index_merge_sum": f"WITH {INDEX}, {PARTS} SELECT term, doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM each GROUP BY term, doc_id",
    "fts_merge": f"WITH {INDEX}, {PARTS} SELECT term, doc_id, CAST(max(tf) AS BIGINT) AS tf FROM each GROUP BY term, doc_id",
    "fts_delete": f"WITH {INDEX} SELECT (SELECT count(DISTINCT term) FROM post WHERE doc_id % 5 <> 0) AS term_count, count(*) AS doc_count, {units('avg(dl)')} AS avg_fp FROM len WHERE doc_id % 5 <> 0",
    "upsert_documents": """WITH fresh AS (SELECT doc_id + 2 AS doc_id, 'xx' AS lang FROM documents WHERE doc_id % 4 = 0)
        SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM fresh) UNION ALL SELECT doc_id, lang FROM fresh""",
    "delete_documents": "SELECT doc_id, source FROM documents WHERE source <> 'src3'",
    "batch_get": """WITH w AS (SELECT doc_id * 2 AS doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM labels)
        SELECT pos, w.doc_id, n_chars FROM w LEFT JOIN documents d ON d.doc_id = w.doc_id""",
    "tfidf_scores": f"WITH {INDEX}, {DF}, {asked()} SELECT doc_id, {units('sum(qtf * tf * (ln((n + 1) / (df + 1)) + 1))')} AS score_fp FROM q JOIN post USING (term) JOIN dfs USING (term), st GROUP BY doc_id",
    "bm25_body": f"WITH {INDEX}, {DF}, {asked()}, {BODY} SELECT doc_id, {units('score')} AS score_fp FROM body",
    "bm25_title": f"WITH {INDEX}, {DF}, {asked()}, {TITLES} SELECT doc_id, {units('score')} AS score_fp FROM titles",
    "bm25_topk": f"{lexical()} SELECT doc_id, {units('score')} AS score_fp, {RANKED} FROM hits QUALIFY rank <= {K}",
    "bm25_batch": f"{lexical(batch=True)} SELECT qid, doc_id, {units('score')} AS score_fp, {RANKED} FROM hits QUALIFY rank <= 10",
    "fts_topk": f"WITH {INDEX}, {DF}, {asked()}, {BODY.replace('/ avgdl', '/ greatest(avgdl, 1)')} SELECT doc_id, {units('score')} AS score_fp, row_number() OVER ({PLAIN}) AS rank FROM body QUALIFY rank <= 50",
    "fts_boost": f"""{lexical()}, f AS (SELECT doc_id, sum(score) AS score FROM (SELECT doc_id, score FROM hits UNION ALL SELECT doc_id, 0.5 * score FROM body) GROUP BY doc_id)
        SELECT doc_id, {units('score')} AS score_fp, row_number() OVER ({PLAIN}) AS rank FROM f QUALIFY rank <= {K}""",
    "filter_by": "SELECT doc_id, source FROM documents WHERE lang = 'de'",
    "merge_results": f"""{lexical()}, l AS (SELECT doc_id, score FROM hits WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, score * CASE WHEN doc_id % 2 = 0 THEN 1.25 ELSE 0.5 END FROM hits WHERE doc_id % 3 > 0)
        SELECT doc_id, {units('max(score)')} AS score_fp FROM l GROUP BY doc_id""",
    "scatter_gather": f"{lexical()} SELECT doc_id, {units('score')} AS score_fp, row_number() OVER ({PLAIN}) AS rank FROM hits QUALIFY rank <= {K}",
    "knn_ip": f"WITH {QV}, {IP} SELECT doc_id, {units('score', 32)} AS score_fp, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ip QUALIFY rank <= {K}",
    "prune_by_distance": f"WITH {QV}, {IP} SELECT doc_id, {units('score')} AS score_fp FROM ip WHERE score >= 0.25",
    "segment_geometry": f"WITH {QV}, {GEOMETRY} SELECT CAST(file_path AS BIGINT) AS file_path, doc_count, {units('radius')} AS radius_fp, {units('centroid[1]')} AS first_fp, CAST(len(centroid) AS BIGINT) AS dim FROM geo",
    "geometric_prune": f"WITH {QV}, {GEOMETRY} SELECT CAST(file_path AS BIGINT) AS file_path, {units('distance')} AS distance_fp FROM near",
    "pruned_knn": f"WITH {QV}, {GEOMETRY}, {IP} SELECT doc_id, {units('score')} AS score_fp, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ip WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label IN (SELECT file_path FROM near)) QUALIFY rank <= 10",
    "quantize_i8": f"WITH {I8} SELECT doc_id, array_to_string(c, ',') AS codes FROM codes",
    "dequantize_i8": f"WITH {I8}, back AS (SELECT doc_id, list_transform(c, lambda x: CAST((x + 128) / 255 * (hi - lo) + lo AS FLOAT)) AS v FROM codes) SELECT doc_id, {units(dot('v', 'v'), 12)} AS norm_fp FROM back",
    "dual_hybrid": f"""WITH {QV}, a AS (SELECT e.vec_id AS doc_id, {dot('e.embedding', 'q.embedding')} AS c, {dot('list_reverse(e.embedding)', 'q.embedding')} AS x FROM embeddings e, qv q),
        two AS (SELECT doc_id, 0.5 * c AS s FROM (SELECT *, row_number() OVER (ORDER BY c DESC, doc_id) AS r FROM a) WHERE r <= {2 * K} UNION ALL SELECT doc_id, 0.5 * x FROM (SELECT *, row_number() OVER (ORDER BY x DESC, doc_id) AS r FROM a) WHERE r <= {2 * K}),
        f AS (SELECT doc_id, sum(s) AS score FROM two GROUP BY doc_id)
        SELECT doc_id, {units('score', 32)} AS score_fp, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= {K}""",
    "dual_boost": f"""{lexical()}, {QV}, a AS (SELECT e.vec_id AS doc_id, {dot('e.embedding', 'q.embedding')} AS c, {dot('list_reverse(e.embedding)', 'q.embedding')} AS x FROM embeddings e, qv q),
        two AS (SELECT doc_id, 0.5 * c AS s FROM (SELECT *, row_number() OVER (ORDER BY c DESC, doc_id) AS r FROM a) WHERE r <= 100 UNION ALL SELECT doc_id, 0.5 * x FROM (SELECT *, row_number() OVER (ORDER BY x DESC, doc_id) AS r FROM a) WHERE r <= 100),
        d AS (SELECT doc_id, sum(s) AS dual FROM two GROUP BY doc_id QUALIFY row_number() OVER (ORDER BY dual DESC, doc_id) <= 50),
        b AS (SELECT h.doc_id, h.score + 0.3 * coalesce(dual, 0) AS score FROM hits h LEFT JOIN d USING (doc_id))
        SELECT doc_id, {units('score')} AS score_fp, row_number() OVER ({PLAIN}) AS rank FROM b QUALIFY rank <= 50""",
    "dual_texts": "SELECT doc_id, substr(text, 1, 512) AS content, concat_ws(' ', CASE WHEN source <> '' THEN source END, CASE WHEN lang <> '' THEN lang END, CASE WHEN text <> '' THEN substr(text, 1, 300) END) AS context FROM documents",
    "rrf_fusion": f"""{lexical()}, {QV}, {COS}, top AS (SELECT doc_id, {units('score')} AS lexical FROM hits QUALIFY row_number() OVER ({ORDER}) <= 50),
        two AS (SELECT doc_id, row_number() OVER (ORDER BY lexical DESC, doc_id) AS lexical_rank, row_number() OVER (ORDER BY coalesce(c.score, -1) DESC, doc_id) AS semantic_rank FROM top LEFT JOIN cosines c USING (doc_id)),
        s AS (SELECT *, 0.4::DOUBLE / (60 + lexical_rank) + 0.6::DOUBLE / (60 + semantic_rank) AS score FROM two)
        SELECT doc_id, {units('score', 32)} AS score_fp, lexical_rank, semantic_rank, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s""",
    "query_expansion": f"{lexical()}, {QV}, {COS}, {EXPANDED} SELECT CAST(0 AS BIGINT) AS qid, concat_ws(' ', '{QUERY}', added) AS query FROM more",
    "graph_nodes": f"WITH {LINES}, e AS (SELECT source AS name, doc_id FROM g UNION ALL SELECT target, doc_id FROM g) SELECT name AS id, name, greatest(1, count(DISTINCT doc_id)) AS val FROM e GROUP BY name",
    "graph_edges": f"WITH {LINES} SELECT source, target, 'supplied_by' AS name, count(*) AS n FROM g GROUP BY ALL",
    "graph_score": f"""WITH {LINES}, e AS (SELECT source AS name, doc_id FROM g UNION SELECT target, doc_id FROM g),
        w AS (SELECT unnest(['small', '000000003', 'small']) AS word),
        hit AS (SELECT name, count(*) AS times FROM (SELECT DISTINCT name FROM e) JOIN w ON contains(lower(name), word) GROUP BY name),
        parts AS (SELECT doc_id, CAST(times AS DOUBLE) AS s FROM hit JOIN e USING (name)
            UNION ALL SELECT doc_id, 0.5 FROM g WHERE source IN (SELECT name FROM hit) OR target IN (SELECT name FROM hit))
        SELECT CAST(0 AS BIGINT) AS qid, doc_id, CAST(sum(s) AS DOUBLE) AS score FROM parts GROUP BY doc_id""",
    "graph_merge": f"WITH {LINES} SELECT source, 2 * count(*) AS n FROM g GROUP BY source",
    "ltr_features": f"{ltr()} SELECT doc_id, {', '.join(f'{units(f, 10)} AS {f}' for f in FEATURES)} FROM feat",
    "ltr_fallback": f"{ltr()}, s AS (SELECT doc_id, norm_bm25 + semantic AS score FROM feat) SELECT doc_id, {units('score')} AS score_fp, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {K}",
    "training_labels": f"""{lexical()}, {QV}, {IP}, a AS (SELECT doc_id, row_number() OVER ({ORDER}) AS r FROM hits QUALIFY r <= 20),
        b AS (SELECT doc_id, 20 + row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ip QUALIFY r <= 40),
        o AS (SELECT doc_id, min(r) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id),
        p AS (SELECT doc_id, row_number() OVER (ORDER BY r) AS pos FROM o)
        SELECT doc_id, pos, CAST(CASE WHEN pos = 1 THEN 2 WHEN pos <= 5 THEN 1 ELSE 0 END AS BIGINT) AS label FROM p""",
    "filtered_search": f"{lexical()}, h AS (SELECT h.* FROM hits h JOIN documents USING (doc_id) WHERE lang = 'en' QUALIFY row_number() OVER ({ORDER}) <= 20) SELECT doc_id, {units('score')} AS score_fp, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 10",
    "search_response": f"""{lexical()}, h AS (SELECT * FROM hits QUALIFY row_number() OVER ({ORDER}) <= 20), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 10)
        SELECT doc_id, rank, {TITLE} AS title, 'doc://' || doc_id AS url, {snippet_of()} AS snippet FROM r JOIN documents USING (doc_id)""",
    "context_group": f"""WITH {TURNS}, n AS (SELECT *, min(rank) OVER (PARTITION BY qid, document_id) AS f, row_number() OVER (PARTITION BY qid, document_id ORDER BY turn, rank) AS k FROM t)
        SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY f, k) AS seq FROM n WHERE k <= 2""",
    "context_budget": rf"""WITH {TURNS}, n AS (SELECT qid, rank, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM t),
        c AS (SELECT *, CAST(len(w) * 4 // 3 AS BIGINT) AS k FROM n),
        s AS (SELECT *, 200 - coalesce(sum(k) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM c),
        o AS (SELECT *, sum(CASE WHEN k > rest THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS over FROM s),
        p AS (SELECT qid, rank, CASE WHEN k <= rest THEN text WHEN rest > 100 THEN array_to_string(w[1:CAST(floor(rest * 3 / 4) AS BIGINT)], ' ') || '...' END AS part FROM o WHERE over = 0 OR (over = 1 AND k > rest))
        SELECT qid, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM p WHERE part IS NOT NULL GROUP BY qid""",
    "precision_at_k": f"WITH {RESULTS} SELECT qid, {units('sum(CASE WHEN rank <= 10 AND rel > 0 THEN 1 ELSE 0 END) / 10.0')} AS precision_fp FROM j GROUP BY qid",
    "average_precision": f"""WITH {RESULTS}, h AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM j)
        SELECT qid, {units('sum(CASE WHEN rel > 0 THEN CAST(hits AS DOUBLE) / rank ELSE 0 END) / greatest(sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END), 1)')} AS ap_fp FROM h GROUP BY qid""",
    "ndcg": f"""WITH {RESULTS}, got AS (SELECT qid, sum((2 ** rel - 1) / log2(rank + 1)) AS d FROM j WHERE rank <= 10 GROUP BY qid),
        best AS (SELECT qid, sum((2 ** rel - 1) / log2(place + 1)) AS i FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM rel) WHERE place <= 10 GROUP BY qid)
        SELECT qid, {units('d / greatest(coalesce(i, 0), 1)')} AS ndcg_fp FROM got LEFT JOIN best USING (qid)""",
    "ndcg_binary": f"""WITH {RESULTS}, got AS (SELECT qid, sum(rel / log2(rank + 1)) AS d FROM j WHERE rank <= 10 GROUP BY qid),
        best AS (SELECT qid, sum(rel / log2(place + 1)) AS i FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM rel) WHERE place <= 10 GROUP BY qid)
        SELECT qid, {units('d / greatest(coalesce(i, 0), 1)')} AS ndcg_fp FROM got LEFT JOIN best USING (qid)""",
    "mrr": f"WITH {RESULTS}, f AS (SELECT qid, min(CASE WHEN rel > 0 THEN rank END) AS place FROM j GROUP BY qid) SELECT qid, {units('coalesce(1.0 / place, 0)')} AS rr_fp, {units('coalesce(1.0 / log2(place + 1), 0)')} AS single_ndcg_fp FROM f",
    "mean_metrics": f"WITH {RESULTS}, p AS (SELECT qid, sum(CASE WHEN rank <= 10 AND rel > 0 THEN 1 ELSE 0 END) / 10.0 AS precision FROM j GROUP BY qid) SELECT {units('avg(precision)')} AS mean_precision_fp FROM p",
    "judgement_ratios": "SELECT doc_id % 20 AS sample_id, 'faithfulness' AS kind, round(avg(CAST(quality AS DOUBLE)), 4) AS ratio FROM labels GROUP BY 1, 2",
    "memory_scores": f"""WITH {MEMORIES}, {QV}, s AS (SELECT agent_id, memory_id, CASE WHEN r.embedding IS NULL THEN 0 ELSE {GUARDED} * recency * importance END AS score FROM r, qv q)
        SELECT agent_id, memory_id, {units('score', 32)} AS score_fp, row_number() OVER (PARTITION BY agent_id ORDER BY score DESC, memory_id) AS rank FROM s QUALIFY rank <= 10""",
    "memory_touch": f"""WITH {MEMORIES}, {QV}, s AS (SELECT agent_id, memory_id, last_accessed, CASE WHEN r.embedding IS NULL THEN 0 ELSE {GUARDED} * recency * importance END AS score FROM r, qv q),
        n AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY score DESC, memory_id) AS rank FROM s)
        SELECT memory_id, CAST(CASE WHEN rank <= 10 THEN 1 ELSE 0 END AS BIGINT) AS access_count, CAST(CASE WHEN rank <= 10 THEN {NOW} ELSE last_accessed END AS DOUBLE) AS last_accessed FROM n""",
    "memory_evict": f"WITH {MEMORIES} SELECT agent_id, memory_id FROM r QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY recency * importance DESC, memory_id DESC) <= 100",
    "memory_stats": f"WITH {MEMORIES} SELECT agent_id, count(*) AS n, {units(f'avg((CAST({NOW} AS DOUBLE) - created_at) / 86400.0)')} AS avg_age_days_fp, {units('avg(importance)')} AS avg_importance_fp, {units('avg(recency)')} AS avg_recency_fp FROM r GROUP BY agent_id",
    "memory_decay": f"WITH {MEMORIES} SELECT memory_id, {units('recency * importance')} AS weight_fp FROM r",
    "working_memory_lastn": "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "working_memory_search": f"WITH {MEMORIES}, {QV}, s AS (SELECT memory_id, CASE WHEN r.embedding IS NULL THEN 0 ELSE {GUARDED} * importance END AS score FROM r, qv q) SELECT memory_id, {units('score', 32)} AS score_fp FROM s QUALIFY row_number() OVER (ORDER BY score DESC, memory_id) <= 10",
    "memory_boost": f"""{lexical()}, recalled AS ({lexical("the who")} SELECT doc_id FROM hits QUALIFY {RANKED.replace(" AS rank", "")} <= 10),
        heads AS (SELECT DISTINCT substr(text, 1, 50) AS head FROM documents JOIN recalled USING (doc_id) WHERE length(text) > 60)
        SELECT h.doc_id, {units('score * CASE WHEN EXISTS (SELECT 1 FROM heads WHERE contains(d.text, head)) THEN 1.2 ELSE 1 END')} AS score_fp FROM hits h JOIN documents d ON d.doc_id = h.doc_id""",
    "agent_partitions": "SELECT role AS agent_id, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY role",
    "active_files": f"WITH {FILES} SELECT file_path, doc_count FROM f WHERE snapshot_id = (SELECT max(snapshot_id) FROM f) AND is_active",
    "catalog_stats": f"""WITH {FILES}, a AS (SELECT * FROM f WHERE snapshot_id = (SELECT max(snapshot_id) FROM f) AND is_active)
        SELECT 'snapshots' AS metric, count(DISTINCT snapshot_id) AS n FROM f UNION ALL SELECT 'active_files', count(*) FROM a
        UNION ALL SELECT 'total_docs', CAST(coalesce(sum(doc_count), 0) AS BIGINT) FROM a UNION ALL SELECT 'batches', count(*) FROM events""",
    "snapshot_history": f"WITH {FILES} SELECT snapshot_id, CAST(sum(doc_count) AS BIGINT) AS doc_count FROM f GROUP BY snapshot_id",
    "latest_batches": f"WITH {BATCHES} SELECT batch_id, status, created_at FROM latest",
    "latest_schema": "SELECT event_id AS version, props AS schema_json FROM events ORDER BY event_id DESC LIMIT 1",
    "batch_dedup": f"WITH {BATCHES} SELECT 'u-' || c_custkey AS batch_id FROM customer WHERE 'u-' || c_custkey NOT IN (SELECT batch_id FROM latest WHERE status = 'committed')",
    "compaction_plan": f"""WITH {FILES}, s AS (SELECT file_path, doc_count * 4096 AS bytes, row_number() OVER (ORDER BY created_at, file_path) AS seq, sum(doc_count * 4096) OVER (ORDER BY created_at, file_path ROWS UNBOUNDED PRECEDING) AS run FROM f),
        t AS (SELECT * FROM s WHERE seq = 1 OR run <= 2000000)
        SELECT seq, file_path, bytes FROM t WHERE (SELECT count(*) FROM f) >= 4 AND (SELECT count(*) FROM t) >= 2""",
    "version_diff": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'removed' WHEN 2 THEN 'added' ELSE 'unchanged' END AS status FROM documents",
    "as_of": "SELECT user_id, event_id, event_type FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "schema_evolution": "SELECT p_partkey, p_name, CAST(NULL AS DOUBLE) AS score FROM part",
    "csv_scan": """WITH b AS (SELECT item_id, 'T ' || item_id AS title, replace(text, chr(10), ' ') AS text, 'u' || item_id AS url FROM benchmark WHERE item_id % 3 <> 1)
        SELECT row_number() OVER (ORDER BY item_id) AS doc_id, title, text, url FROM b""",
    "tsv_scan": "SELECT item_id AS doc_id, 'Passage ' || item_id AS title, replace(text, chr(10), ' ') AS text, 'msmarco://' || item_id AS url FROM benchmark",
    "json_scan": "SELECT row_number() OVER (ORDER BY item_id) AS doc_id, 'T ' || item_id AS title, replace(text, chr(10), ' ') AS text, 'doc://' || row_number() OVER (ORDER BY item_id) AS url FROM benchmark",
    "xml_scan": f"SELECT item_id AS doc_id, 'T ' || item_id AS title, {cleaned('text')} AS text, 'https://en.wikipedia.org/wiki/T_' || item_id AS url FROM benchmark",
}

EXPANDED_QUERY = f"(SELECT CAST(0 AS BIGINT) AS qid, concat_ws(' ', '{QUERY}', added) AS query FROM more)"
SECOND = f"{lexical()}, {QV}, {COS}, {EXPANDED}, {asked(EXPANDED_QUERY).replace('qtok AS', 'qtok2 AS').replace('q AS (SELECT qid, term', 'q2 AS (SELECT qid, term').replace('FROM qtok ', 'FROM qtok2 ')}, {BODY.replace('body AS', 'body2 AS').replace('FROM q JOIN', 'FROM q2 JOIN')}, {TITLES.replace('titles AS', 'titles2 AS').replace('FROM q JOIN', 'FROM q2 JOIN')}, {BOTH.replace('hits AS', 'hits2 AS').replace('FROM body', 'FROM body2').replace('FROM titles', 'FROM titles2')}"
ORACLES["expanded_search"] = f"{SECOND} SELECT doc_id, {units('score')} AS score_fp, {RANKED} FROM hits2 QUALIFY rank <= {K}"

# the expanded query's hits, the first 50 fused with the vector ranks, the first 20 of those scored anew
HYBRID = f"""{SECOND}, top50 AS (SELECT doc_id, score FROM hits2 QUALIFY row_number() OVER ({ORDER}) <= 50),
    fused AS (SELECT t.doc_id, t.score AS bm25, c.score AS semantic, row_number() OVER (ORDER BY t.score DESC, t.doc_id) AS lr, row_number() OVER (ORDER BY coalesce(c.score, -1) DESC, t.doc_id) AS sr FROM top50 t LEFT JOIN cosines c ON c.doc_id = t.doc_id),
    pool20 AS (SELECT *, 0.4::DOUBLE / (60 + lr) + 0.6::DOUBLE / (60 + sr) AS rrf FROM fused QUALIFY row_number() OVER (ORDER BY rrf DESC, doc_id) <= 20),
    anew AS (SELECT doc_id, bm25 / max(bm25) OVER () + coalesce(semantic, 0) AS score FROM pool20),
    best AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM anew QUALIFY rank <= 10)"""
ORACLES["hybrid_search"] = f"{HYBRID} SELECT doc_id, {units('score')} AS score_fp, rank FROM best"
ORACLES["explain_search"] = f"{HYBRID} SELECT b.doc_id, {units('coalesce(h.score, 0)')} AS bm25_fp, {units('coalesce(c.score, 0)')} AS semantic_fp, rank FROM best b LEFT JOIN hits h ON h.doc_id = b.doc_id LEFT JOIN cosines c ON c.doc_id = b.doc_id"
# the same rows by another way
ORACLES.update({"bm25_blocks": ORACLES["bm25_topk"], "bm25_blocks_batch": ORACLES["bm25_batch"], "segmented_index": ORACLES["fts_delete"]})
ORACLES["vector_store"] = """
    WITH e AS (SELECT vec_id AS doc_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
    added AS (
        SELECT 1 AS seq, doc_id, embedding FROM e UNION ALL SELECT 2, doc_id, list_reverse(embedding) FROM e WHERE doc_id % 3 = 0
        UNION ALL SELECT 3, doc_id + 1000000, embedding FROM e WHERE doc_id % 5 = 0),
    live AS (SELECT doc_id, arg_max(embedding, seq) AS embedding FROM added GROUP BY doc_id),
    wanted AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 1000000 FROM e WHERE doc_id % 10 = 0)
    SELECT w.doc_id, array_to_string([CAST(CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT) AS VARCHAR) FOR x IN embedding], ',') AS vector,
        (SELECT count(*) FROM added) AS appended, (SELECT count(*) FROM live) AS total_vectors, (SELECT CAST(max(len(embedding)) AS BIGINT) FROM live) AS dimension
    FROM wanted w LEFT JOIN live USING (doc_id)"""
KINDS = "CASE WHEN n > 500000 THEN 'ivf_pq' WHEN n > 10000 THEN 'hnsw' ELSE 'flat' END"
ORACLES["index_kind"] = f"SELECT name, n, {KINDS} AS kind FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("embeddings", "documents", "events", "lineitem", "region")) + ")"

COMPARISONS = {"eq": "CAST({c} AS VARCHAR) = '{v}'", "ne": "CAST({c} AS VARCHAR) <> '{v}'", "gt": "{c} > {v}", "gte": "{c} >= {v}", "lt": "{c} < {v}", "lte": "{c} <= {v}", "contains": "contains(lower({c}), lower('{v}'))"}
ORACLES.update(
    {
        name: f"{lexical()} SELECT h.doc_id, {units('score')} AS score_fp, CAST(row_number() OVER (ORDER BY {units('score')} DESC, title_only, qpos, h.doc_id) AS BIGINT) AS rank FROM hits h JOIN documents d ON d.doc_id = h.doc_id WHERE {COMPARISONS[op].format(c='d.' + column, v=value)}"
        for name, (column, value, op) in FILTERS.items()
    }
)
