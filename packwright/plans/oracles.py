"""DuckDB SQL for the queries of the registry, over views of the same tables."""

from __future__ import annotations

from packwright.functions.text import LINE_ENDS, LOWER, MARKED, UNMARKED, UPPER, WS, WS_IN_LINE


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[{WS}]+|[{WS}]+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '[{WS}]+', ' ', 'g')"


def _cut(x: str, n: int, mark: str) -> str:
    t = _squeeze(x)
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(substr({t}, 1, {n - len(mark)}), ' ') || '{mark}' END"


def _normal(x: str) -> str:
    lines = f"regexp_replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), '[{LINE_ENDS}]', chr(10), 'g')"
    return _strip(f"regexp_replace({lines}, '[{WS_IN_LINE}]+\\n', chr(10), 'g')")


def _id(key: str) -> str:
    return f"CAST('0x' || substr(sha256({key}), 1, 14) AS BIGINT)"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({x}, '')), '{MARKED}', '{UNMARKED}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def _fold(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"


_VERSIONS = """SELECT doc_id, lang, source, CASE WHEN doc_id % 5 > 0 THEN ['8.3.' || (doc_id % 7), '8.3.' || (doc_id % 11), '8.3.' || (doc_id % 13)]
  ELSE CAST([] AS VARCHAR[]) END AS versions FROM documents"""
_REL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_FILE = "string_split({0}, '/')[-1]"
_STEM = "regexp_replace({0}, '(.)[.][^.]*$', '\\1')"
_CALLS = """SELECT event_id % 50 AS module_id, 'User' || (user_id % 20) AS caller_name, event_type || '_' || (event_id % 7) AS callee_name, event_id AS line, 1 AS args_count FROM events"""


def _bm25(terms: list[str], columns: list[str], extra: str = "") -> str:
    """Counting and scoring as common table expressions ending in scored(doc_id, score)."""
    tf = ", ".join(
        f"CAST({' + '.join(f'len(list_filter({_tokens(c)}, lambda w: w = {chr(39)}{t}{chr(39)}))' for c in columns)} AS DOUBLE) AS tf{k}"
        for k, t in enumerate(terms)
    )
    n = ", ".join(f"sum(CASE WHEN tf{k} > 0 THEN 1 ELSE 0 END) AS n{k}" for k in range(len(terms)))
    part = " - ".join(
        f"greatest(ln((n_docs - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(terms))
    )
    every = " AND ".join(f"tf{k} > 0" for k in range(len(terms)))
    length = " + ".join(f"len({_tokens(c)})" for c in columns)
    return f"""c AS (SELECT doc_id, CAST({length} AS DOUBLE) AS dl, {tf} FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(dl) AS avgdl, {n} FROM c),
scored AS (SELECT doc_id, 0.0 - {part} AS score FROM c, s WHERE {every})"""


_LINKS = """SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, {text} AS text
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS a FROM pages)""".format(
    text=_squeeze("regexp_replace(regexp_replace(a, '(?is)^<a\\s[^>]*>|</a>$', '', 'g'), '<[^>]*>', '', 'g')")
)

ORACLES: dict[str, str] = {
    "compact_text": f"SELECT doc_id, {_cut('text', 200, '…')} AS compacted FROM documents",
    "compact_summary": f"SELECT doc_id, {_cut('text', 150, '...')} AS summary FROM documents",
    "normalize_text": f"SELECT doc_id, sha256({_normal('text')}) AS digest, CAST(length({_normal('text')}) AS INTEGER) AS n FROM documents",
    "hash_id": f"SELECT page_id, {_id(chr(39) + '8.3|ru|' + chr(39) + ' || url')} AS id FROM pages",
    "sha256_text": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "slug_source": f"""SELECT p_partkey, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS slug FROM (SELECT p_partkey,
      regexp_replace(regexp_replace(lower({_squeeze("p_name || ' / ' || p_brand")}), '[^\\p{{L}}\\p{{N}}_.-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g') AS s FROM part)""",
    "safe_name": f"SELECT page_id, regexp_replace({_STEM.format(_FILE.format('(url || ' + chr(39) + '.html' + chr(39) + ')'))}, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') AS stem FROM pages",
    "html_title": f"""SELECT page_id, coalesce(nullif({_squeeze("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")}, ''),
      nullif({_squeeze("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')")}, ''), 'Untitled') AS title FROM pages""",
    "qualified_names": "SELECT p_partkey, q AS qualified, CASE WHEN q LIKE '%.%' THEN trim(regexp_replace(q, '[.][^.]*$', '')) ELSE '' END AS owner, trim(regexp_extract(q, '[^.]*$')) AS member FROM (SELECT p_partkey, CASE WHEN p_size > 25 AND p_name NOT LIKE '%.%' THEN p_brand || '.' || trim(p_name) ELSE trim(p_name) END AS q FROM part)",
    "text_without_titles": f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_normal('text')}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND lower(trim(string_split(x, ' (')[1])) NOT IN (lower(source), lower(lang))), chr(10)) AS body FROM documents",
    "inline_sections": f"SELECT doc_id, 'Над ними' AS intro, source AS syntax, CASE WHEN {_normal('text')} = '' THEN lang ELSE {_normal('text')} || chr(10) || chr(10) || lang END AS description, 2 AS n FROM documents",
    "owner_stubs": "SELECT DISTINCT source AS full_name, lang AS version, 'type' AS kind, 'stub' AS resolver_kind, '' AS summary FROM documents WHERE lang <> 'en' AND trim(source) <> ''",
    "ranked_examples": """SELECT * FROM (SELECT p_brand || '.' || p_name AS full_name, p_name AS title, p_type AS description, CAST(NULL AS VARCHAR) AS code,
        CASE WHEN contains(lower(p_brand || '.' || p_name), 'cold widget') THEN 40 ELSE 0 END + CASE WHEN contains(lower(concat_ws(' ', p_brand || '.' || p_name, p_name, p_type)), 'cold') THEN 5 ELSE 0 END
        + CASE WHEN contains(lower(concat_ws(' ', p_brand || '.' || p_name, p_name, p_type)), 'widget') THEN 5 ELSE 0 END AS score FROM part) WHERE score > 0 ORDER BY score DESC, full_name, title, description LIMIT 20""",
    "title_parts": "SELECT p_partkey, trim(p_name) AS base, CASE WHEN lower(p_type) <> lower(p_name) AND p_type <> '' THEN p_type END AS synonym FROM part",
    "code_blocks": f"SELECT conv_id, turn, {_strip('translate(text, chr(96), chr(39))')} AS code FROM conversations",
    "search_tokens": f"SELECT conv_id, turn, array_to_string({_tokens('text')}, ' ') AS tokens FROM conversations",
    "version_sort": f"""SELECT doc_id, coalesce((SELECT string_agg(v, ',' ORDER BY CAST(string_split(v, '.')[3] AS INTEGER) DESC)
      FROM (SELECT DISTINCT unnest(t.versions) AS v)), '') AS versions FROM ({_VERSIONS}) t""",
    "version_filter": f"""SELECT doc_id, string_agg(v, ',' ORDER BY v) AS versions FROM (SELECT DISTINCT doc_id, unnest(versions) AS v FROM ({_VERSIONS}))
      WHERE v IN ('8.3.1', '8.3.3', '8.3.10') GROUP BY doc_id""",
    "primary_version": f"SELECT doc_id, min(v) AS version FROM (SELECT doc_id, unnest(versions) AS v FROM ({_VERSIONS})) GROUP BY doc_id",
    "versions_seen": f"SELECT v AS version, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(versions) AS v FROM ({_VERSIONS})) GROUP BY v",
    "version_match": f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(versions) AS v FROM ({_VERSIONS})) WHERE v = '8.3.3'",
    "first_nonblank_name": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND trim(source) <> '' THEN trim(source) ELSE trim(lang) END AS name FROM documents",
    "record_payload": f"SELECT p_partkey, {_cut('concat_ws(' + chr(39) + ' ' + chr(39) + ', p_name, p_brand, p_type)', 30, '…')} AS payload FROM part",
    "field_identity": """WITH f AS (SELECT l_orderkey, l_linenumber, 'Document.D' || l_suppkey AS o, l_orderkey % 4 AS g, 'f' || l_partkey AS n, l_returnflag AS s,
        CASE WHEN l_orderkey % 3 > 0 THEN l_linestatus ELSE '' END AS fm FROM lineitem)
      SELECT l_orderkey, l_linenumber, CASE g WHEN 1 THEN s || '.' || n WHEN 2 THEN CASE WHEN fm = '' THEN n ELSE fm || '.' || n END ELSE n END AS display_name,
        CASE g WHEN 1 THEN o || '.' || s || '.' || n WHEN 2 THEN o || '.Forms.' || CASE WHEN fm = '' THEN '' ELSE fm || '.' END || n ELSE o || '.' || n END AS topic_path FROM f""",
    "exact_lookup_ascii": f"SELECT p_partkey, p_name FROM part WHERE {_fold('p_name')} = 'small ring' OR {_fold('p_type')} = 'small ring'",
    "exact_lookup_unicode": """SELECT doc_id, 'Ünité ' || source AS name FROM documents WHERE lower('Ünité ' || source) = 'ünité src3'
      UNION ALL SELECT doc_id, 'Ünité ' || source FROM documents WHERE lower(text) = (SELECT lower(text) FROM documents WHERE doc_id = 0)""",
    "like_find": "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.com') ORDER BY length(url), url, page_id LIMIT 20",
    "blank_and_form_check": f"SELECT count(*) FILTER (WHERE {_strip('text')} = '') AS n_blank, count(*) FILTER (WHERE contains(lower(text), 'licensed under')) AS n_form FROM documents",
    "exclusion_reasons": """SELECT p_partkey, list_extract(['Documents/D/Templates/T/Template.bin', 'XDTOPackages/X/Package.bin', 'Reports/R/Templates/T/Ext/Template/_files/a.txt',
        'Reports/R/Templates/T/Ext/Template/i.html', 'a/b.PNG', 'a/b.mxl', 'Documents/D/Templates/T/Template.xml', 'Documents/D/Templates/T/a.xml', 'CommonModules/M/Ext/Module.bsl'], p_partkey % 9 + 1) AS path,
        CASE p_partkey % 9 WHEN 0 THEN 'template-binary' WHEN 1 THEN 'xdto-binary' WHEN 2 THEN 'template-html-asset' WHEN 3 THEN 'template-html-bundle' WHEN 4 THEN 'image-asset'
        WHEN 5 THEN 'mxl-binary' WHEN 6 THEN CASE WHEN p_size >= 10 THEN 'spreadsheet-template' ELSE 'kept' END WHEN 7 THEN 'embedded-base64-image' ELSE 'kept' END AS reason FROM part""",
    "path_object_hint": f"""SELECT page_id, CASE WHEN len(p) = 1 THEN 'root_file' ELSE p[1] END AS object_type,
      CASE WHEN len(p) = 1 THEN {_STEM.format('p[1]')} WHEN len(p) = 2 THEN {_STEM.format('p[2]')} ELSE p[2] END AS object_name FROM (SELECT page_id, string_split({_REL}, '/') AS p FROM pages)""",
    "classify_kind": """SELECT p_partkey, list_extract(['method', 'function', 'field', 'property', 'event', 'constructor', 'topic', 'topic'], p_partkey % 8 + 1) AS kind,
      CASE p_partkey % 8 WHEN 6 THEN 'form_help' WHEN 7 THEN 'cli_help' ELSE 'article' END AS article FROM part""",
    "json_props_project": "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) AS k FROM events WHERE CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) >= 50",
    "fts_postings": f"""SELECT term, doc_id, count(*) AS tf, CAST(min(i) - 1 AS INTEGER) AS first_position FROM
      (SELECT conv_id || ':' || turn AS doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS i FROM (SELECT conv_id, turn, {_tokens('text')} AS t FROM conversations)) GROUP BY term, doc_id""",
    "fts_corpus_stats": f"SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS avg_len FROM (SELECT len({_tokens('text')}) + len({_tokens('source')}) AS n FROM documents)",
    "fts_match_and": f"""WITH t AS (SELECT doc_id, list_concat({_tokens('text')}, {_tokens('source')}) AS w FROM documents)
      SELECT doc_id FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND list_contains(w, 'erthor') AND list_contains(w, 'src7')
      UNION ALL SELECT doc_id FROM t WHERE list_contains(w, 'that') AND list_contains(w, 'src7')""",
    "fts_phrase": f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_tokens('text')}, ' ') || ' ', ' of the ')",
    "bm25_topk": f"WITH {_bm25(['that', 'with', 'from'], ['text', 'source'])} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY 2, 1 LIMIT 10",
    "bm25_postings_topk": f"WITH {_bm25(['that', 'with', 'from'], ['text', 'source'])} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY 2, 1 LIMIT 10",
    "search_cascade": f"""WITH {_bm25(['that', 'with'], ['text', 'source'])} SELECT doc_id, source AS name, 1 AS tier, round(score, 5) AS score
      FROM scored JOIN documents USING (doc_id) ORDER BY scored.score, length(source), doc_id LIMIT 10""",
    "search_exact_tier": "SELECT doc_id, lang AS name, 0 AS tier FROM documents WHERE lower(lang || '/' || source) = 'en/src3' OR lower(lang) = 'en/src3' ORDER BY doc_id LIMIT 15",
    "exact_or_fts": f"SELECT doc_id FROM documents WHERE lower(source) = 'src5' OR list_contains({_tokens('text')}, 'src5')",
    "token_score_rank": """SELECT doc_id, CAST(CASE WHEN contains(h, 'the') THEN 5 ELSE 0 END + CASE WHEN contains(h, 'src1') THEN 5 ELSE 0 END AS INTEGER) AS score
      FROM (SELECT doc_id, lower(source || ' ' || lang || ' ' || text) AS h FROM documents) ORDER BY 2 DESC, 1 LIMIT 25""",
    "members_in_order": """SELECT p_partkey, CAST(rank AS INTEGER) AS rank, owner_name, version, topic_path FROM (
        SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN 'Глобальный контекст' ELSE p_brand END AS owner_name, '8.3.' || p_size AS version, p_brand || '/' || p_partkey AS topic_path, p_brand || '.' || p_name AS full_name,
        CASE WHEN lower(p_brand || '.' || p_name) = q THEN 0 WHEN lower(p_name) = q THEN 1 WHEN lower(p_type) = q OR lower(p_brand) = q THEN 2 WHEN lower(p_brand || '.' || p_name) LIKE '%.' || q THEN 3 ELSE 4 END AS rank
        FROM part, (SELECT lower(min(p_name)) AS q FROM part)) WHERE rank < 4
        ORDER BY rank, CASE WHEN owner_name = 'Глобальный контекст' THEN 0 ELSE 1 END, p_size DESC, topic_path, full_name LIMIT 50""",
    "objects_in_order": """SELECT p_partkey, CAST(rank AS INTEGER) AS rank, version, topic_path FROM (
        SELECT p_partkey, p_size, '8.3.' || p_size AS version, p_brand || '/' || p_partkey AS topic_path, p_brand || '.' || p_name AS full_name,
        CASE WHEN lower(p_brand || '.' || p_name) = q THEN 0 WHEN lower(p_name) = q THEN 1 WHEN lower(p_type) = q OR lower(p_brand) = q THEN 2 ELSE 3 END AS rank
        FROM part, (SELECT lower(max(p_type)) AS q FROM part)) WHERE rank < 3 ORDER BY rank, p_size DESC, topic_path, full_name LIMIT 50""",
    "page_records": """SELECT p_partkey, CASE WHEN k < 2 THEN 'member' WHEN k = 2 THEN 'object' ELSE 'topic' END AS role, CASE k WHEN 0 THEN 'property' WHEN 1 THEN 'method' WHEN 2 THEN 'type' ELSE 'article' END AS kind,
        CASE WHEN k < 2 THEN p_brand ELSE '' END AS owner_name, CASE WHEN k < 2 THEN p_name ELSE '' END AS member_name, CASE WHEN k < 2 THEN p_brand || '.' ELSE '' END || p_name AS full_name, p_name || ' (' || p_partkey || ')' AS title,
        p_type AS summary, p_type AS description, CASE k WHEN 0 THEN p_brand || '.' || p_name ELSE '' END AS syntax, CASE WHEN k < 3 THEN p_brand ELSE '' END AS "returns",
        CASE k WHEN 0 THEN 'property/' WHEN 1 THEN 'method/' WHEN 2 THEN 'objects/' ELSE 'notes/' END || p_partkey AS topic_path FROM (SELECT *, p_size % 4 AS k FROM part)""",
    "flat_api_records": """SELECT p_partkey, CASE WHEN k < 2 THEN p_brand || '.' ELSE '' END || p_name AS name, CASE k WHEN 0 THEN 'property' WHEN 1 THEN 'method' WHEN 2 THEN 'type' ELSE 'topic' END AS kind, p_type AS description,
        CASE k WHEN 0 THEN p_brand || '.' || p_name ELSE '' END AS syntax, CASE WHEN k < 2 THEN p_brand ELSE '' END AS "returns", CAST(CASE WHEN k < 3 THEN 2 ELSE 0 END AS INTEGER) AS n_sections FROM (SELECT *, p_size % 4 AS k FROM part)""",
    "member_exact_rank": "SELECT p_partkey, CAST(CASE WHEN lower(p_type || '.' || p_name) = 'small ring' THEN 0 WHEN lower(p_name) = 'small ring' THEN 1 WHEN lower(p_brand) = 'small ring' OR lower(p_type) = 'small ring' THEN 2 ELSE 4 END AS INTEGER) AS rank FROM part",
    "any_field_lookup": "SELECT p_partkey FROM part WHERE p_name = 'Brand#2' OR p_brand = 'Brand#2' OR p_type = 'Brand#2'",
    "content_hash_merge": f"""WITH h AS (SELECT doc_id, lang, doc_id % 12 AS m, sha256(length({_normal('text')}) || chr(31) || {_normal('text')}) AS content_hash FROM documents),
      g AS (SELECT lang, content_hash, max(doc_id) AS doc_id, list_reverse(list_sort(list_distinct(list(m)))) AS ms FROM h GROUP BY lang, content_hash)
      SELECT {_id("'doc|' || lang || '|' || content_hash")} AS id, lang, content_hash, doc_id, '8.3.' || ms[1] AS version, array_to_string(list_transform(ms, lambda x: '8.3.' || x), ',') AS versions FROM g""",
    "latest_by_path": "SELECT max(event_id) AS event_id, user_id, '1.' || max(event_id) AS version FROM events GROUP BY user_id",
    "first_by_key": "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
    "dedup_results": "SELECT max(doc_id) AS doc_id, lang, arg_max(source, doc_id) AS source, sha256(text) AS content_hash FROM documents GROUP BY lang, sha256(text)",
    "distinct_ignoring_case": f"""WITH w AS (SELECT conv_id, turn, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM (SELECT conv_id, turn, string_split({_squeeze('text')}, ' ') AS t FROM conversations)),
      f AS (SELECT conv_id, turn, lower(w) AS k, min(i) AS i, arg_min(w, i) AS w FROM w GROUP BY conv_id, turn, lower(w)) SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY conv_id, turn""",
    "callees_topk": f"SELECT callee_name, count(*) AS n FROM ({_CALLS}) WHERE lower(caller_name) = 'user3' GROUP BY callee_name ORDER BY n DESC, callee_name LIMIT 12",
    "callers": f"SELECT 'm/' || module_id AS rel_path, line, caller_name, callee_name, args_count FROM ({_CALLS}) WHERE lower(callee_name) = 'click_3' ORDER BY 1, 2 LIMIT 40",
    "related_links": f"""SELECT {_id("caller_name || '|' || callee_name || '|calls'")} AS id, caller_name AS source_full_name, callee_name AS target_name, 'calls' AS link_kind, '' AS reason
      FROM (SELECT DISTINCT caller_name, callee_name FROM ({_CALLS})) WHERE caller_name = 'User5' ORDER BY callee_name LIMIT 30""",
    "link_extract": f"SELECT DISTINCT page_id, href, text FROM ({_LINKS})",
    "link_resolve": f"""WITH l AS (SELECT page_id, lower(ltrim(href, '/')) AS word FROM (SELECT DISTINCT page_id, href, text FROM ({_LINKS}))),
      t AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([a-z]+)[.]', 1)) AS host FROM pages UNION SELECT 'the')
      SELECT page_id, word, CASE WHEN word IN (SELECT host FROM t) THEN 'topic' ELSE 'topic_path' END AS target_lookup FROM l""",
    "breadcrumb_tree": """SELECT 'r' || r_regionkey AS id, 0 AS depth, r_name AS breadcrumb FROM region
      UNION ALL SELECT 'n' || n_nationkey, 1, r_name || ' / ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 's' || s_suppkey, 2, r_name || ' / ' || n_name || ' / ' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "folder_tree": f"SELECT DISTINCT array_to_string(p[1:n], '/') AS folder FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT string_split({_REL}, '/') AS p FROM pages))",
    "entries_blobs_left": "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)",
    "owner_parent_resolve": """SELECT l_orderkey, l_linenumber, n_name, coalesce(p_name, CAST(part AS VARCHAR)) AS type_name
      FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN l_partkey ELSE -l_partkey END AS part FROM lineitem) JOIN orders ON l_orderkey = o_orderkey
      LEFT JOIN customer ON CASE WHEN o_orderkey % 3 > 0 THEN o_custkey ELSE -o_custkey - 1 END = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON part = p_partkey""",
    "pack_stats": """SELECT 'page' AS entry_type, count(*) AS n, CAST(coalesce(sum(length(html)), 0) AS BIGINT) AS size_bytes FROM pages
      UNION ALL SELECT 'document', count(*), CAST(coalesce(sum(length(text)), 0) AS BIGINT) FROM documents""",
    "domain_counts": "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source",
    "ext_kind_counters": "SELECT regexp_extract(regexp_replace(url, '[?#].*$', ''), '//[^/]*[.]([a-z]+)/', 1) AS ext, CASE WHEN contains(html, '<table') THEN 'table' ELSE 'text' END AS kind, count(*) AS n FROM pages GROUP BY 1, 2",
    "bench_p95": """SELECT l_returnflag, round(avg(q), 6) AS average, max(CASE WHEN p = greatest(1, floor(n * 0.95)) THEN q END) AS at_quantile
      FROM (SELECT l_returnflag, l_quantity AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS p, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY l_returnflag""",
    "top_property_profile": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8",
    "resolution_ratio": """SELECT count(*) AS n_refs, count(c_custkey) AS n_resolved, round(count(c_custkey) / count(*), 6) AS ratio
      FROM orders LEFT JOIN customer ON CASE WHEN o_orderkey % 4 > 0 THEN o_custkey ELSE -o_custkey - 1 END = c_custkey""",
    "even_sample": """SELECT path FROM (SELECT path, i, n, greatest(1, n // 25) AS step FROM (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path,
      row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)) WHERE n <= 25 OR (i % step = 0 AND i < step * 24) OR i = n - 1""",
    "sample_verify": "SELECT doc_id FROM documents WHERE doc_id % 97 = 5",
    "coverage_gap": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
    "cosine_topk": """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
      SELECT vec_id, round(list_sum(list_transform(list_zip(v, e), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(e, lambda x: x * x)))), 6) AS cosine
      FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), (SELECT list_transform(e, lambda x: CAST(x AS DOUBLE)) AS e FROM q) ORDER BY cosine DESC, vec_id LIMIT 10""",
    "code_symbols": """WITH p AS (SELECT p_partkey AS i, CAST(p_partkey AS VARCHAR) AS k, p_name FROM part)
      SELECT i AS module_id, 'Get' || k AS name, 'function' AS kind, 2 AS line, 4 AS end_line, true AS is_export, 'Function Get' || k || '(A) Export' AS signature, 'Part ' || p_name AS doc_comment FROM p WHERE i % 3 = 0
      UNION ALL SELECT i, 'V' || k, 'variable', 5, 5, false, 'Var V' || k, '' FROM p WHERE i % 3 = 0
      UNION ALL SELECT i, 'Шаг' || k, 'procedure', 3, 7, true, 'Процедура Шаг' || k || '(А, Б = 1) Экспорт', p_name || ' Заметка (не вызов)' FROM p WHERE i % 3 = 1
      UNION ALL SELECT i, n || k, 'variable', 1, 1, true, 'Var ' || n || k, '' FROM p, (VALUES ('П'), ('К')) v(n) WHERE i % 3 = 2
      UNION ALL SELECT i, 'Run' || k, 'procedure', 2, 7, false, 'Procedure Run' || k || '()', '' FROM p WHERE i % 3 = 2""",
    "code_calls": """SELECT p_partkey AS module_id, caller || p_partkey AS caller_name, callee AS callee_name, line, args AS args_count FROM part,
      (VALUES (0, 'Get', 'Find', 3, 2), (0, 'Get', 'Sum', 3, 2), (1, 'Шаг', 'Тест', 4, 2), (2, 'Run', 'Log', 3, 3), (2, 'Run', 'Array', 5, 1), (2, 'Run', 'Min', 6, 2), (2, 'Run', 'Max', 6, 2))
      v(shape, caller, callee, line, args) WHERE p_partkey % 3 = shape""",
    "contents_breadcrumbs": """SELECT r_regionkey + 1 AS id, r_name AS title, '' AS breadcrumb FROM region
      UNION ALL SELECT n_nationkey + 10, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "configuration_fields": """SELECT 'A' || s_nationkey AS name, 'Catalog.S' || s_suppkey || '.A' || s_nationkey AS topic_path,
      'Catalog.S' || s_suppkey || ' S' || s_suppkey || ' A' || s_nationkey || ' Реквизит requisites' AS payload FROM supplier""",
    "event_windows": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "category_tree": f"""WITH p AS (
  SELECT page_id, 's' || (page_id % 20) AS shelf, 's' || (page_id % 20) || '/p' || page_id || '.html' AS path,
         coalesce(nullif({_squeeze("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")}, ''),
                  nullif({_squeeze("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')")}, ''), 'Untitled') AS title FROM pages WHERE page_id % 20 < 19),
l AS (SELECT DISTINCT shelf FROM p WHERE page_id % 20 % 2 = 0 AND page_id % 3 > 0)
SELECT shelf AS path, CAST(NULL AS VARCHAR) AS parent, CAST(row_number() OVER (ORDER BY shelf) - 1 AS INTEGER) AS position, shelf AS title, '' AS page, 0 AS depth, shelf AS breadcrumb
FROM (SELECT DISTINCT shelf FROM p)
UNION ALL SELECT path, shelf, CAST(row_number() OVER (PARTITION BY shelf ORDER BY page_id DESC) - 1 AS INTEGER), title, path, 1, shelf || ' / ' || title FROM p JOIN l USING (shelf) WHERE page_id % 3 > 0
UNION ALL SELECT path, shelf, NULL, title, path, 1, shelf || ' / ' || title FROM p WHERE shelf NOT IN (SELECT shelf FROM l)""",
    "help_books_found": """WITH n AS (
  SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'x' || (c_custkey % 4) || '/' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN '8.x' ELSE '8.3.' || (c_custkey % 23) END AS folder,
         'book ' || c_nationkey AS label, ['_ru', '_EN', ''][c_custkey % 5 % 3 + 1] AS tongue FROM customer),
b AS (SELECT *, string_split(folder, '/')[-1] AS version, folder || '/' || label || tongue || '.hbk' AS rel_path FROM n WHERE tongue <> ''),
s AS (
  SELECT DISTINCT folder, string_split(folder, '/')[-1] AS version, false AS asked FROM n WHERE regexp_matches(folder, '^[0-9]+([.][0-9]+){2,3}$')
  UNION ALL SELECT folder, version, true FROM (
    SELECT DISTINCT folder, string_split(folder, '/')[-1] AS version, row_number() OVER (PARTITION BY string_split(folder, '/')[-1] ORDER BY contains(folder, '/'), folder) AS k
    FROM (SELECT DISTINCT folder FROM n)) WHERE k = 1 AND version IN ('8.3.21', '8.x', '8.3.3', '9.9'))
SELECT rel_path, s.version, lower(tongue[2:]) AS language, replace(label, ' ', '_') || tongue AS stem, replace(label, ' ', '_') AS label, asked FROM b JOIN s USING (folder)""",
    "snapshot_fields": """WITH o AS (
  SELECT n_nationkey AS n, n_name, ['Document', 'Catalog', 'Constant', NULL][n_nationkey % 4 + 1] AS object_type FROM nation),
f AS (
  SELECT s_suppkey AS k, s_name, s_nationkey AS n, ['ТабличнаяЧасть', 'Реквизит', 'Измерение', 'Прочее'][s_suppkey % 4 + 1] AS kind,
         CASE WHEN s_suppkey % 4 = 1 THEN coalesce((SELECT n_name FROM nation WHERE n_nationkey = (s_nationkey + 1) % 30), 'o' || ((s_nationkey + 1) % 30)) END AS first_type FROM supplier)
SELECT object_type || '.' || n_name AS object_id, n_name AS object_name, object_type, '1' AS config_version,
       CASE WHEN t.k IS NOT NULL THEN 'tabular_section_requisites' ELSE ['tabular_sections', 'requisites', 'dimensions', 'properties'][f.k % 4 + 1] END AS "group",
       f.s_name AS name, f.kind, coalesce(f.first_type, '') AS type, coalesce(f.first_type || '|Строка', '') AS types, t.s_name AS tabular_section,
       CASE WHEN object_type = 'Constant' THEN 'Константы.' || n_name || '.Получить()' END AS constant_bsl_hint
FROM f JOIN o USING (n) LEFT JOIN f t ON f.k % 4 = 1 AND t.k = f.k - 1 WHERE object_type IS NOT NULL""",
    "parameter_lines": """
SELECT p_partkey, 0 AS n, CASE WHEN p_partkey % 3 = 1 THEN 'P' || p_partkey ELSE '<P' || p_partkey || '>' END AS name, p_brand AS type, p_name AS description FROM part
UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 3 = 1 THEN '<Q' || p_partkey || '>' ELSE 'last ' || p_partkey END, CASE WHEN p_partkey % 3 = 1 THEN '—' ELSE '' END, '' FROM part WHERE p_partkey % 3 > 0""",
    "typed_relations": """WITH s AS (
  SELECT s_suppkey % 4 AS k, s_suppkey AS n, s_name AS m,
         ['Глобальный контекст.' || s_name, 'ПеречислимыеСвойстваОбъектовМетаданных.' || s_name, 'ДокументМенеджер.<Имя документа>.' || s_name, 'ДокументыМенеджер'][s_suppkey % 4 + 1] AS f FROM supplier)
SELECT f AS source_full_name, ['', 'Метаданные.СвойстваОбъектов.', 'Документы.<Имя документа>.', 'Документы'][k + 1] || CASE WHEN k < 3 THEN m ELSE '' END AS target_name,
       'alias' AS target_lookup, CASE WHEN k = 3 THEN 'object' ELSE 'member' END AS source_lookup, 'surface_alias' AS link_kind FROM s
UNION ALL SELECT f, 'HTTPОтвет', 'object', 'member', 'returns_type' FROM s WHERE k = 0
UNION ALL SELECT f, 'ВидX' || n, 'object', 'member', unnest(['returns_type', 'metadata_enum_property_returns_system_enum']) FROM s WHERE k = 1""",
    "html_tables": """SELECT r_regionkey, '| ' || r_name || ' |  |' || chr(10) || '| --- | --- |' || chr(10) || rows AS markdown FROM region JOIN (
  SELECT n_regionkey AS r_regionkey, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY '<tr><td>' || n_nationkey || '<td>' || n_name) AS rows FROM nation GROUP BY 1) USING (r_regionkey)""",
    "hybrid_search": f"""WITH {_bm25(["and", "the"], ["text"])},
t AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS p FROM scored),
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
v AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS c FROM embeddings, q),
w AS (SELECT doc_id, row_number() OVER (ORDER BY c DESC, doc_id) AS p FROM v)
SELECT doc_id, round(coalesce(1.0 / (a.p + 60), 0.0) + coalesce(1.0 / (b.p + 60), 0.0), 9) AS score
FROM (SELECT * FROM t WHERE p <= 50) a FULL JOIN (SELECT * FROM w WHERE p <= 50) b USING (doc_id)""",
}
