"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

import math

from packwright.llm import url_filter as uf
from packwright.llm import licenses as lic
from packwright.llm.licenses import NOTICES, PHRASES, _distinct_words

_OP1 = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
w AS (
  SELECT DISTINCT item_id, len(words[s:s + least(len(words), 10) - 1]) AS n, array_to_string(words[s:s + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS s FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT n FROM w),
p AS (
  SELECT doc_id, n, s, array_to_string(words[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS s FROM d, lens WHERE len(words) >= n)),
h AS (SELECT DISTINCT p.doc_id, p.s, p.n, w.item_id FROM p JOIN w ON p.n = w.n AND p.win = w.win),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_OP2 = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(sha256('17|' || doc_id || '|document'), 1, 13) AS BIGINT) AS draw FROM documents),
s AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][(rank - 1) % 3 + 1] AS weight, rank,
         source_size * 2.0 AS cap, source_size * 2.0 / [3.0, 1.0, 2.0][(rank - 1) % 3 + 1] AS ratio
  FROM (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source)),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         CAST(least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1) * weight, cap)) AS DOUBLE) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
         least(4096, greatest(1, CAST(ceil(source_size / 200000.0) AS BIGINT))) AS blocks FROM t),
r AS (
  SELECT d.*, p.source_size, p.target, p.passes, CAST(floor(p.target) AS BIGINT) - p.passes * p.source_size AS rest, d.draw % p.blocks AS block
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source, block, sum(size) AS words, min(rest) AS rest FROM r GROUP BY source, block),
c AS (
  SELECT source, block, words, greatest(0, least(words, rest - before)) AS remains
  FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(sha256('17|' || coalesce(source, '') || '|' || block || '|permuted'), 1, 13) AS BIGINT), block) - words AS before FROM b)),
q AS (
  SELECT r.*, c.words, c.remains,
         sum(r.size) OVER (PARTITION BY r.source, r.block ORDER BY r.draw, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - r.size AS before
  FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.block = c.block)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + CASE WHEN remains <= 0 THEN 0 WHEN remains >= words THEN size ELSE greatest(0, least(size, remains - before)) END AS BIGINT) AS taken FROM q
"""

_OP4 = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[s:s + least(len(words), 4) - 1], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - least(len(words), 4) + 2)) AS s FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (
  SELECT i.a, i.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS overlap FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2) i
  JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * i.overlap >= 85 * (p.n + q.n - i.overlap)),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""

_OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


_CRC = """
  SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)),
         lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
"""


def _crc32(text: str) -> str:
    """SQL of the CRC of a text's bytes; the table of 256 remainders is a column named crc."""
    return f"""xor(4294967295, list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])))"""


_OP12 = f"""
WITH crc AS ({_CRC}),
t AS (SELECT false AS wanted, doc_id, text FROM documents UNION ALL SELECT true, NULL, text FROM benchmark),
w AS (
  SELECT wanted, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM t),
g AS (
  SELECT wanted, doc_id, array_to_string(words[s:s + n - 1], ' ') AS gram, count(*) AS times
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS s FROM w, range(1, 4) sizes(n) WHERE len(words) >= n) GROUP BY ALL),
h AS (SELECT gram, {_crc32("gram")} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM g), crc),
b AS (
  SELECT bucket, coalesce(sum(times) FILTER (NOT wanted), 0) AS s, coalesce(sum(times) FILTER (wanted), 0) AS t FROM g JOIN h USING (gram) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM b),
k AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(b.t + 1 AS DOUBLE) * CAST(a.s + 10000 AS DOUBLE) / (CAST(b.s + 1 AS DOUBLE) * CAST(a.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM b, a),
f AS (SELECT doc_id, sum(times) AS n_features, sum(times * gain) AS weight FROM g JOIN h USING (gram) JOIN k USING (bucket) WHERE NOT wanted GROUP BY doc_id),
o AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN f USING (doc_id) WHERE NOT wanted),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM o)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND place <= (SELECT count(*) * 5 // 100 FROM o WHERE n_words >= 20) THEN place END AS rank FROM r
"""

_TURN_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_OP11 = f"""
WITH RECURSIVE crc AS ({_CRC}),
x AS (
  SELECT coalesce('=' || conv_id, '') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_TURN_KEY)} % 20 AS hit
  FROM conversations, crc),
d AS (
  SELECT c, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM x),
o AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) AS t,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS ending, left(role, 1) AS kind FROM d),
p AS (
  SELECT *, ending = '' AS blank, ending <> '' AND row_number() OVER (PARTITION BY c, role, text ORDER BY t) > 1 AS repeated,
         coalesce(lag(kind) OVER (PARTITION BY c ORDER BY t) || kind NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
m AS (
  SELECT *, blank OR repeated AS goes, NOT blank AND NOT repeated AND ending NOT IN ('.', '!', '?') AS cut,
         CASE kind WHEN 's' THEN [2, NULL, NULL, NULL] WHEN 'u' THEN [3, 3, NULL, 3] WHEN 'a' THEN [NULL, NULL, 4, NULL] ELSE [CAST(NULL AS INT), NULL, NULL, NULL] END AS keep,
         CASE WHEN NOT blank AND NOT repeated AND ending NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS more FROM p),
n AS (SELECT c, count(*) AS n FROM m GROUP BY c),
b AS (
  SELECT c, n + 1 AS t, [0, 4, 2, 0] AS v FROM n
  UNION ALL
  SELECT c, t, [least(r[1], 2 + r[3], 4 + r[4]), least(r[2], 2 + r[3], 4 + r[4]), least(r[3], 2 + r[4]), least(r[4], 2 + r[3])]
  FROM (SELECT m.c, m.t, list_transform([1, 2, 3, 4], lambda s: least(3 + b.v[s], CASE WHEN goes THEN 1000000 ELSE more + least(2 + b.v[[3, 3, 4, 3][s]], coalesce(b.v[keep[s]], 1000000)) END)) AS r
        FROM b JOIN m ON m.c = b.c AND m.t = b.t - 1)),
f AS (
  SELECT c, CAST(1 AS BIGINT) AS t, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS parts FROM n
  UNION ALL
  SELECT c, CASE WHEN e = 'I' THEN t ELSE t + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN k ELSE x END, audit || e,
         CASE e WHEN 'D' THEN parts WHEN 'K' THEN list_append(parts, role || ':' || text) WHEN 'R' THEN list_append(parts, r || ':' || text) ELSE list_append(parts, r || ':') END
  FROM (SELECT f.c, f.t, f.s, f.audit, f.parts, m.role, m.text, m.keep[f.s] AS k, [3, 3, 4, 3][f.s] AS x, CASE f.s WHEN 3 THEN 'assistant' ELSE 'user' END AS r,
               CASE WHEN m.c IS NOT NULL AND 3 + a.v[f.s] = b.v[f.s] THEN 'D' WHEN 2 + b.v[[3, 3, 4, 3][f.s]] = b.v[f.s] THEN 'I'
                    WHEN NOT m.goes AND more + a.v[m.keep[f.s]] = b.v[f.s] THEN 'K' ELSE 'R' END AS e
        FROM f JOIN b ON b.c = f.c AND b.t = f.t LEFT JOIN m ON m.c = f.c AND m.t = f.t LEFT JOIN b a ON a.c = f.c AND a.t = f.t + 1
        WHERE m.c IS NOT NULL OR b.v[f.s] > 0)),
g AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (repeated) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal FROM m GROUP BY c),
e AS (SELECT f.c, f.audit, f.parts, z.v[1] AS cost FROM f JOIN n USING (c) JOIN b ON b.c = f.c AND b.t = f.t JOIN b z ON z.c = f.c AND z.t = 1 WHERE f.t = n + 1 AND b.v[f.s] = 0)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(parts, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS c FROM conversations) i LEFT JOIN g USING (c) LEFT JOIN e USING (c)
"""


def _op13() -> str:
    ordered = sorted(uf.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in ordered]
    rule = " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    ruled = " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    levels = []
    for k in range(1, uf.DEPTH + 2):
        levels.append(f"""
a{k} AS (SELECT *, segments[{k}] AS step FROM l{k - 1} WHERE len(segments) >= {k}),
n{k} AS (
  SELECT host, node, count(*) > {uf.MOST_CHILDREN} OR (count(*) >= {uf.MANY_CHILDREN} AND sum(n) < {uf.SEEN} * count(*)) AS variable
  FROM (SELECT host, node, step, sum(n) AS n FROM a{k} GROUP BY ALL) GROUP BY host, node),
w{k} AS (SELECT a{k}.* REPLACE (CASE WHEN variable THEN '*' ELSE step END AS step) FROM a{k} JOIN n{k} USING (host, node)),
e{k} AS (SELECT host, node, step, sum(blocked) AS blocked, sum(labelled) AS labelled, min(share) AS share FROM w{k} GROUP BY host, node, step),
o{k} AS (SELECT *, CAST(blocked AS DOUBLE) / labelled AS own FROM e{k} WHERE labelled > 0),
p{k} AS (SELECT *, lag(own) OVER w AS pown, lag(labelled) OVER w AS plab FROM o{k} WINDOW w AS (PARTITION BY host, node ORDER BY own, step)),
q{k} AS (SELECT *, (pown * plab + own * labelled) / (plab + labelled) AS pooled FROM p{k}),
g{k} AS (
  SELECT *, sum(coalesce(CAST(own - pown > {uf.APART} * sqrt(pooled * (1 - pooled) * (1 / CAST(plab AS DOUBLE) + 1 / CAST(labelled AS DOUBLE))) AS INT), 0))
         OVER (PARTITION BY host, node ORDER BY own, step) AS branch FROM q{k}),
m{k} AS (
  SELECT host, node, step, share, node || '/' || min(step) OVER w || CASE WHEN count(*) OVER w > 1 THEN '|' ELSE '' END AS child,
         sum(blocked) OVER w AS blocked, sum(labelled) OVER w AS labelled FROM g{k} WINDOW w AS (PARTITION BY host, node, branch)
  UNION ALL SELECT host, node, step, share, node || '/' || step, blocked, labelled FROM e{k} WHERE labelled = 0),
l{k} AS (
  SELECT host, segments, n, w{k}.blocked, w{k}.labelled, m{k}.child AS node, (m{k}.blocked + {uf.PRIOR} * m{k}.share) / (m{k}.labelled + {uf.PRIOR}) AS share
  FROM w{k} JOIN m{k} USING (host, node, step))""")
    found = " UNION ALL ".join(f"SELECT host, segments, node, share FROM l{k} WHERE len(segments) = {k}" for k in range(uf.DEPTH + 2))
    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (
  SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled, regexp_matches(host, '(^|[.-])({'|'.join(uf.HOST_WORDS)})([.-]|$)') AS suspect, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u),
s AS (
  SELECT *, list_concat(list_transform(parts[:{uf.DEPTH}], lambda x: regexp_replace(x, '[0-9a-fA-F]{{12,}}|[0-9]+', '#', 'g')),
         CASE WHEN len(parts) > {uf.DEPTH} THEN ['**'] ELSE [] END) AS segments FROM r),
c AS (
  SELECT host, segments, count(*) AS n, count(*) FILTER (ruled = 'block' OR ruled IS NULL AND suspect) AS blocked, count(*) FILTER (ruled IS NOT NULL OR suspect) AS labelled FROM s GROUP BY host, segments),
h AS (
  SELECT host, (sum(blocked) + {uf.PRIOR} * {uf.EVEN}) / (sum(labelled) + {uf.PRIOR}) AS share FROM c GROUP BY host),
l0 AS (SELECT c.*, '' AS node, share FROM c JOIN h USING (host)),{",".join(levels)},
f AS ({found})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN share >= {uf.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, node AS template, round(share, 6) AS purity
FROM s JOIN f USING (host, segments)
"""


def _op9(threshold: float = 0.9) -> str:
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES)
    rows = [(label, _distinct_words(text), text) for label, text in NOTICES]
    texts = lambda x: f"CAST({x!r} AS VARCHAR[])"
    notices = ", ".join(
        f"('{label}', {ws!r}, {math.ceil(threshold * len(ws) - 1e-9)}, {texts(lic.deciding(t))}, {texts(lic.versions(t))}, {texts(lic.neighbours(t))})" for label, ws, t in rows
    )
    line = "line"
    for a, b in lic.SPELT:
        line = f"replace({line}, '{a}', '{b}')"
    own = ", ".join(f"CASE WHEN contains(line, ' {'gnu ' if w == 'library' else ''}{w} ') THEN '{w}' END" for w in lic.DECIDING)
    return f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{_SEPARATORS}'), lambda w: w <> '') AS words FROM d),
p AS (
  SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w), (VALUES {phrases}) f(phrase, n, label)
  WHERE i + n - 1 <= len(words) AND array_to_string(words[i:i + n - 1], ' ') = phrase),
b AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels
  FROM p GROUP BY doc_id),
s AS (
  SELECT doc_id, row_number() OVER () AS block, list_filter(regexp_split_to_array(sentence, '{_SEPARATORS}'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(t, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), '\n[\x00\x02-\x2F\x3A-\x60\x7B-\x7F]*\n', chr(1), 'g'), chr(1))) AS sentence FROM d)),
m AS (
  SELECT *, len(list_intersect(list_distinct(ws), words)) AS shared, len(words) AS n, ' ' || array_to_string(ws, ' ') || ' ' AS raw FROM s, (VALUES {notices}) f(label, words, needed, deciding, versions, pairs)),
c AS (SELECT * REPLACE ({line.replace("line", "raw", 1)} AS raw) FROM m WHERE shared >= needed),
k AS (
  SELECT *, CAST(shared AS DOUBLE) / n AS part,
         CAST(len(list_intersect(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), pairs)) AS DOUBLE) / len(pairs) AS beside
  FROM (SELECT *, raw AS line FROM c) WHERE list_filter([{own}], lambda x: x IS NOT NULL) = deciding AND (len(versions) = 0 OR list_sort(list_distinct(regexp_extract_all(line, '{lic.VERSION}', 1))) = versions)),
f AS (SELECT doc_id, label, part FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY part DESC, beside DESC, label) AS r FROM k WHERE beside >= {lic.NEIGHBOURS}) WHERE r = 1),
l AS (SELECT doc_id, label FROM f UNION SELECT doc_id, label FROM p)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word,
       CAST(b.last_word AS BIGINT) AS last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(g.part, 0.0) END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN (SELECT doc_id, array_to_string(list_sort(list(label)), ',') AS labels FROM l GROUP BY doc_id) a USING (doc_id)
LEFT JOIN (SELECT doc_id, max(part) AS part FROM f GROUP BY doc_id) g USING (doc_id)
"""


_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": _OP1,
    "op2_source_mixing": _OP2,
    "op4_ngram_jaccard_join": _OP4,
    "op7_exact_topk": _OP7,
    "op9_license_scans": _op9(),
    "op11_conversation_repair": _OP11,
    "op12_importance_resampling": _OP12,
    "op13_url_filters": _op13(),
}
