"""The same results in plain SQL over the driver tables, written independently of the plans."""

from __future__ import annotations

FILES = """
files AS (SELECT doc_id, source, lang, text, source || '/' || lang || '/' || doc_id || '.txt' AS file FROM documents)
"""

LINES = FILES + """,
split AS (SELECT doc_id, source, lang, file, text,
    CASE WHEN text = '' THEN []::VARCHAR[]
         WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2]
         ELSE string_split(text, chr(10)) END AS ls FROM files),
lines AS (SELECT doc_id, source, lang, file, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM split)
"""

# The code view by its own rules: only the first and third line of every five end up commented.
CODE = LINES + """,
code AS (SELECT doc_id, source, file, line_no, line_no % 5 AS shape, regexp_extract(line, '[A-Za-z]+') AS w FROM lines),
includes AS (SELECT w || '.h' AS basename,
    CASE shape WHEN 0 THEN source || '/' || w || '.h' WHEN 3 THEN source || '\\' || w || '.h' ELSE w || '.h' END AS include_target,
    source AS module_path, file, CAST(line_no AS INTEGER) AS line,
    CASE shape WHEN 0 THEN '#include "' || source || '/' || w || '.h"' WHEN 1 THEN '#include <' || w || '.h>'
         WHEN 3 THEN '#include <' || source || '\\' || w || '.h>' ELSE '#include "' || w || '.h"' END AS raw,
    shape IN (1, 3) AS commented
    FROM code WHERE shape <> 2)
"""

FRAGMENTS = CODE + """,
frags AS (SELECT doc_id, source, file, line_no, 0 AS idx, 'include' AS fragment FROM code WHERE shape IN (1, 3)
    UNION ALL SELECT doc_id, source, file, line_no, 1 AS idx, w FROM code WHERE shape IN (1, 2, 3) AND length(w) >= 6)
"""


def symbols(base: str) -> str:
    return base + """,
firsts AS (SELECT name, doc_id, file, min(line_no) AS line FROM
    (SELECT doc_id, file, line_no, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM lines)
    GROUP BY name, doc_id, file),
per_name AS (SELECT name, min(doc_id) AS doc_id FROM firsts GROUP BY name),
defs AS (SELECT f.name, f.file, CAST(f.line AS INTEGER) AS line, string_split(f.file, '/')[1] AS module_path,
    CASE WHEN regexp_matches(f.name, '^[A-Z][A-Z0-9_]*$') THEN 'macro' WHEN regexp_matches(f.name, '^[A-Z]') THEN 'class'
         ELSE 'member' END AS kind
    FROM firsts f JOIN per_name p ON f.name = p.name AND f.doc_id = p.doc_id)
"""


def references() -> str:
    return symbols(LINES) + """,
runs AS (SELECT file, source, line_no, line, regexp_extract_all(line, '[A-Za-z0-9_]+') AS ws FROM lines),
hits AS (SELECT file, source, line_no, line, unnest(ws) AS name, unnest(range(0, len(ws))) AS pos FROM runs),
refs AS (SELECT h.name, h.source AS module_path, h.file, CAST(h.line_no AS INTEGER) AS line, CAST(h.pos AS INTEGER) AS position,
    h.line AS src FROM hits h JOIN defs d ON h.name = d.name WHERE NOT (h.file = d.file AND h.line_no = d.line))
"""


PATHS = """
paths AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path FROM pages)
"""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

_PIECES = (
    "regexp_extract_all(regexp_replace(regexp_replace(part, '[A-Z]([0-9])', ' \\1', 'g'), "
    "'([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+')"
)
TOKENS = """
words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM documents),
parts AS (SELECT doc_id, unnest(string_split(word, '_')) AS part FROM words),
pieces AS (SELECT doc_id, unnest(CASE WHEN len(""" + _PIECES + """) = 0 THEN [part] ELSE """ + _PIECES + """ END) AS piece
    FROM parts WHERE part <> ''),
tokens AS (SELECT doc_id, lower(piece) AS token FROM pieces)
"""

BM25 = TOKENS + """,
docs AS (SELECT doc_id, CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 2 = 0 THEN 'module' ELSE 'symbol' END AS kind
    FROM documents),
lengths AS (SELECT d.kind, d.doc_id, count(t.token) AS dl FROM docs d LEFT JOIN tokens t USING (doc_id) GROUP BY ALL),
totals AS (SELECT kind, count(*) AS n, sum(dl) / count(*) AS avgdl FROM lengths GROUP BY kind),
tfs AS (SELECT d.kind, t.doc_id, t.token, count(*) AS tf FROM tokens t JOIN docs d USING (doc_id) GROUP BY ALL),
dfs AS (SELECT kind, token, count(*) AS df FROM tfs GROUP BY ALL),
raw_idf AS (SELECT f.kind, f.token, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM dfs f JOIN totals USING (kind)),
floors AS (SELECT kind, 0.25::DOUBLE * avg(idf) AS least FROM raw_idf GROUP BY kind),
query AS (SELECT unnest(['the', 'hentive', 'ci', 'nllcita', 'mente', 'unger', 'reou', 'mente']) AS token),
scored AS (SELECT f.kind, f.doc_id, sum((CASE WHEN i.idf < 0 THEN fl.least ELSE i.idf END)
        * (f.tf * 2.5::DOUBLE / (f.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / t.avgdl)))) AS score
    FROM query q JOIN tfs f ON f.token = q.token JOIN raw_idf i ON i.kind = f.kind AND i.token = f.token
    JOIN floors fl ON fl.kind = f.kind JOIN lengths l ON l.doc_id = f.doc_id JOIN totals t ON t.kind = f.kind GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, doc_id) AS rank FROM scored)
    WHERE rank <= 20 AND score > 0)
"""

DENSE = """
vectors AS (SELECT vec_id AS doc_id, CASE WHEN vec_id % 2 = 0 THEN 'module' ELSE 'symbol' END AS kind, embedding FROM embeddings),
gaps AS (SELECT v.kind, v.doc_id, list_sum(list_transform(range(1, len(v.embedding) + 1),
        lambda i: pow(v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2))) AS distance
    FROM vectors v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY distance, doc_id) AS rank FROM gaps) WHERE rank <= 20)
"""

FUSED = BM25 + "," + DENSE + """,
both_ AS (SELECT kind, doc_id, rank, 0 AS src FROM bm25 UNION ALL SELECT kind, doc_id, rank, 1 FROM dense),
sums AS (SELECT kind, doc_id, sum(1.0::DOUBLE / (rank + 60)) AS rrf, min(CASE WHEN src = 0 THEN rank END) AS br,
    min(CASE WHEN src = 1 THEN rank END) AS dr FROM both_ GROUP BY ALL),
fused AS (SELECT kind, doc_id, rrf, row_number() OVER (PARTITION BY kind
    ORDER BY rrf DESC, br IS NULL, coalesce(br, dr)) AS rank FROM sums)
"""

SQL: dict[str, str] = {}

SQL["q01_lines_per_module"] = "WITH " + LINES + """
SELECT source AS module_path, count(*) AS files, CAST(sum(len(ls)) AS BIGINT) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars
FROM split GROUP BY source"""

SQL["q02_list_modules"] = """
SELECT source AS module_path, upper(source) AS module_name, min(lang) AS module_type FROM documents GROUP BY source"""

SQL["q03_list_directory"] = "WITH " + PATHS + """,
items AS (SELECT string_split(path, '/')[1] AS name, CASE WHEN bool_or(contains(path, '/')) THEN 'dir' ELSE 'file' END AS type
    FROM paths GROUP BY 1)
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY lower(name), name) AS INTEGER) AS rank, name, type,
    (SELECT count(*) FROM items) AS item_count, (SELECT count(*) FROM items) > 80 AS truncated FROM items) WHERE rank <= 80"""

SQL["q04_find_files"] = "WITH " + PATHS + """
SELECT * FROM (SELECT path, CAST(row_number() OVER (ORDER BY lower(path), path) AS INTEGER) AS rank FROM paths
WHERE contains(lower(string_split(path, '/')[-1]), '7')) WHERE rank <= 40"""

SQL["q05_search_text"] = "WITH " + LINES + """,
hits AS (SELECT file AS relative_path, CAST(line_no AS INTEGER) AS line_number, line,
    CAST(row_number() OVER (ORDER BY lower(file), file, line_no) AS INTEGER) AS rank
    FROM lines WHERE source = 'src3' AND contains(line, 'tion'))
SELECT *, (SELECT count(*) FROM hits) >= 50 AS truncated FROM hits WHERE rank <= 50"""

SQL["q06_read_window"] = "WITH " + LINES + """,
asked AS (SELECT file, ls, len(ls) AS total, doc_id * 5 % 23 + 1 AS a, doc_id * 7 % 260 + 1 AS b FROM split),
ordered AS (SELECT *, least(a, b) AS s, greatest(a, b) AS e FROM asked),
cut AS (SELECT file, ls, total, e - s + 1 > 200 AS truncated, CASE WHEN total > 0 THEN least(s, total) ELSE 1 END AS s2,
    CASE WHEN total > 0 THEN least(least(e, s + 199), total) ELSE 0 END AS e2 FROM ordered)
SELECT file, CAST(total AS INTEGER) AS total_lines, CAST(s2 AS INTEGER) AS start_line, CAST(e2 AS INTEGER) AS end_line, truncated,
    coalesce(array_to_string(ls[s2:e2], chr(10)), '') AS content,
    CAST(length(coalesce(array_to_string(ls[s2:e2], chr(10)), '')) AS INTEGER) AS characters_read FROM cut"""

SQL["q07_longest_prefix"] = "WITH " + PATHS + """,
mods AS (SELECT DISTINCT string_split(path, '/')[1] AS m FROM paths WHERE len(string_split(string_split(path, '/')[1], '.')) > 3
    UNION SELECT DISTINCT string_split(path, '/')[1] || '/en' FROM paths WHERE string_split(path, '/')[2] = 'en')
SELECT page_id, path, (SELECT m FROM mods WHERE path = m OR starts_with(path, m || '/') ORDER BY length(m) DESC LIMIT 1) AS module_path
FROM paths"""

SQL["q08_include_facts"] = "WITH " + CODE + "SELECT * FROM includes"

SQL["q09_include_lookup"] = "WITH " + CODE + """,
hit AS (SELECT * FROM includes WHERE basename = 'The.h')
SELECT 'module' AS facet, module_path AS key, count(*) AS refs FROM hit GROUP BY ALL
UNION ALL SELECT 'writing', include_target, count(*) FROM hit GROUP BY ALL
UNION ALL SELECT 'total', 'The.h', count(*) FROM hit HAVING count(*) > 0"""

SQL["q10_top_headers"] = r"""
WITH links AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages),
named AS (SELECT regexp_extract(rtrim(replace(target, '\', '/'), '/'), '[^/]*$') AS basename FROM links),
counted AS (SELECT basename, count(*) AS refs FROM named WHERE basename <> '' GROUP BY basename)
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY refs DESC, basename) AS INTEGER) AS rank, basename, refs FROM counted) WHERE rank <= 10"""

SQL["q10_top_headers_commented"] = "WITH " + CODE + """,
counted AS (SELECT basename, count(*) AS refs, count(*) FILTER (WHERE commented) AS commented_refs FROM includes GROUP BY basename)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY refs DESC, basename) AS INTEGER) AS rank FROM counted) WHERE rank <= 10"""

SQL["q11_symbol_facts"] = "WITH " + symbols(LINES) + "SELECT name, module_path, file, line, kind FROM defs"

SQL["q11_kind_distribution"] = "WITH " + symbols(LINES) + """
SELECT k AS kind, (SELECT count(*) FROM defs WHERE kind = k) AS n
FROM (SELECT unnest(['class', 'function', 'member', 'macro', 'enum', 'namespace']) AS k)
UNION ALL SELECT 'no_module', count(*) FROM defs WHERE module_path IS NULL"""

SQL["q12_find_definition"] = "WITH " + symbols(LINES) + """
SELECT name, module_path, file, line, kind FROM defs WHERE name = 'Anhaha'"""

SQL["q13_symbols_in_module"] = "WITH " + symbols(LINES) + """
SELECT name, kind, string_split(file, '/')[-1] AS file, line FROM defs WHERE module_path = 'src3' AND kind = 'class'"""

SQL["q14_reference_facts"] = "WITH " + references() + "SELECT name, module_path, file, line, position FROM refs"

SQL["q14_literal_references"] = r"""
WITH lines AS (SELECT 'part/' || p_partkey AS file, p_brand || ' ~' || p_name || ' ' || p_type || ' ' || p_brand AS line FROM part),
names AS (SELECT unnest(['Brand#2', 'Brand#12', '~hot', '~blue ring', '~large']) AS name),
counted AS (SELECT name, file,
    CAST(len(regexp_extract_all(' ' || replace(line, ' ', '  ') || ' ', '[^A-Za-z0-9_]' || replace(name, ' ', '  ') || '[^A-Za-z0-9_]')) AS INTEGER) AS n
    FROM lines, names)
SELECT name, file, 1 AS line, CAST(unnest(range(0, n)) AS INTEGER) AS position FROM counted WHERE n > 0"""

SQL["q15_reference_summary"] = "WITH " + references() + """
SELECT name, count(*) AS ref_count, count(DISTINCT module_path) AS module_count FROM refs GROUP BY name"""

SQL["q15_top_referenced"] = "WITH " + references() + """,
s AS (SELECT name, count(*) AS ref_count, count(DISTINCT module_path) AS module_count FROM refs GROUP BY name)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY ref_count DESC, name) AS INTEGER) AS rank FROM s) WHERE rank <= 10"""

SQL["q15_sample_references"] = "WITH " + references() + """
SELECT name, CAST(rank AS INTEGER) AS rank, module_path, file, line, substring(trim(src, """ + BLANKS + """), 1, 200) AS context FROM
    (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, line, position) AS rank FROM refs) WHERE rank <= 5"""

SQL["q15_scoped_references"] = "WITH " + references() + """
SELECT name, module_path, count(*) AS refs FROM refs WHERE module_path = 'src3' GROUP BY ALL"""

# A name is unreferenced if its only line is the one of its definition, or none.
SQL["q16_unreferenced"] = "WITH " + symbols(LINES).replace("defs AS (", "defs AS MATERIALIZED (") + """,
spots AS MATERIALIZED (SELECT DISTINCT file, line_no, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS name FROM lines),
counts AS (SELECT name, count(*) AS n FROM spots GROUP BY name),
own AS (SELECT s.name, count(*) AS n FROM spots s JOIN defs d ON s.name = d.name AND s.file = d.file AND s.line_no = d.line GROUP BY s.name)
SELECT d.name FROM defs d LEFT JOIN counts c ON c.name = d.name LEFT JOIN own o ON o.name = d.name
WHERE coalesce(c.n, 0) = coalesce(o.n, 0)"""

SQL["q17_preferred_definition"] = "WITH " + symbols(LINES) + """,
kinds AS (SELECT ['typedef', 'function', 'class', 'member', 'macro', 'enum', 'struct', 'namespace', 'prototype', 'variable'] AS k,
    ['class', 'struct', 'namespace', 'enum', 'function', 'member', 'macro', 'enumerator', 'prototype'] AS pref),
ranked AS (SELECT name, file, line, k[doc_id % 10 + 1] AS kind, coalesce(list_position(pref, k[doc_id % 10 + 1]), 99) AS r FROM firsts, kinds)
SELECT name, file, CAST(line AS INTEGER) AS line, kind FROM
    (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN r = 0 THEN 99 ELSE r END, file, line) AS n FROM ranked) WHERE n = 1"""

# Windows of 61 lines over bands of 61: two bands each, so all joins are on equal keys.
RELATED = symbols(FRAGMENTS).replace("defs AS (", "defs AS MATERIALIZED (").replace("frags AS (", "frags AS MATERIALIZED (") + """,
windows AS (SELECT name, file, line, unnest(range((line - 30 + 61) // 61, (line + 30 + 61) // 61 + 1)) AS band FROM defs),
banded AS (SELECT file, fragment, line_no, idx, (line_no + 61) // 61 AS band FROM frags),
near AS (SELECT d.name, f.fragment, min(f.line_no * 10 + f.idx) AS spot FROM windows d JOIN banded f
    ON f.file = d.file AND f.band = d.band WHERE f.line_no BETWEEN d.line - 30 AND d.line + 30 GROUP BY ALL),
joined AS (SELECT name, string_agg(fragment, ' ' ORDER BY spot) AS all_ FROM near GROUP BY name),
related AS (SELECT d.name, substring(coalesce(j.all_, ''), 1, 1000) AS related FROM defs d LEFT JOIN joined j ON j.name = d.name)
"""
SQL["q18_related_comments"] = "WITH " + RELATED + "SELECT name, related FROM related"

SQL["q18_module_comments"] = "WITH " + FRAGMENTS + """,
firsts AS (SELECT source, fragment, min((file, line_no, idx)) AS spot FROM frags GROUP BY ALL)
SELECT source AS module_path, substring(string_agg(fragment, ' ' ORDER BY spot), 1, 5000) AS comments FROM firsts GROUP BY source"""

NAME_TOKENS = (
    "array_to_string(list_transform(list_filter(range(1, len(toks) + 1), lambda i: list_position(toks, toks[i]) = i), "
    "lambda i: toks[i]), ' ')"
)
SPLIT_NAME = (
    "flatten(list_transform(list_filter(regexp_split_to_array(name, '[_./-]'), lambda p: p <> ''), lambda p: "
    "CASE WHEN regexp_matches(p, '[A-Za-z0-9]') THEN list_transform(regexp_extract_all(regexp_replace(p, '([A-Z])([A-Z][a-z])', "
    "'\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda t: lower(t)) ELSE [lower(p)] END))"
)
SQL["q19_name_tokens"] = """
WITH titled AS (SELECT *, array_to_string(list_transform(string_split(p_name, ' '),
    lambda w: upper(w[1]) || lower(w[2:])), '') AS title FROM part),
forms AS (SELECT p_partkey, [title, replace(p_name, ' ', '_'), upper(p_type) || title, p_brand,
    lower(p_type) || '/v' || p_size || '/HTTPServer2.h'] AS fs FROM titled),
names AS (SELECT p_partkey, unnest(fs) AS name, CAST(unnest(range(0, 5)) AS INTEGER) AS form FROM forms),
cut AS (SELECT *, """ + SPLIT_NAME + """ AS toks FROM names)
SELECT p_partkey, form, name, """ + NAME_TOKENS + """ AS tokens FROM cut"""

SQL["q20_token_frequencies"] = "WITH " + TOKENS + "SELECT token, count(*) AS n FROM tokens GROUP BY token"

SQL["q21_bm25"] = "WITH " + BM25 + "SELECT kind, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM bm25"
SQL["q22_nearest"] = "WITH " + DENSE + "SELECT kind, CAST(rank AS INTEGER) AS rank, doc_id, round(distance, 6) AS distance FROM dense"
SQL["q21_stored_bm25"] = SQL["q21_bm25"]
SQL["q22_stored_nearest"] = SQL["q22_nearest"]
SQL["q21_index_upkeep"] = "WITH " + BM25 + "SELECT kind, token, CAST(count(*) AS BIGINT) AS df FROM tfs GROUP BY kind, token"
SQL["q23_fusion"] = "WITH " + FUSED + "SELECT kind, CAST(rank AS INTEGER) AS rank, doc_id, round(rrf, 6) AS rrf FROM fused"

SQL["q24_hybrid"] = "WITH " + FUSED + """,
named AS (SELECT f.*, d.source AS module_path, 'doc' || f.doc_id AS name FROM fused f JOIN documents d USING (doc_id)),
best AS (SELECT module_path AS key, min(rank) AS rank, arg_min(rrf, rank) AS rrf FROM named WHERE kind = 'module' GROUP BY module_path),
m AS (SELECT 'module' AS side, key, rrf, row_number() OVER (ORDER BY rank) AS position FROM best),
s AS (SELECT 'symbol' AS side, name AS key, rrf, row_number() OVER (ORDER BY rank) AS position FROM named WHERE kind = 'symbol')
SELECT side, CAST(position AS INTEGER) AS position, key, round(rrf, 4) AS score FROM (SELECT * FROM m UNION ALL SELECT * FROM s)
WHERE position <= 5"""

SQL["q24_hit_counts"] = "WITH " + BM25 + "," + DENSE + """
SELECT (SELECT count(*) FROM bm25 WHERE kind = 'module') AS bm25_module_hits,
    (SELECT count(*) FROM dense WHERE kind = 'module') AS dense_module_hits,
    (SELECT count(*) FROM bm25 WHERE kind = 'symbol') AS bm25_symbol_hits,
    (SELECT count(*) FROM dense WHERE kind = 'symbol') AS dense_symbol_hits"""

SYMBOL_DOCS = RELATED + """,
cut AS (SELECT d.*, r.related, d.name AS full_name, """ + SPLIT_NAME.replace("(name,", "(d.name,") + """ AS toks
    FROM defs d JOIN related r ON r.name = d.name),
symbol_docs AS (SELECT 'symbol:' || name AS doc_id, module_path, '[symbol] ' || name || chr(10) || 'kind: ' || kind || chr(10)
    || 'file: ' || file || chr(10) || 'module_path: ' || module_path || chr(10) || 'name_tokens: ' || """ + NAME_TOKENS + """
    || chr(10) || 'signature: ' || chr(10) || chr(10) || 'related_chinese:' || chr(10) || related AS text, related <> '' AS has_comments FROM cut)
"""
SQL["q25_symbol_documents"] = "WITH " + SYMBOL_DOCS + "SELECT * FROM symbol_docs"

SQL["q25_corpus_stats"] = "WITH " + SYMBOL_DOCS + """,
mods AS (SELECT DISTINCT source AS m FROM documents),
meta AS (SELECT m, length('[module] ' || m || chr(10) || 'module_name: ' || upper(m) || chr(10) || 'module_type: ' || chr(10)
    || 'path_tokens: src ' || substring(m, 4) || chr(10) || 'key_files: ' || m || '/main.cpp' || chr(10) || 'config_files: ' || chr(10)
    || 'doc_files: ') AS n FROM mods),
cfirst AS (SELECT source, fragment, min((file, line_no, idx)) AS spot FROM frags WHERE doc_id % 3 <> 0 GROUP BY ALL),
comments AS (SELECT source AS m, length('[module-comments] ' || source || chr(10) || substring(string_agg(fragment, ' ' ORDER BY spot), 1, 5000)) AS n
    FROM cfirst GROUP BY source),
doc_texts AS (SELECT source AS m, length('[module-docs] ' || source) + sum(1 + length(text)) AS n FROM documents
    WHERE doc_id % 3 = 0 AND text <> '' GROUP BY source),
sym AS (SELECT count(*) AS c, count(*) FILTER (WHERE has_comments) AS h, sum(length(text)) AS n FROM symbol_docs)
SELECT (SELECT count(*) FROM meta) + (SELECT count(*) FROM comments) + (SELECT count(*) FROM doc_texts) AS module_docs,
    (SELECT count(*) FROM meta) AS module_meta_docs, (SELECT count(*) FROM comments) AS module_comments_docs,
    (SELECT count(*) FROM doc_texts) AS module_document_docs, sym.c AS symbol_docs,
    (SELECT count(*) FROM meta) + (SELECT count(*) FROM comments) + (SELECT count(*) FROM doc_texts) + sym.c AS total_docs,
    (SELECT count(*) FROM comments) AS module_with_comments, sym.h AS symbol_with_comments,
    CAST((SELECT sum(n) FROM meta) + (SELECT sum(n) FROM comments) + (SELECT sum(n) FROM doc_texts) + sym.n AS BIGINT) AS total_chars
FROM sym"""

SQL["q26_trim_history"] = """
WITH msg AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 1 THEN 'assistant' WHEN 2 THEN 'tool' ELSE role END AS role,
    CASE WHEN turn % 4 = 1 THEN '{"id": "call_' || conv_id || '_' || turn || '"}' ELSE '' END AS calls,
    CASE WHEN turn % 4 = 2 THEN 'call_' || conv_id || '_' || turn ELSE '' END AS call_id,
    CASE WHEN turn % 4 = 2 THEN 'search_text' ELSE '' END AS name FROM conversations),
est AS (SELECT *, greatest(1, (length(role || chr(10) || text || chr(10) || calls || chr(10) || call_id || chr(10) || name) + 1) // 2) + 4 AS tok FROM msg),
opened AS (SELECT *, last_value(CASE WHEN role <> 'tool' THEN (role = 'assistant' AND calls <> '') END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM est),
starts AS (SELECT *, role <> 'tool' OR NOT coalesce(open, false) AS starts_block FROM opened),
blocks AS (SELECT *, sum(CASE WHEN starts_block THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM starts),
sums AS (SELECT conv_id, block, sum(tok) AS tok FROM blocks GROUP BY ALL),
tail AS (SELECT conv_id, block, sum(tok) OVER (PARTITION BY conv_id ORDER BY block DESC) AS rest,
    max(block) OVER (PARTITION BY conv_id) AS last FROM sums)
SELECT b.conv_id, b.turn, b.role, CAST(b.tok AS INTEGER) AS est_tokens, b.starts_block, t.rest <= 600 OR t.block = t.last AS kept
FROM blocks b JOIN tail t ON t.conv_id = b.conv_id AND t.block = b.block"""

_JSON = "length(CAST(to_json({}) AS VARCHAR))"
SQL["q27_compact_matches"] = "WITH " + LINES + """,
hits AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lower(file), file, line_no) AS rank FROM lines WHERE contains(line, 'tion')),
sized AS (SELECT source, rank, 46 + """ + _JSON.format("file") + " + " + _JSON.format("line") + """ + length(CAST(line_no AS VARCHAR)) AS item,
    49 + """ + _JSON.format("file") + """ + 2 * length(CAST(line_no AS VARCHAR)) AS place FROM hits WHERE rank <= 50),
per AS (SELECT source, count(*) AS n, list(item ORDER BY rank) AS items, sum(place) FILTER (WHERE rank <= 8) AS places FROM sized GROUP BY source),
heads AS (SELECT *, length('{"ok": true, "query": "tion", "matches": [], "match_count": ' || n || ', "truncated": ' || (n >= 50) ||
    ', "context_updates": {"last_search_query": "tion", "last_retrieve": []}}') + places + 2 * (least(n, 8) - 1) AS head FROM per),
opts AS (SELECT source, n, head, items, unnest(list_distinct([n, n // 2, n // 4, n // 8, n // 16, n // 32])) AS k FROM heads),
fit AS (SELECT source, n, head, k, head + list_sum(items[1:k]) + 2 * (k - 1) AS full_k,
    head + CASE WHEN n >= 50 THEN 0 ELSE -1 END + list_sum(items[1:k]) + 2 * (k - 1) AS cut_k FROM opts WHERE k >= 1),
choice AS (SELECT source, n, max(full_k) FILTER (WHERE k = n) AS full_size,
    coalesce(max(k) FILTER (WHERE cut_k <= 12000), 1) AS kept FROM fit GROUP BY ALL),
done AS (SELECT c.*, f.cut_k + length(', "matches_omitted": ' || (c.n - c.kept)) AS cut_size FROM choice c JOIN fit f ON f.source = c.source AND f.k = c.kept)
SELECT source AS module_path, n AS match_count, CAST(full_size AS INTEGER) AS full_size,
    CAST(CASE WHEN full_size <= 12000 THEN n ELSE kept END AS INTEGER) AS kept,
    CAST(CASE WHEN full_size <= 12000 THEN 0 ELSE n - kept END AS INTEGER) AS omitted,
    CAST(CASE WHEN full_size <= 12000 THEN full_size ELSE cut_size END AS INTEGER) AS final_size,
    CASE WHEN full_size <= 12000 THEN 'unchanged' WHEN cut_size <= 12000 THEN 'shrunk' ELSE 'stub' END AS outcome FROM done"""

SQL["q27_compact_content"] = "WITH " + FILES + """,
sized AS (SELECT file, text, substring(text, 1, 3000) || chr(10) || '... <truncated>' AS cut,
    length('{"ok": true, "path": , "content": , "characters_read": ' || length(text) || '}') + """ + _JSON.format("file") + """ AS head FROM files),
sizes AS (SELECT *, head + """ + _JSON.format("text") + """ AS full_size, head + 19 + """ + _JSON.format("cut") + """ + 27 AS cut_size FROM sized)
SELECT file, CAST(full_size AS INTEGER) AS full_size,
    CAST(CASE WHEN full_size <= 12000 THEN full_size WHEN full_size + 19 <= 12000 THEN full_size + 19 ELSE cut_size END AS INTEGER) AS final_size,
    CASE WHEN full_size <= 12000 THEN 'unchanged' WHEN full_size + 19 <= 12000 THEN 'flagged' WHEN cut_size <= 12000 THEN 'cut' ELSE 'stub' END AS outcome,
    md5(CASE WHEN full_size + 19 <= 12000 OR full_size <= 12000 THEN text WHEN cut_size <= 12000 THEN cut END) AS content_md5 FROM sizes"""

CHECKED = """
cases AS (SELECT item_id, 'src' || item_id AS home, ['consult', 'retrieval', 'bug', 'modify'][item_id % 4 + 1] AS scenario,
    list_transform(range(1, 9), lambda i: coalesce(regexp_extract_all(text, '[A-Za-z]{3,}')[i], 'zz')) AS w FROM benchmark),
parts AS (SELECT doc_id, source, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS item, text,
    unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
steps AS (SELECT doc_id, n, source, regexp_extract(line, '[A-Za-z]+') AS word,
    ['write_text_file', 'search_text', 'read_text_file', 'find_symbol_references', 'replace_text_in_file', 'list_modules'][n % 6 + 1] AS tool,
    CASE WHEN n % 4 = 0 THEN '.' ELSE source END AS dir, n % 7 <> 0 AS usable, n % 7 <> 0 AND n % 5 <> 0 AS surely,
    n % 3 = 0 AS created FROM parts),
traces AS (SELECT doc_id, source, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS item, text AS answer,
    CASE WHEN doc_id % 9 = 4 THEN 'error' ELSE 'completed' END AS status FROM documents),
texts AS (SELECT doc_id, string_agg('{"relative_path": "' || source || '/' || word || '.h", "relative_dir": "' || dir || '"}', chr(10) ORDER BY n) AS args,
    string_agg('{"relative_path": "' || source || '/' || word || '.h", "relative_dir": "' || dir || '"}' || chr(10) || 'True '
        || CASE WHEN created THEN 'True ' ELSE 'False ' END || source || ' ' || word, chr(10) ORDER BY n) AS body,
    list(DISTINCT tool) FILTER (WHERE usable) AS used, list(DISTINCT tool) AS called,
    list(DISTINCT source || '/' || word || '.h') FILTER (WHERE tool IN ('write_text_file', 'replace_text_in_file')) AS touched,
    string_agg(source || '/' || word || '.h', chr(10)) FILTER (WHERE tool = 'read_text_file') AS read_args,
    min(n) FILTER (WHERE tool = 'read_text_file') AS first_read,
    min(n) FILTER (WHERE tool = 'replace_text_in_file' OR (tool = 'write_text_file' AND NOT created)) AS first_edit,
    list_distinct(list(source) || list(word)) AS found,
    bool_or(tool = 'search_text' AND dir = '.') AS wide
    FROM steps GROUP BY doc_id),
j AS (SELECT t.doc_id AS run_id, t.item AS case_id, c.scenario, t.answer, t.status, x.*, c.w, c.home, t.answer || chr(10) || x.body AS whole,
    regexp_replace(t.answer, '[\\s\\x{a0}]', '', 'g') AS packed, c.item_id % 3 = 0 AS any_name, coalesce(x.touched, []) AS tt,
    c.home || '/' || c.w[1] || '.h' AS needed
    FROM traces t JOIN cases c ON c.item_id = t.item JOIN texts x ON x.doc_id = t.doc_id),
checked AS (SELECT run_id, case_id, scenario,
    (contains(packed, w[1])::INT + contains(packed, w[2])::INT + contains(packed, w[3])::INT
        + (contains(packed, w[4]) OR contains(packed, w[5]))::INT) / 4.0::DOUBLE AS mentions_covered,
    (list_contains(used, 'search_text')::INT + list_contains(used, 'write_text_file')::INT) / 2.0::DOUBLE AS required_tools_called,
    (contains(whole, home)::INT + contains(whole, 'src0')::INT) / 2.0::DOUBLE AS modules_covered,
    (contains(whole, w[1])::INT + contains(whole, w[2])::INT) / 2.0::DOUBLE AS symbols_covered,
    CASE WHEN contains(answer, w[6]) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS no_hallucination,
    CASE WHEN contains(args, w[1] || '.h') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS root_cause_located,
    CASE WHEN contains(whole, w[1]) AND contains(whole, w[3]) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS key_change_present,
    CASE WHEN any_name THEN CASE WHEN len(tt) > 0 AND len(list_filter(tt, lambda p: contains(p, '/' || w[2]))) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
         WHEN len(list_filter(tt, lambda p: contains(p, '/' || w[2]) OR (p <> needed AND p <> home || '/The.h'))) > 0 THEN 0.0::DOUBLE
         WHEN list_contains(tt, needed) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS only_target_file_modified,
    CASE WHEN first_edit IS NULL OR first_read < first_edit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS read_before_write,
    1.0::DOUBLE AS no_claimed_without_result,
    (contains(whole, home)::INT + contains(whole, w[1])::INT + contains(whole, w[2])::INT) / 3.0::DOUBLE AS recall,
    len(list_intersect(found, list_distinct([home, w[1], w[2]])))::DOUBLE / len(found) AS precision,
    CASE WHEN list_contains(called, 'find_symbol_references') OR list_contains(called, 'list_modules') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS used_index_tools,
    CASE WHEN contains(coalesce(read_args, ''), w[1] || '.h') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS read_target_file,
    CASE WHEN wide THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS no_illegal_search,
    CASE WHEN status = 'completed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS stable FROM j)
"""
CHECK_NAMES = (
    "mentions_covered", "required_tools_called", "modules_covered", "symbols_covered", "no_hallucination",
    "root_cause_located", "key_change_present", "only_target_file_modified", "read_before_write",
    "no_claimed_without_result", "recall", "precision", "used_index_tools", "read_target_file", "no_illegal_search", "stable",
)
SQL["q28_rule_checks"] = "WITH " + CHECKED + "SELECT run_id, case_id, " + ", ".join(
    f"round({n}, 6) AS {n}" for n in CHECK_NAMES) + " FROM checked"

_WANTED = {
    "mentions_covered": "list_filter([w[1], w[2], w[3], w[4] || '|' || w[5]], lambda n: NOT list_bool_or("
    "list_transform(string_split(n, '|'), lambda p: contains(packed, p))))",
    "required_tools_called": "list_filter(['search_text', 'write_text_file'], lambda t: NOT list_contains(used, t))",
    "modules_covered": "list_filter([home, 'src0'], lambda n: NOT contains(whole, n))",
    "symbols_covered": "list_filter([w[1], w[2]], lambda n: NOT contains(whole, n))",
    "key_change_present": "list_filter([w[1], w[3]], lambda n: NOT contains(whole, n))",
    "recall": "list_filter([home, w[1], w[2]], lambda n: NOT contains(whole, n))",
    "only_target_file_modified": "CASE WHEN any_name OR list_contains(tt, needed) THEN []::VARCHAR[] ELSE [needed] END",
}
_AGAINST = {
    "no_hallucination": "CASE WHEN contains(answer, w[6]) THEN [w[6]] ELSE []::VARCHAR[] END",
    "only_target_file_modified": "list_filter(tt, lambda p: contains(p, '/' || w[2]) OR (NOT any_name AND p <> needed AND p <> home || '/The.h'))",
    "no_illegal_search": "CASE WHEN wide THEN ['.'] ELSE []::VARCHAR[] END",
}
SQL["q28_check_outcomes"] = "WITH " + CHECKED + " UNION ALL ".join(
    f"SELECT j.run_id, '{n}' AS check_name, c.{n} = 1 AS passed, array_to_string(list_sort({_WANTED.get(n, '[]::VARCHAR[]')}), ',') AS missing, "
    f"array_to_string(list_sort({_AGAINST.get(n, '[]::VARCHAR[]')}), ',') AS offending FROM j JOIN checked c ON c.run_id = j.run_id"
    for n in CHECK_NAMES)

SQL["q28_check_means"] = "WITH " + CHECKED + ", long_ AS (" + " UNION ALL ".join(
    f"SELECT scenario, '{n}' AS check_name, {n} AS score FROM checked" for n in CHECK_NAMES) + """)
SELECT scenario, check_name, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE score = 1) AS passed FROM long_ GROUP BY ALL"""

SQL["q28_graded_cases"] = "WITH " + CHECKED + """,
layers AS (SELECT case_id, scenario,
    CASE WHEN scenario = 'retrieval' THEN (recall + precision) / 2 END AS task,
    CASE scenario WHEN 'consult' THEN (modules_covered + symbols_covered + no_hallucination) / 3 WHEN 'retrieval' THEN no_hallucination
        WHEN 'bug' THEN (root_cause_located + no_hallucination) / 2 ELSE (key_change_present + only_target_file_modified) / 2 END AS evidence,
    CASE scenario WHEN 'bug' THEN (read_target_file + no_illegal_search + stable) / 3
        WHEN 'modify' THEN (read_before_write + no_claimed_without_result + stable) / 3
        ELSE (used_index_tools + no_illegal_search + stable) / 3 END AS trace FROM checked),
scores AS (SELECT *, CASE WHEN scenario = 'retrieval' THEN task * 0.5::DOUBLE + evidence * 0.2::DOUBLE + trace * 0.3::DOUBLE
    ELSE (evidence * 0.3::DOUBLE + trace * 0.2::DOUBLE) / 0.5::DOUBLE END AS score FROM layers)
SELECT case_id, scenario, count(*) AS n_runs, round(avg(score), 6) AS case_score_mean,
    CASE WHEN count(score) > 1 THEN round(stddev_pop(score), 6) END AS case_score_std, round(avg(task), 6) AS task_mean,
    round(avg(evidence), 6) AS evidence_mean, round(avg(trace), 6) AS trace_mean FROM scores GROUP BY ALL"""

RUNS = """
r AS (SELECT event_id AS run_id, user_id AS case_id, event_type AS scenario, value,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'max_loops_exceeded' ELSE 'completed' END AS status,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
l AS (SELECT *, CASE WHEN k % 5 <> 0 THEN k / 100.0::DOUBLE END AS task, value / (value + 50) AS evidence,
    CASE WHEN status = 'completed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS trace FROM r),
s AS (SELECT *, CASE WHEN task IS NULL THEN (evidence * 0.3::DOUBLE + trace * 0.2::DOUBLE) / 0.5::DOUBLE
    ELSE task * 0.5::DOUBLE + evidence * 0.3::DOUBLE + trace * 0.2::DOUBLE END AS score FROM l)
"""
SQL["q29_case_scores"] = "WITH " + RUNS + """
SELECT case_id, scenario, count(*) AS n_runs, round(avg(score), 6) AS case_score_mean,
    CASE WHEN count(score) > 1 THEN round(stddev_pop(score), 6) END AS case_score_std, round(avg(task), 6) AS task_mean,
    round(avg(evidence), 6) AS evidence_mean, round(avg(trace), 6) AS trace_mean FROM s GROUP BY ALL"""

SQL["q30_engineering"] = "WITH " + RUNS + """,
m AS (SELECT *, CASE WHEN k % 7 <> 0 THEN k * 1.5::DOUBLE ELSE 0.0::DOUBLE END AS lat FROM r)
SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'completed') AS stable_runs,
    round(count(*) FILTER (WHERE status = 'completed')::DOUBLE / count(*), 6) AS stability_rate,
    CAST(sum(k) AS BIGINT) AS input_tokens_total, CAST(sum(k) AS BIGINT) AS output_tokens_total, count(*) AS llm_calls_total,
    CAST(sum(k % 3) AS BIGINT) AS tool_calls_total, 1.0::DOUBLE AS avg_llm_calls_per_run,
    round(sum(k % 3)::DOUBLE / count(*), 6) AS avg_tool_calls_per_run,
    round(sum(k)::DOUBLE / 1000 * 0.002::DOUBLE + sum(k)::DOUBLE / 1000 * 0.08::DOUBLE, 6) AS estimated_cost_cny,
    round(quantile_cont(value, 0.5), 6) AS duration_p50_ms, round(quantile_cont(value, 0.95), 6) AS duration_p95_ms,
    round(quantile_cont(lat, 0.5), 6) AS llm_latency_p50_ms, round(quantile_cont(lat, 0.95), 6) AS llm_latency_p95_ms FROM m"""

MEANS = """
per_case AS (SELECT case_id, scenario, run_id % 2 AS side, avg(score) AS mean FROM s GROUP BY ALL)
"""
SQL["q30_scenario_means"] = "WITH " + RUNS + """,
c AS (SELECT case_id, scenario, avg(score) AS mean FROM s GROUP BY ALL)
SELECT coalesce(scenario, 'overall') AS scenario, round(avg(mean), 6) AS mean, count(*) AS cases FROM c GROUP BY GROUPING SETS ((scenario), ())"""

SQL["q31_failures"] = "WITH " + RUNS + """
SELECT case_id, run_id, status, CASE status WHEN 'error' THEN '运行异常：执行中抛出异常'
    ELSE '循环超限：模型在最大循环数内未收敛（可能检索未收敛、工具结果截断或任务描述不清）' END AS attribution FROM s WHERE status <> 'completed'"""

SQL["q32_compare"] = "WITH " + RUNS + "," + MEANS + """,
b AS (SELECT coalesce(scenario, 'overall') AS scenario, avg(mean) AS m FROM per_case WHERE side = 0 AND scenario <> 'signup' GROUP BY GROUPING SETS ((scenario), ())),
c AS (SELECT coalesce(scenario, 'overall') AS scenario, avg(mean) AS m FROM per_case WHERE side = 1 AND scenario <> 'click' GROUP BY GROUPING SETS ((scenario), ()))
SELECT coalesce(b.scenario, c.scenario) AS scenario, round(b.m, 6) AS baseline, round(c.m, 6) AS current, round(c.m - b.m, 6) AS delta
FROM b FULL JOIN c ON b.scenario = c.scenario"""

PAIRS = """
p AS (SELECT d.lang AS scenario, l.doc_id, CASE WHEN quality = 1 THEN '对' ELSE '错' END AS human,
    CASE WHEN toxic = 1 THEN '对' ELSE '错' END AS judge FROM labels l JOIN documents d USING (doc_id))
"""
SQL["q33_agreement"] = "WITH " + PAIRS + """,
g AS (SELECT scenario, human, judge FROM p UNION ALL SELECT 'overall', human, judge FROM p),
a AS (SELECT scenario, count(*) AS n, avg((human = judge)::INT) AS po,
    (count(*) FILTER (WHERE human = '对')::DOUBLE * count(*) FILTER (WHERE judge = '对')
     + count(*) FILTER (WHERE human = '错')::DOUBLE * count(*) FILTER (WHERE judge = '错')) / (count(*)::DOUBLE * count(*)) AS pe FROM g GROUP BY scenario),
k AS (SELECT *, CASE WHEN pe = 1 THEN (po = 1)::INT::DOUBLE ELSE (po - pe) / (1 - pe) END AS kappa FROM a)
SELECT scenario, n, round(po, 6) AS accuracy, round(kappa, 6) AS kappa, kappa >= 0.6::DOUBLE AS usable FROM k"""

SQL["q33_disagreements"] = "WITH " + PAIRS + "SELECT doc_id AS case_id, scenario, human, judge FROM p WHERE human <> judge"

SQL["q34_snapshot"] = "WITH " + FILES + """
SELECT file AS path, sha256(text) AS expected, CASE WHEN doc_id % 17 <> 0 THEN sha256(text || '.') END AS current,
    CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE 'differs' END AS issue FROM files WHERE doc_id % 17 = 0 OR doc_id % 10 = 0"""

SQL["q35_violations"] = """
WITH c AS (SELECT item_id AS k FROM benchmark UNION ALL SELECT doc_id FROM labels)
SELECT CAST(k AS VARCHAR) AS id, 'unknown scenario' AS rule FROM c WHERE k % 5 = 4
UNION ALL SELECT CAST(k AS VARCHAR), 'retrieval needs gold_list' FROM c WHERE k % 5 = 1 AND k % 2 <> 0
UNION ALL SELECT CAST(k AS VARCHAR), 'bug needs a root cause' FROM c WHERE k % 5 = 2 AND k % 3 <> 0 AND k % 7 <> 0
UNION ALL SELECT CAST(k AS VARCHAR), 'modify needs target_file' FROM c WHERE k % 5 = 3 AND k % 9 <> 0 AND k % 4 <> 0
UNION ALL SELECT CAST(k AS VARCHAR), 'modify needs key_change_fields' FROM c WHERE k % 5 = 3 AND k % 6 <> 0
UNION ALL SELECT CAST(k AS VARCHAR), 'duplicate id' FROM c GROUP BY k HAVING count(*) > 1"""

SQL["q36_head_sample"] = """
SELECT lang AS scenario, CAST(n AS INTEGER) AS rank, doc_id, source FROM
    (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 10"""

SQL["q37_guarded_replace"] = "WITH " + FILES + """,
w AS (SELECT *, regexp_extract(text, '[A-Za-z]+') AS old, doc_id % 3 + 1 AS want FROM files),
c AS (SELECT *, CASE WHEN old = '' THEN length(text) + 1 ELSE len(string_split(text, old)) - 1 END AS n FROM w)
SELECT file, n = want AS ok, CAST(n AS INTEGER) AS occurrences, md5(CASE WHEN n = want THEN replace(text, old, '<new>') ELSE text END) AS text_md5 FROM c"""

SQL["q39_outermost"] = "WITH " + PATHS + """,
mixed AS (SELECT DISTINCT CASE WHEN page_id % 6 = 0 THEN array_to_string(string_split(path, '/')[1:2], '/') ELSE path END AS path FROM paths)
SELECT path FROM mixed a WHERE NOT EXISTS (SELECT 1 FROM mixed b WHERE starts_with(a.path, b.path || '/'))"""

SQL["q40_settings"] = r"""
WITH lines AS (SELECT p_partkey % 20 AS file, p_partkey AS n, CASE p_partkey % 3 WHEN 0 THEN p_type || ' = "' || p_brand || '",'
    WHEN 1 THEN p_type || ': ' || p_brand || ' ; ' || p_name ELSE '# ' || p_name END AS line FROM part),
kv AS (SELECT file, n, lower(regexp_extract(line, '^["'']?([A-Za-z_]\w*)["'']?\s*[=:]\s*(.*?)\s*$', 1)) AS key,
    rtrim(regexp_extract(line, '^["'']?([A-Za-z_]\w*)["'']?\s*[=:]\s*(.*?)\s*$', 2), ',') AS v FROM lines WHERE line NOT LIKE '#%'),
clean AS (SELECT file, n, key, CASE WHEN v LIKE '"%"' THEN v[2:-2] ELSE trim(regexp_replace(v, '\s+[#;].*$', '')) END AS value FROM kv)
SELECT file, key, arg_min(value, n) AS value FROM clean WHERE key <> '' AND value <> '' GROUP BY ALL"""

SQL["q41_signals"] = "WITH " + PATHS + """,
seg AS (SELECT path, string_split(path, '/') AS s FROM paths),
mods AS (SELECT DISTINCT s[1] AS m FROM seg WHERE len(s) >= 3 AND s[2] = 'en' AND (s[1] LIKE '%.example.net' OR s[1] LIKE '%.example.org')
    UNION SELECT DISTINCT path[:-8] FROM paths WHERE ends_with(path, '/es/533')),
below AS (SELECT m, substring(path, length(m) + 2) AS rel FROM mods JOIN paths ON starts_with(path, m || '/'))
SELECT m AS module_path, bool_or(starts_with(rel, 'en/')) AS has_en, bool_or(starts_with(rel, 'fr/')) AS has_fr,
    bool_or(string_split(rel, '/')[-1] LIKE '%.html') AS has_page, bool_or(string_split(rel, '/')[-1] LIKE '5__') AS has_five,
    bool_or(regexp_matches(string_split(rel, '/')[-1], '^[1-4].*[^0-5]$')) AS has_class FROM below GROUP BY m"""

SQL["q42_glob_match"] = "WITH " + PATHS + """
SELECT page_id, regexp_matches(path, '^(.*/)?en/[^/]*$') AS g0, regexp_matches(path, '^[^/]*[.]example[.]net/.*$') AS g1,
    regexp_matches(path, '^(.*/)?5[^/][^/]$') AS g2, regexp_matches(path, '^blog[.][^/]*/[^/]*/[^/]*[.]html$') AS g3,
    regexp_matches(path, '^(.*/)?[^/]*[.]html$') AS g4 FROM paths"""

SQL["q06_read_preview"] = "WITH " + LINES + """
SELECT file, CAST(len(ls) AS INTEGER) AS total_lines, CASE WHEN len(ls) > 0 THEN 1 ELSE 0 END AS start_line,
    CAST(least(len(ls), 40) AS INTEGER) AS end_line, coalesce(array_to_string(ls[1:40], chr(10)), '') AS content,
    CAST(length(coalesce(array_to_string(ls[1:40], chr(10)), '')) AS INTEGER) AS characters_read FROM split"""

SQL["q14_source_files"] = r"""
WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages),
named AS (SELECT DISTINCT ltrim(regexp_replace(target, '[?#].*$', ''), '/')
    || ['.h', '.CPP', '.py', '', '.hxx', '.md'][page_id % 6 + 1] AS file FROM links)
SELECT file FROM named WHERE regexp_matches(lower(file), '[^/.][^/]*[.](h|hpp|hh|hxx|c|cc|cpp|cxx)$')"""

SQL["q33_normal_labels"] = """
WITH w AS (SELECT trim(['正确', ' 对', '部分', '部分正确' || chr(9), '错误 ', '错', 'None', ''][(doc_id + quality * 3) % 8 + 1], ' ' || chr(9)) AS l FROM labels)
SELECT CASE l WHEN '正确' THEN '对' WHEN '部分' THEN '部分对' WHEN '部分正确' THEN '部分对' WHEN '错误' THEN '错' ELSE l END AS label, count(*) AS n
FROM w GROUP BY 1"""

SQL["q33_judge_scores"] = """
SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN least(5, CAST(json_extract(props, '$.k') AS DOUBLE)) / 5
    WHEN 1 THEN least(5, greatest(0, value)) / 5 END, 6) AS score FROM events"""

SQL["q30_planned_runs"] = """
SELECT item_id, ['consult', 'retrieval', 'bug', 'modify'][item_id % 4 + 1] AS scenario,
    CASE WHEN item_id % 4 = 3 THEN 1 WHEN item_id % 3 = 0 THEN 5 ELSE 3 END AS n_runs FROM benchmark"""

SQL["q31_markdown"] = "WITH " + RUNS + """,
c AS (SELECT case_id, count(*) AS n, round(avg(score), 2) AS m, round(avg(task), 2) AS t FROM s GROUP BY case_id)
SELECT '| ' || case_id || ' | ' || n || ' | ' || coalesce(printf('%.3f', m), '-') || ' | ' || coalesce(printf('%.3f', t), '-') || ' |' AS line FROM c"""

SQL["q14_special_references"] = r"""
WITH lines AS (SELECT 'part/' || p_partkey AS file, p_brand || ' ~' || p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_type AS line FROM part),
names AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT '~' || string_split(p_name, ' ')[1] FROM part
    UNION SELECT DISTINCT p_type || ' Brand#1' FROM part),
counted AS (SELECT name, file,
    CAST(len(regexp_extract_all(' ' || replace(line, ' ', '  ') || ' ', '[^A-Za-z0-9_]' || replace(name, ' ', '  ') || '[^A-Za-z0-9_]')) AS INTEGER) AS n
    FROM lines, names)
SELECT name, file, 1 AS line, CAST(unnest(range(0, n)) AS INTEGER) AS position FROM counted WHERE n > 0"""
