"""DuckDB SQL over the driver's tables that the registered queries equal."""

from __future__ import annotations

from skald.functions.text import ENDINGS, VOWELS
from skald.plans.registry import AGE, CYRILLIC, INFLECTIONS, NOW, RUSSIAN

_A = r"0-9A-Za-z\x{0400}-\x{052F}"
_M = r"\x{0300}-\x{036F}"
_TOKEN = rf"[{_A}][{_A}{_M}]*(?:-[{_A}][{_A}{_M}]*)*"
_TOKENS = rf"list_filter(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(regexp_replace(x, '[{_M}]', '', 'g'))), lambda x: regexp_matches(x, '^[0-9]+$') OR length(x) >= 3)"
_T = f"t AS (SELECT doc_id, {_TOKENS} AS l FROM documents), flat AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM t)"
_FREQ = f"{_T}, f AS (SELECT token AS term, count(*) AS freq FROM flat GROUP BY token)"
_RANKED = f"{_FREQ}, r AS (SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, term, freq, max(freq) OVER () AS c FROM f)"
_WORDS = r"len(list_filter(regexp_split_to_array(coalesce({}, ''), '\s+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')))"
_POSTINGS = "p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM documents) GROUP BY term, doc_id)"


def _of(term: str) -> str:
    return f"(SELECT doc_id, tf AS n FROM p WHERE term = '{term}')"


def stem_steps(source: str, word: str) -> str:
    """The stemmer as a chain of subqueries over a source with a column w; gives w and stem."""
    cut = lambda col, name: f"regexp_replace({col}, '(?:{'|'.join(ENDINGS[name].split())})$', '')"
    a = f"SELECT *, replace(lower(w), 'ё', 'е') AS v FROM ({source})"
    a = f"SELECT *, regexp_extract(v, '^([^{VOWELS}]*[{VOWELS}])(.+)$', 1) AS pre, regexp_extract(v, '^([^{VOWELS}]*[{VOWELS}])(.+)$', 2) AS r FROM ({a})"
    a = f"SELECT *, {cut('r', 'perfective_1')} AS p1, {cut('r', 'perfective_2')} AS p2, {cut('r', 'reflexive')} AS x FROM ({a})"
    a = f"SELECT *, {cut('x', 'adjective')} AS adj, {cut('x', 'verb_1')} AS v1, {cut('x', 'verb_2')} AS v2, {cut('x', 'noun')} AS nn FROM ({a})"
    a = f"SELECT *, {cut('adj', 'participle_2')} AS q2, {cut('adj', 'participle_1')} AS q1 FROM ({a})"
    a = f"SELECT *, regexp_replace(CASE WHEN p1 <> r THEN p1 WHEN p2 <> r THEN p2 WHEN adj <> x THEN CASE WHEN q2 <> adj THEN q2 ELSE q1 END WHEN v1 <> x THEN v1 WHEN v2 <> x THEN v2 ELSE nn END, 'и$', '') AS s FROM ({a})"
    a = f"SELECT *, regexp_replace(s, '^(.*[{VOWELS}].*?)ость?$', '\\1') AS o FROM ({a})"
    a = f"SELECT *, CASE WHEN o LIKE '%ь' THEN regexp_replace(o, 'ь$', '') ELSE regexp_replace({cut('o', 'superlative')}, 'нн$', 'н') END AS e FROM ({a})"
    return f"SELECT * EXCLUDE (v, pre, r, p1, p2, x, adj, v1, v2, nn, q2, q1, s, o, e), CASE WHEN regexp_matches(w, '^[0-9]+$') THEN NULL WHEN length(w) <= 3 OR NOT regexp_matches(w, '[\\x{{0400}}-\\x{{052F}}]') THEN lower(w) WHEN pre = '' THEN v ELSE pre || e END AS {word} FROM ({a})"


_STORE = f"""store AS (SELECT 'doc://' || doc_id AS url, source, lang, updated_at, updated_at AS crawled_at, t AS clean_text, {_WORDS.format('t')} AS wc, md5(t) AS h,
  CASE WHEN doc_id % 4 = 1 THEN 'pending' ELSE 'processed' END AS status, CASE WHEN doc_id % 3 > 0 THEN t END AS raw FROM (
  SELECT *, CASE WHEN doc_id % 7 = 0 THEN text || ' old' ELSE text END AS t, {AGE} + doc_id % 1000 * 3600 AS updated_at FROM documents WHERE doc_id % 5 <> 0))"""
_DECIDED = f"""WITH {_STORE}, f AS (SELECT 'doc://' || doc_id AS url, source, lang, text, {_WORDS.format('text')} AS wc, md5(text) AS h FROM documents),
j AS (SELECT s.url AS su, f.url AS fu, f.source AS f_source, f.lang AS f_lang, f.wc AS f_wc, f.h AS fh, s.source AS s_source, s.lang AS s_lang, s.wc AS s_wc, s.h AS sh, s.updated_at, s.crawled_at, s.status,
  CASE WHEN s.url IS NOT NULL AND {NOW} - s.updated_at < 604800 THEN 'fresh' WHEN f.wc < 60 AND s.url IS NOT NULL THEN 'delete' WHEN f.wc < 60 THEN 'short'
  WHEN s.url IS NOT NULL AND s.h = f.h THEN 'touch' WHEN s.url IS NOT NULL THEN 'update' ELSE 'insert' END AS action
  FROM f LEFT JOIN store s ON s.url = f.url)"""
_NOISY = r"'[12] ( ' || regexp_replace(text, 'e', ' - e [n 1] , ', 'g') || ' )'"


def _cleaned(text: str) -> str:
    """The text cleaning as nested replacements."""
    for pattern, by in ((r"\[\d+\]", ""), (r"\s*\[[^\]]+\]\s*", " "), (r"\s{2,}", " "), (r"^\s+|\s+$", ""), (r"\s+([.,;:!?)])", r"\1"), (r"([(])\s+", r"\1"), (r"([\p{L}\p{N}\p{M}\p{Pc}])\s+-\s+([\p{L}\p{N}\p{M}\p{Pc}])", r"\1-\2")):
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


#: Pages as the tables have them: one article of paragraphs, of which an unclosed one (the next tag of a paragraph opens) goes on to the article's end.
_ARTICLE = r"""a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inner_html, html FROM pages),
t AS (SELECT page_id, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(inner_html, '<[^>]*>|[^<]+') AS l FROM a)),
s AS (SELECT page_id, i, regexp_replace(regexp_replace(replace(tok, '&quot;', '"'), '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g') AS piece FROM t WHERE tok[1] <> '<'),
g AS (SELECT page_id, i, tok, lead(tok, 1, '</p>') OVER (PARTITION BY page_id ORDER BY i) AS next_tok, lead(i, 1, 1000000) OVER (PARTITION BY page_id ORDER BY i) AS next_i FROM t WHERE tok IN ('<p>', '</p>', '<h1>', '</h1>')),
b AS (SELECT page_id, i, CASE WHEN next_tok = replace(tok, '<', '</') THEN next_i ELSE 1000000 END AS stop FROM g WHERE tok IN ('<p>', '<h1>')),
x AS (SELECT b.page_id, b.i, coalesce(string_agg(piece, ' ' ORDER BY s.i) FILTER (piece <> ''), '') AS x FROM b LEFT JOIN s ON b.page_id = s.page_id AND s.i > b.i AND s.i < b.stop GROUP BY b.page_id, b.i)"""


def _bytes(n: str) -> str:
    cases = " ".join(f"WHEN {n} / {1024.0**i} < 1024 THEN printf('%.2f {u}', {n} / {1024.0**i})" for i, u in enumerate(("B", "KB", "MB", "GB", "TB")))
    return f"CASE {cases} ELSE printf('%.2f PB', {n} / {1024.0**5}) END"


_EDGES = """e AS (SELECT 'world' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'world' FROM nation),
walk AS (SELECT 'world' AS node, 0 AS depth UNION ALL SELECT e.child, depth + 1 FROM walk JOIN e ON node = parent WHERE depth < {})"""

ORACLES = {
    "tokenize": f"WITH {_T} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token FROM flat",
    "docs_idx": f"""WITH {_T}, s AS (SELECT doc_id, count(*) AS n, sum(length(CAST(doc_id AS VARCHAR)) + length(CAST(pos AS VARCHAR)) + strlen(token) + 3) AS b FROM flat GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(sum(coalesce(b, 0)) OVER (ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, coalesce(n, 0) AS token_count
        FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""",
    "tokens_per_doc_stats": f"WITH {_T}, c AS (SELECT len(l) AS n FROM t) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 9) AS avg, round(CAST(median(n) AS DOUBLE), 9) AS median, CAST(floor(quantile_cont(n, 0.95)) AS BIGINT) AS p95, min(n) AS min, max(n) AS max FROM c",
    "term_freq": f"WITH {_FREQ} SELECT term, freq FROM f",
    "zipf": f"WITH {_RANKED} SELECT rank, freq, round(log10(rank), 9) AS log10_rank, round(log10(freq), 9) AS log10_freq, round(c / rank, 9) AS zipf_freq FROM r",
    "zipf_plot": f"WITH {_RANKED} SELECT round(log10(rank), 9) AS log10_rank, round(log10(freq), 9) AS log10_freq, round(log10(c / rank), 9) AS log10_zipf FROM r",
    "zipf_top": f"WITH {_RANKED} SELECT rank, term, freq FROM r WHERE rank <= 50",
    "stem_words": f"SELECT w AS word, stem FROM ({stem_steps('SELECT unnest([' + ', '.join(repr(w) for w in RUSSIAN) + ']) AS w', 'stem')})",
    "stem_zipf_top": f"WITH {_FREQ}, s AS (SELECT stem AS term, CAST(sum(freq) AS BIGINT) AS freq FROM ({stem_steps('SELECT term AS w, freq FROM f', 'stem')}) WHERE stem IS NOT NULL GROUP BY stem) SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, term, freq FROM s QUALIFY rank <= 50",
    "stem_counters": f"WITH {_FREQ} SELECT CAST(sum(freq) AS BIGINT) AS read, CAST(sum(CASE WHEN stem IS NOT NULL THEN freq ELSE 0 END) AS BIGINT) AS written, CAST(sum(CASE WHEN stem IS NULL THEN freq ELSE 0 END) AS BIGINT) AS dropped_numeric, CAST(sum(CASE WHEN stem <> w THEN freq ELSE 0 END) AS BIGINT) AS changed FROM ({stem_steps('SELECT term AS w, freq FROM f', 'stem')})",
    "postings": f"WITH {_POSTINGS} SELECT term, doc_id, tf FROM p",
    "index_totals": f"""WITH {_POSTINGS}, v AS (SELECT term, sum(tf) AS tf FROM p GROUP BY term)
        SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, round(sum(tf) / count(*), 9) AS tokens_per_term, round(avg(length(term)), 9) AS mean_term_length,
        round(sum(length(term) * tf) / sum(tf), 9) AS mean_token_length, round(sum(tf) / (SELECT count(*) FROM documents), 9) AS tokens_per_doc FROM v""",
    "search_and": f"WITH {_POSTINGS} SELECT doc_id, least(a.n, b.n) AS n FROM {_of('the')} a JOIN {_of('of')} b USING (doc_id)",
    "search_or": f"WITH {_POSTINGS} SELECT doc_id, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM {_of('la')} a FULL JOIN {_of('de')} b USING (doc_id)",
    "search_not": f"WITH {_POSTINGS} SELECT doc_id, a.n - coalesce(b.n, 0) AS n FROM {_of('the')} a LEFT JOIN {_of('and')} b USING (doc_id) WHERE a.n > coalesce(b.n, 0)",
    "search_nested": f"""WITH {_POSTINGS}, h AS (SELECT d.doc_id, list(term) AS t FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id AND term IN ('the', 'der', 'and', 'of', 'la', 'in') GROUP BY d.doc_id)
        SELECT 0 AS query_id, doc_id FROM h WHERE ((list_contains(t, 'the') OR list_contains(t, 'der')) AND list_contains(t, 'and')) OR (NOT list_contains(t, 'of') AND list_contains(t, 'la'))
        UNION ALL SELECT 1, doc_id FROM h WHERE list_contains(t, 'in') AND list_contains(t, 'the') AND NOT list_contains(t, 'and') UNION ALL SELECT 2, doc_id FROM h WHERE list_contains(t, 'of')""",
    "search_enriched": f"WITH {_POSTINGS} SELECT d.doc_id, split_part(text, chr(10), 1) AS title, 'doc://' || d.doc_id AS url FROM documents d WHERE doc_id IN (SELECT doc_id FROM p WHERE term = 'the') AND doc_id IN (SELECT doc_id FROM p WHERE term = 'der')",
    "search_algebra": f"""WITH {_POSTINGS} SELECT doc_id, l.n - coalesce(r.n, 0) AS n FROM (SELECT doc_id, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM {_of('the')} a FULL JOIN {_of('of')} b USING (doc_id)) l
        LEFT JOIN (SELECT doc_id, least(a.n, b.n) AS n FROM {_of('of')} a JOIN {_of('and')} b USING (doc_id)) r USING (doc_id) WHERE l.n > coalesce(r.n, 0)""",
    "corpus_by_source": "SELECT trim(coalesce(nullif(source, ''), 'UNKNOWN')) AS source_name, count(*) AS n FROM documents GROUP BY 1",
    "corpus_stats": r"SELECT count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS clean_text_bytes_total, round(avg(strlen(text)), 9) AS clean_text_bytes_avg, round(avg(length(text)), 9) AS clean_text_chars_avg, round(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))), 9) AS clean_text_words_est_avg FROM documents",
    "sample_titles": "SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title FROM documents WHERE trim(split_part(text, chr(10), 1)) <> '' ORDER BY doc_id LIMIT 10",
    "token_summary": f"WITH {_FREQ} SELECT (SELECT CAST(sum(freq) AS BIGINT) FROM f) AS tokens_total, (SELECT CAST(sum(len(l)) AS BIGINT) FROM t) AS tokens_total_from_docs_idx, (SELECT round(sum(length(term) * freq) / sum(freq), 9) FROM f) AS avg_token_length_chars, term AS token, freq FROM f ORDER BY freq DESC, term LIMIT 30",
    "raw_store_stats": f"WITH {_STORE} SELECT count(*) AS documents_total, count(raw) AS documents_with_raw_html, count(clean_text) AS documents_with_clean_text, CAST(sum(strlen(raw)) AS BIGINT) AS raw_html_bytes_total, round(avg(strlen(raw)), 9) AS raw_html_bytes_avg, CAST(sum(strlen(clean_text)) AS BIGINT) AS clean_text_bytes_total, round(avg(strlen(clean_text)), 9) AS clean_text_bytes_avg FROM store",
    "store_stats": f"WITH {_STORE} SELECT count(*) AS total, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status <> 'processed') AS pending FROM store",
    "normalize_url": "SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS normalized_url FROM pages",
    "content_hash": "SELECT doc_id, md5(text) AS content_hash FROM documents",
    "unique_urls": "SELECT source || '/' || (doc_id % 50) AS normalized_url, doc_id AS updated_at, md5(text) AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY source || '/' || (doc_id % 50) ORDER BY doc_id DESC) = 1",
    "clean_text_norm": f"SELECT doc_id, md5({_cleaned(_NOISY)}) AS cleaned FROM documents",
    "word_count": f"SELECT doc_id, CAST({_WORDS.format('text')} AS INTEGER) AS word_count FROM documents",
    "headings": r"SELECT doc_id, lower(regexp_replace(replace(regexp_replace(regexp_replace(' 1.2.3 ' || split_part(text, chr(10), 1) || ': ', '^\s+|\s+$', '', 'g'), '^\s*\d+(\.\d+)*\s*', ''), ':', ''), '^\s+|\s+$', '', 'g')) AS heading FROM documents",
    "sizes": f"SELECT doc_id, {_bytes('CAST(strlen(text) AS DOUBLE)')} AS small, {_bytes('(CAST(strlen(text) AS DOUBLE) * 1000000.0)')} AS large FROM documents",
    "export_corpus": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'doc://' || doc_id AS normalized_url, source AS source_name, split_part(text, chr(10), 1) AS title, text AS clean_text FROM documents WHERE text <> ''",
    "refresh_actions": f"{_DECIDED} SELECT CASE WHEN action IN ('fresh', 'touch') THEN 'skipped' WHEN action IN ('delete', 'short') THEN 'too_short' WHEN action = 'update' THEN 'updated' ELSE 'downloaded' END AS counter, count(*) AS n FROM j GROUP BY 1",
    "refresh_store": f"""{_DECIDED} SELECT CASE WHEN action = 'insert' THEN fu || '?v=2' ELSE su END AS url, coalesce(su, fu) AS normalized_url, CASE WHEN action = 'insert' THEN f_source ELSE s_source END AS source_name,
        CAST(CASE WHEN action IN ('insert', 'update') THEN f_wc ELSE s_wc END AS INTEGER) AS word_count, CASE WHEN action = 'insert' THEN {NOW} ELSE crawled_at END AS crawled_at,
        CASE WHEN action IN ('insert', 'update', 'touch') THEN {NOW} ELSE updated_at END AS updated_at, CASE WHEN action IN ('insert', 'update') THEN fh ELSE sh END AS content_hash,
        CASE WHEN action = 'insert' THEN 'processed' ELSE status END AS status, CASE WHEN action IN ('insert', 'update') THEN f_lang ELSE s_lang END AS language FROM j WHERE action NOT IN ('delete', 'short')""",
    "due_for_revisit": f"WITH {_STORE} SELECT url AS normalized_url, updated_at FROM store WHERE updated_at < {NOW} - 604800",
    "visit_budget": "SELECT doc_id AS visit_seq, doc_id % 3 > 0 AS is_write FROM documents QUALIFY coalesce(sum(CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 300",
    "category_walk": "SELECT c_name AS article, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "category_paths": f"WITH RECURSIVE {_EDGES.format(5)} SELECT node, depth, count(*) AS walks FROM walk GROUP BY node, depth",
    "sitemap_urls": "SELECT 'http://maps/' || CAST(page_id // 50 AS BIGINT) || '.xml' AS sitemap, url FROM pages WHERE page_id // 50 % 5 <> 4 UNION ALL SELECT DISTINCT 'root', 'http://maps/' || CAST(page_id // 50 AS BIGINT) || '.xml' FROM pages",
    "sitemap_pages": "SELECT url FROM pages WHERE page_id // 50 % 5 <> 4",
    "stem_cyrillic": f"SELECT w AS word, stem FROM ({stem_steps(f'WITH {_FREQ} SELECT DISTINCT translate(term, {CYRILLIC[0]!r}, {CYRILLIC[1]!r}) || ({INFLECTIONS!r})[length(term) % {len(INFLECTIONS)} + 1] AS w FROM f', 'stem')})",
    "invalid_text": f"WITH {_T} SELECT doc_id, count(*) AS n FROM flat WHERE doc_id % 5 <> 0 GROUP BY doc_id",
    "article_rules": f"""WITH p AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents)),
        c AS (SELECT doc_id, i, {_cleaned('x')} AS c FROM p WHERE doc_id % 3 <> 0 OR i <= 3),
        k AS (SELECT doc_id, i, c, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c WHERE length(c) >= 30 AND NOT regexp_matches(lower(c), 'править|обсуждение|загрузить|распечатать')),
        o AS (SELECT doc_id, string_agg(c, chr(10) || chr(10) ORDER BY i) AS article FROM k WHERE before IS NULL OR before <> c GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(article, '') AS article FROM documents LEFT JOIN o USING (doc_id)""",
    "duplicate_ids": "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 3 ELSE 2 END AS n FROM documents WHERE doc_id % 4 = 0",
    "visited_urls": f"WITH {_STORE} SELECT url AS normalized_url FROM store",
    "get_document": f"WITH {_STORE} SELECT url, h AS content_hash, status FROM store WHERE url = 'doc://7'",
    "existing_urls": "SELECT 'doc://' || doc_id AS normalized_url FROM documents WHERE doc_id % 5 <> 0",
    "throughput": f"WITH {_T}, n AS (SELECT (SELECT count(*) FROM flat) AS n, (SELECT sum(strlen(text)) / 1024 FROM documents) AS kb) SELECT round(kb / 2, 9) AS kb_per_sec, round(2e6 / kb, 9) AS us_per_kb, round(n / 2, 9) AS tokens_per_sec FROM n",
    "corpus_file": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'doc://' || doc_id AS normalized_url, source AS source_name, split_part(text, chr(10), 1) AS title, text AS clean_text FROM documents",
    "corpus_file_lenient": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS source_name, md5(CASE WHEN doc_id % 7 = 1 THEN '' ELSE text END) AS text FROM documents WHERE doc_id % 7 <> 0",
    "corpus_file_literal": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text FROM documents",
    "tokens_file": f"WITH {_T} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pos AS INTEGER) AS pos, token FROM flat",
    "token_column_file": f"WITH {_FREQ} SELECT term, freq FROM f",
    "stems_file": f"WITH {_T}, s AS ({stem_steps('SELECT DISTINCT token AS w FROM flat', 'stem')}) SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pos AS INTEGER) AS pos, stem AS token FROM flat JOIN s ON token = w WHERE stem IS NOT NULL",
    "top_terms_file": f"WITH {_RANKED} SELECT rank, term, freq FROM r WHERE rank <= 50",
    "zipf_file": f"WITH {_RANKED} SELECT rank, freq, CAST(printf('%.6g', log10(rank)) AS DOUBLE) AS log10_rank, CAST(printf('%.6g', log10(freq)) AS DOUBLE) AS log10_freq, CAST(printf('%.6g', c / rank) AS DOUBLE) AS zipf_freq FROM r",
    "query_file": "SELECT r_name AS query FROM region",
    "index_files": f"WITH {_POSTINGS} SELECT term, doc_id, tf FROM p",
    "direct_files": "SELECT doc_id, split_part(text, chr(10), 1) AS title, 'doc://' || doc_id AS url FROM documents",
    "search_stored": f"""WITH {_T}, h AS (SELECT d.doc_id, split_part(text, chr(10), 1) AS title, list_contains(l, 'the') AS the, list_contains(l, 'der') AS der, list_contains(l, 'that-the') AS that FROM documents d JOIN t USING (doc_id))
        SELECT 0 AS query_id, doc_id, title FROM h WHERE the AND der UNION ALL SELECT 1, doc_id, title FROM h WHERE that OR (der AND NOT the) UNION ALL SELECT 2, doc_id, title FROM h WHERE the""",
    "statistics_file": f"""WITH {_FREQ} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS clean_text_bytes_total, (SELECT nullif(count(*), 0) FROM documents WHERE source = 'web') AS web,
        (SELECT CAST(sum(freq) AS BIGINT) FROM f) AS tokens_total, (SELECT round(sum(length(term) * freq) / sum(freq), 9) FROM f) AS avg_token_length_chars, (SELECT round(CAST(median(len(l)) AS DOUBLE), 9) FROM t) AS median, (SELECT term FROM f ORDER BY freq DESC, term LIMIT 1) AS first_token""",
    "html_title": f"WITH {_ARTICLE}, h AS (SELECT b.page_id, x FROM b JOIN x USING (page_id, i) JOIN g USING (page_id, i) WHERE g.tok = '<h1>' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) = 1) SELECT pages.page_id, coalesce(nullif(h.x, ''), nullif(regexp_replace(regexp_extract(html, '<title>([^<]*)<', 1), '\\s*[-|—]\\s*.*$', ''), ''), 'Без названия') AS title FROM pages LEFT JOIN h USING (page_id)",
    "html_clean": f"""WITH {_ARTICLE}, c AS (SELECT page_id, i, {_cleaned('x')} AS c FROM x),
        k AS (SELECT page_id, i, c, lag(c) OVER (PARTITION BY page_id ORDER BY i) AS before FROM c WHERE length(c) >= 30 AND NOT regexp_matches(lower(c), 'править|обсуждение|загрузить|распечатать')),
        o AS (SELECT page_id, string_agg(c, chr(10) || chr(10) ORDER BY i) AS clean_text FROM k WHERE before IS NULL OR before <> c GROUP BY page_id)
        SELECT pages.page_id, coalesce(clean_text, '') AS clean_text, CAST({_WORDS.format('clean_text')} AS INTEGER) AS word_count FROM pages LEFT JOIN o USING (page_id)""",
    "allowed_urls": "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.') OR starts_with(url, 'http://t')",
    "source_detection": r"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'wikipedia' WHEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) LIKE '%wikipedia.org%' THEN 'wikipedia' ELSE 'bre' END AS source
        FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, 'example', 'wikipedia') WHEN page_id % 3 = 1 THEN replace(url, 'example.net', 'bigenc.ru') ELSE url END AS u FROM pages)""",
}
ORACLES["docs_idx_file"] = f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, byte_offset, token_count FROM ({ORACLES['docs_idx']})"


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
