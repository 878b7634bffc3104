"""The queries of `queries.py` in SQL for DuckDB, over views of the same tables."""

from __future__ import annotations

from . import fixtures
from .functions import policy
from .functions import text as X
from .functions import urls as U
from .operators import classify, extract, pairs
from .queries import CLEAN_PERCENT

WS = X.WS
V = fixtures.values_sql


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {to}, 'g')"


def collapse(x: str) -> str:
    return f"trim({sub(x, f'[{WS}]+', _q(' '))})"


def without(x: str, tags: list[str]) -> str:
    for t in tags:
        x = sub(x, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>")
    return x


def text_with_breaks(x: str) -> str:
    x = sub(x, rf"(?i)</({extract.CLOSING})\s*>|<(br|hr)\b[^>]*>", "chr(10)")
    x = sub(x, r"(?s)<[^>]*>")
    for name, char in extract.ENTITIES:
        x = f"replace({x}, {_q(name)}, {_q(char)})"
    return x


def blocks(x: str) -> str:
    parts = f"regexp_split_to_array({x}, {_q(rf'{chr(92)}n+|[{WS}]{{2,}}')})"
    trimmed = f"list_filter(list_transform({parts}, lambda p: {sub('p', f'^[{WS}]+|[{WS}]+$')}), lambda p: p <> '')"
    return f"list_transform({trimmed}, lambda p: {collapse('lower(p)')})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {_q(X.TOKEN)})"


def trigrams(x: str) -> str:
    c = sub(x, f"[{WS}]+")
    return f"(SELECT list_distinct(list_transform(range(1, greatest(length(c) - 1, 1)), lambda i: substr(c, i, 3))) FROM (SELECT {c} AS c))"


# URLs
def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1)"


def rest(u: str) -> str:
    return f"regexp_extract({u}, '^[^:/?#]+://[^/?#]*([^#]*)', 1)"


def query(u: str) -> str:
    return f"regexp_extract({rest(u)}, '\\?(.*)$', 1)"


def full_path(u: str) -> str:
    return f"regexp_extract({rest(u)}, '^([^?]*)', 1)"


def path(u: str) -> str:
    return f"regexp_replace({full_path(u)}, ';[^/]*$', '')"


def normalized(u: str) -> str:
    return (
        f"(SELECT CASE WHEN ends_with(b, '/') AND p <> '/' THEN substr(b, 1, length(b) - 1) ELSE b END FROM (SELECT {scheme(u)} || '://' || {netloc(u)} || {path(u)} "
        f"|| CASE WHEN {query(u)} <> '' THEN '?' || {query(u)} ELSE '' END AS b, {path(u)} AS p))"
    )


def problem(u: str) -> str:
    port = f"regexp_extract({netloc(u)}, ':([^:\\]@]*)$', 1)"
    host = f"regexp_replace(regexp_replace({netloc(u)}, '^.*@', ''), ':[^:\\]]*$', '')"
    return (
        f"CASE WHEN coalesce({u}, '') = '' THEN 'URL must be a non-empty string' WHEN {scheme(u)} NOT IN ('http', 'https') THEN 'only http:// and https:// URLs are supported' "
        f"WHEN {host} = '' THEN 'URL must include a hostname' WHEN contains({netloc(u)}, '@') THEN 'credentials in URLs are not allowed' "
        f"WHEN {port} <> '' AND (NOT regexp_full_match({port}, '[0-9]{{1,6}}') OR try_cast({port} AS INTEGER) > 65535) THEN 'invalid URL port: ' || {port} END"
    )


def crawlable(u: str) -> str:
    return f"NOT regexp_matches(lower({path(u)}), {_q(U._SKIPPED)})"


def joined(base: str, href: str) -> str:
    root = f"regexp_extract({base}, '^([^:/?#]+:)//', 1) || '//' || {netloc(base)}"
    directory = f"regexp_replace({full_path(base)}, '[^/]*$', '')"
    return (
        f"CASE WHEN {href} = '' THEN {base} WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^([^:/?#]+:)', 1) || {href} "
        f"WHEN starts_with({href}, '/') THEN {root} || {href} WHEN starts_with({href}, '?') THEN {root} || {full_path(base)} || {href} "
        f"WHEN starts_with({href}, '#') THEN regexp_replace({base}, '#.*$', '') || {href} ELSE {root} || CASE WHEN {directory} = '' THEN '/' ELSE {directory} END || {href} END"
    )


SEGMENT = f"CASE WHEN length({path('url')}) - length(replace({path('url')}, '/', '')) > 1 THEN split_part({path('url')}, '/', 2) ELSE 'root' END"
ODD = f"(SELECT url FROM pages UNION ALL SELECT url FROM {V('odd_urls')})"
LINKS = (
    "raw_links AS (SELECT url AS src_url, unnest(range(len(h))) AS link_no, unnest(h) AS href FROM (SELECT url, regexp_extract_all(html, "
    + _q(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""")
    + ", 1) AS h FROM pages)), "
    f"joined_links AS (SELECT *, {joined('src_url', 'href')} AS j FROM raw_links), links AS (SELECT src_url, link_no, href, {normalized('j')} AS dst_url FROM joined_links)"
)
BARE = sub("html", r"(?s)<!--.*?-->")


def element(x: str, tag: str) -> str:
    return f"regexp_extract({x}, {_q(rf'(?is)<{tag}{chr(92)}b[^>]*>(.*?)</{tag}{chr(92)}s*>')}, 1)"


def _auto(source: str) -> str:
    """CTEs auto (page_id, auto_raw) and body (page_id, body_raw) over a table with page_id and html."""
    return (
        f"bare_a AS (SELECT page_id, {without(BARE, extract.DROPPED_AUTO)} AS h FROM {source}), "
        f"auto AS (SELECT page_id, {text_with_breaks('e')} AS auto_raw FROM (SELECT page_id, coalesce(nullif({element('h', 'article')}, ''), {element('h', 'main')}) AS e FROM bare_a)), "
        f"bare_b AS (SELECT page_id, {without(BARE, extract.DROPPED)} AS h FROM {source}), "
        f"body AS (SELECT page_id, CASE WHEN regexp_matches(h, '(?i)<body\\b') THEN {text_with_breaks('regexp_extract(h, ' + _q(r'(?is)<body' + chr(92) + r'b[^>]*>(.*?)(</body\s*>|\z)') + ', 1)')} END AS body_raw FROM bare_b)"
    )


#: CTEs up to page: page_id, url, main_content, sha256, blocks, method of the plain extraction.
PAGE = (
    _auto("pages") + f", chosen AS (SELECT p.page_id, url, CASE WHEN length({collapse('auto_raw')}) > {extract.AUTO_LEAST} THEN 'auto' WHEN body_raw IS NOT NULL THEN 'body_fallback' ELSE 'failed' END AS method, auto_raw, body_raw FROM pages p JOIN auto USING (page_id) JOIN body USING (page_id)), "
    f"raw AS (SELECT page_id, url, method, CASE method WHEN 'auto' THEN auto_raw WHEN 'body_fallback' THEN body_raw ELSE '' END AS t FROM chosen), "
    f"page AS MATERIALIZED (SELECT page_id, url, method, {collapse('t')} AS main_content, CASE WHEN method = 'failed' THEN '' ELSE sha256({collapse('t')}) END AS sha256, {blocks('t')} AS blocks FROM raw)"
)
COMMON = f", freq AS (SELECT block, count(*) AS df FROM (SELECT unnest(list_distinct(blocks)) AS block FROM page) GROUP BY block), common AS MATERIALIZED (SELECT block, df FROM freq, (SELECT count(*) AS n FROM page) WHERE n >= 5 AND df * 100 >= n * {{percent}})"


def _overlaps(source: str, name: str) -> str:
    """CTEs to `name`: k1, k2 and the three measures of all pairs of a table with page_id, main_content, blocks."""
    n = name
    return (
        f", {n}_f AS MATERIALIZED (SELECT page_id AS k, {trigrams('main_content')} AS g, {tokens('main_content')} AS t, list_distinct(blocks) AS b FROM {source}), "
        f"{n}_g AS (SELECT k, unnest(g) AS v FROM {n}_f), {n}_t AS MATERIALIZED (SELECT k, v, count(*) AS tf FROM (SELECT k, unnest(t) AS v FROM {n}_f) GROUP BY k, v), {n}_b AS (SELECT k, unnest(b) AS v FROM {n}_f), "
        f"{n}_n AS MATERIALIZED (SELECT f.k, len(g) AS n_g, len(b) AS n_b, coalesce(q, 0)::BIGINT AS n_t FROM {n}_f f LEFT JOIN (SELECT k, sum(tf * tf) AS q FROM {n}_t GROUP BY k) s USING (k)), "
        f"{n}_pg AS (SELECT x.k AS k1, y.k AS k2, count(*) AS g FROM {n}_g x JOIN {n}_g y ON x.v = y.v AND x.k < y.k GROUP BY 1, 2), "
        f"{n}_pb AS (SELECT x.k AS k1, y.k AS k2, count(*) AS b FROM {n}_b x JOIN {n}_b y ON x.v = y.v AND x.k < y.k GROUP BY 1, 2), "
        f"{n}_pt AS (SELECT x.k AS k1, y.k AS k2, sum(x.tf * y.tf)::BIGINT AS d, sum(x.tf * x.tf)::BIGINT AS s1, sum(y.tf * y.tf)::BIGINT AS s2 FROM {n}_t x JOIN {n}_t y ON x.v = y.v AND x.k < y.k GROUP BY 1, 2), "
        f"{n}_c AS (SELECT a.k AS k1, b.k AS k2, a.n_g AS n_g1, b.n_g AS n_g2, a.n_b AS n_b1, b.n_b AS n_b2, a.n_t AS n_t1, b.n_t AS n_t2 FROM {n}_n a JOIN {n}_n b ON a.k < b.k), "
        f"{n} AS MATERIALIZED (SELECT k1, k2, coalesce(g, 0) AS shared_g, coalesce(b, 0) AS shared_b, n_b1, n_b2, "
        f"CASE WHEN n_g1 = 0 OR n_g2 = 0 THEN 0.0::DOUBLE ELSE coalesce(g, 0)::DOUBLE / (n_g1 + n_g2 - coalesce(g, 0)) END AS jaccard_3gram, "
        f"CASE WHEN coalesce(d, 0) = 0 THEN 0.0::DOUBLE ELSE {pairs.L2}::DOUBLE * d / (sqrt({pairs.L3}::DOUBLE * (n_t1 - s1) + {pairs.L2}::DOUBLE * s1) * sqrt({pairs.L3}::DOUBLE * (n_t2 - s2) + {pairs.L2}::DOUBLE * s2)) END AS tfidf_cosine, "
        f"CASE WHEN least(n_b1, n_b2) = 0 THEN 0.0::DOUBLE ELSE coalesce(b, 0)::DOUBLE / least(n_b1, n_b2) END AS block_overlap "
        f"FROM {n}_c LEFT JOIN {n}_pg USING (k1, k2) LEFT JOIN {n}_pb USING (k1, k2) LEFT JOIN {n}_pt USING (k1, k2))"
    )


def _tier(t: str) -> str:
    a, b, c = classify.THRESHOLDS[t]
    own = f"tfidf_cosine >= {a}::DOUBLE OR jaccard_3gram >= {b}::DOUBLE OR block_overlap >= {c}::DOUBLE"
    return f"sha256_match OR {own}" if t == "P1" else own


SCORED = "WITH " + PAGE + _overlaps("page", "o") + ", scored AS (SELECT o.*, x.url AS url1, y.url AS url2, x.sha256 = y.sha256 AS sha256_match FROM o JOIN page x ON x.page_id = k1 JOIN page y ON y.page_id = k2)"
CLASSIFIED = SCORED + f", classified AS (SELECT *, CASE WHEN {_tier('P1')} THEN 'P1' WHEN {_tier('P2')} THEN 'P2' WHEN {_tier('P3')} THEN 'P3' END AS priority FROM scored)"
COUNTS = "count(*) AS total_pairs, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (priority = 'P3') AS p3"


def _bound(k: int) -> str:
    return "CASE priority " + " ".join(f"WHEN '{t}' THEN {v[k]}::DOUBLE" for t, v in classify.THRESHOLDS.items()) + " END"


def _reason(k: int, name: str, column: str) -> str:
    bounds = "CASE priority " + " ".join(f"WHEN '{t}' THEN '{v[k]}'" for t, v in classify.THRESHOLDS.items()) + " END"
    return f"CASE WHEN {column} >= {_bound(k)} THEN '{name} ' || format('{{:.2f}}', {column}) || ' >= ' || {bounds} END"


CLEANED = "WITH " + PAGE + COMMON.format(percent=CLEAN_PERCENT) + ", cleaned AS MATERIALIZED (SELECT page_id, list_filter(blocks, lambda b: NOT list_contains(gone, b)) AS blocks FROM page, (SELECT coalesce(list(block), []) AS gone FROM common))"
MIXED = (
    "mixed AS (SELECT page_id, url, CASE WHEN page_id % 6 = 1 THEN '<h1>' WHEN page_id % 6 = 2 THEN '<none>' WHEN page_id % 6 = 3 THEN '<h1>' END AS a, CASE WHEN page_id % 6 = 1 THEN '</h1>' WHEN page_id % 6 = 2 THEN '</none>' END AS z, "
    "CASE WHEN page_id % 6 = 4 THEN replace(replace(html, '<article>', '<div>'), '</article>', '</div>') WHEN page_id % 6 = 5 THEN NULL ELSE html END AS html FROM pages), "
    + _auto("mixed")
    + ", cut AS (SELECT page_id, CASE WHEN s > 0 AND e > 0 THEN substr(html, s + length(a), e - 1) ELSE '' END AS c FROM (SELECT page_id, html, a, strpos(html, a) AS s, strpos(substr(html, strpos(html, a) + length(a)), z) AS e FROM mixed WHERE a IS NOT NULL AND z IS NOT NULL)), "
    f"method AS (SELECT m.page_id, auto_raw, body_raw, c, CASE WHEN html IS NULL THEN 'fetch_failed' WHEN a IS NOT NULL AND z IS NOT NULL THEN CASE WHEN c <> '' THEN 'markers' ELSE 'markers_failed' END WHEN length({collapse('auto_raw')}) > {extract.AUTO_LEAST} THEN 'auto' WHEN body_raw IS NOT NULL THEN 'body_fallback' ELSE 'failed' END AS method FROM mixed m JOIN auto USING (page_id) JOIN body USING (page_id) LEFT JOIN cut USING (page_id)), "
    "rawm AS (SELECT page_id, method, CASE method WHEN 'markers' THEN c WHEN 'auto' THEN auto_raw WHEN 'body_fallback' THEN body_raw ELSE '' END AS t FROM method)"
)

# robots
ROBOTS = (
    f"rl AS (SELECT host, line_no, trim(replace(split_part(raw, '#', 1), chr(9), ' ')) AS t FROM (SELECT host, unnest(range(len(l))) AS line_no, unnest(l) AS raw FROM (SELECT host, regexp_split_to_array(body, '\\r\\n|\\r|\\n') AS l FROM {V('robots_files')}))), "
    "rf AS (SELECT host, line_no, lower(trim(split_part(t, ':', 1))) AS field, trim(regexp_replace(t, '^[^:]*:', '')) AS value FROM rl WHERE contains(t, ':')), "
    "rk AS (SELECT *, field = 'user-agent' AS is_agent FROM rf WHERE field IN ('user-agent', 'disallow', 'allow', 'crawl-delay')), "
    "rs AS (SELECT * FROM (SELECT *, max(is_agent::INT) OVER (PARTITION BY host ORDER BY line_no) AS seen FROM rk) WHERE seen = 1), "
    "rb AS (SELECT *, (is_agent AND NOT coalesce(lag(is_agent) OVER (PARTITION BY host ORDER BY line_no), true))::INT AS begins FROM rs), "
    "rg AS (SELECT *, sum(begins) OVER (PARTITION BY host ORDER BY line_no) AS grp FROM rb), "
    "ra AS (SELECT host, grp, lower(value) AS agent, line_no AS agent_line FROM rg WHERE is_agent AND value <> ''), "
    "rr AS (SELECT host, grp, line_no AS rule_seq, field = 'allow' OR value = '' AS allow, value AS pattern FROM rg WHERE field IN ('allow', 'disallow') AND NOT (field = 'allow' AND value = '')), "
    "rules AS (SELECT ra.host, agent, agent_line, rule_seq, allow, pattern, length(translate(pattern, '*$', '')) AS length, "
    "'^' || replace(regexp_replace(regexp_replace(pattern, '\\$$', ''), '([.\\\\+?\\[\\](){}|^$\\-])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(pattern, '$') THEN '$' ELSE '' END AS regex FROM ra JOIN rr ON ra.host = rr.host AND ra.grp = rr.grp), "
    "named AS (SELECT host, max_by(agent, (length(agent), -agent_line)) AS named FROM rules WHERE agent <> '*' AND (contains('auditbot/1.0', agent) OR contains(agent, 'auditbot/1.0')) GROUP BY host), "
    "own AS (SELECT rules.* FROM rules LEFT JOIN named ON rules.host = named.host WHERE agent = coalesce(named, '*'))"
)
_RANGES = "(VALUES " + ", ".join(f"({int(n[0])}, {int(n[-1])})" for n in policy._V4) + ") AS r(lo, hi)"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

SQL: dict[str, str] = {
    "page_scan": "SELECT page_id, url, length(html) AS html_chars FROM pages",
    "csv_inputs": f"SELECT input_idx, url, nullif(selector, '') AS selector, nullif(start_marker, '') AS start_marker, nullif(end_marker, '') AS end_marker FROM {V('csv_rows')}",
    "url_parts": f"SELECT page_id, {scheme('url')} AS scheme, {netloc('url')} AS netloc, {path('url')} AS path, {query('url')} AS query, {SEGMENT} AS segment FROM pages",
    "url_normalized": f"SELECT url, {normalized('url')} AS normalized FROM {ODD}",
    "url_validity": f"SELECT url, {problem('url')} AS problem FROM {ODD}",
    "url_filters": f"SELECT url, {crawlable('url')} AS crawlable, regexp_matches(url, {_q('|'.join(U.EXCLUDED))}) AS excluded, contains(lower(url), '/product') AS is_product FROM {ODD}",
    "link_extract": f"WITH {LINKS} SELECT src_url, link_no, href, dst_url FROM links",
    "same_domain_links": f"WITH {LINKS} SELECT src_url, link_no, dst_url FROM links WHERE {problem('dst_url')} IS NULL AND {crawlable('dst_url')} AND {netloc('src_url')} = {netloc('dst_url')}",
    "link_out_degree": f"WITH {LINKS} SELECT src_url, count(*) AS links, count(DISTINCT dst_url) AS targets FROM links GROUP BY src_url",
    "host_page_counts": f"SELECT {netloc('url')} AS host, count(*) AS pages FROM pages GROUP BY 1",
    "path_histogram_top10": f"SELECT {SEGMENT} AS segment, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, segment LIMIT 10",
    "crawl_bfs": (
        f"WITH RECURSIVE e AS (SELECT * FROM {V('edges')} WHERE {problem('dst_url')} IS NULL AND {crawlable('dst_url')} AND {netloc('src_url')} = {netloc('dst_url')}), "
        "r AS (SELECT 'https://shop.example/p0' AS url, 0 AS depth UNION SELECT dst_url, depth + 1 FROM r JOIN e ON src_url = url WHERE depth < 30) SELECT url, min(depth)::INTEGER AS depth FROM r GROUP BY url"
    ),
    "crawl_frontier_antijoin": f"WITH e AS (SELECT * FROM {V('edges')}), v AS (SELECT DISTINCT src_url AS url FROM e WHERE src_url < 'https://shop.example/p3') SELECT DISTINCT dst_url AS url FROM e JOIN v ON src_url = v.url WHERE dst_url NOT IN (SELECT url FROM v)",
    "extract_markers": "WITH m AS (SELECT page_id, html, strpos(html, '<article>') AS s, strpos(substr(html, strpos(html, '<article>') + 9), '</article>') AS e FROM pages), c AS (SELECT page_id, CASE WHEN s > 0 AND e > 0 THEN substr(html, s + 9, e - 1) ELSE '' END AS t FROM m) SELECT page_id, length(t) AS chars, sha256(t) AS slice_sha256 FROM c",
    "extract_article": f"WITH {_auto('pages')} SELECT page_id, {collapse('auto_raw')} AS content FROM auto",
    "extract_body_fallback": f"WITH {_auto('pages')}, c AS (SELECT page_id, {collapse('body_raw')} AS t FROM body) SELECT page_id, sha256(t) AS body_sha256, length(t) AS chars FROM c",
    "extract_precedence": (
        f"WITH {MIXED} SELECT page_id, method AS extraction_method, method IN ('markers', 'auto') AS extraction_confident, "
        "CASE method WHEN 'markers_failed' THEN 'Markers not found in HTML' WHEN 'body_fallback' THEN 'Main content extraction uncertain: using body fallback' WHEN 'failed' THEN 'No extractable content found' END AS error, "
        f"CASE WHEN method IN ('fetch_failed', 'failed', 'markers_failed') THEN '' ELSE sha256({collapse('t')}) END AS sha256, len({blocks('t')}) AS block_count FROM rawm"
    ),
    "extract_css_select": f"SELECT page_id, {text_with_breaks(element('html', 'title'))} AS title, {text_with_breaks('regexp_extract(html, ' + _q('(?s)<div class=.ad.>(.*?)</div>') + ', 1)')} AS ad FROM pages",
    "page_fingerprints": f"WITH {PAGE} SELECT page_id, method AS extraction_method, sha256, length(main_content) AS main_content_length, len(blocks) AS block_count, CASE WHEN main_content = '' THEN 0 ELSE len(string_split(main_content, ' ')) END AS word_count, regexp_matches(main_content, {_q(f'[{X.CJK}]')}) AS has_cjk FROM page",
    "page_blocks": f"WITH {PAGE} SELECT page_id, unnest(range(len(blocks))) AS pos, unnest(blocks) AS block FROM page",
    "block_document_frequency": f"WITH {PAGE} SELECT block, count(*) AS df FROM (SELECT unnest(list_distinct(blocks)) AS block FROM page) GROUP BY block",
    "common_blocks": "WITH " + PAGE + COMMON.format(percent=CLEAN_PERCENT) + " SELECT block, df FROM common",
    "clean_blocks": CLEANED + " SELECT page_id, len(blocks) AS n, sha256(coalesce(array_to_string(blocks, ' '), '')) AS clean_sha256 FROM cleaned",
    "exact_duplicate_groups": f"WITH d AS (SELECT doc_id, sha256({collapse('text')}) AS h FROM documents), g AS (SELECT h, min(doc_id) AS class_id, count(*) AS copies FROM d GROUP BY h) SELECT doc_id, class_id, copies FROM d JOIN g USING (h)",
    "trigram_counts": f"WITH {PAGE} SELECT page_id, len({trigrams('main_content')}) AS trigrams FROM page",
    "document_trigrams": f"SELECT doc_id, len({trigrams('text')}) AS trigrams FROM documents",
    "term_frequency": f"WITH {PAGE} SELECT page_id, term, count(*) AS tf FROM (SELECT page_id, unnest({tokens('main_content')}) AS term FROM page) GROUP BY ALL",
    "trigram_jaccard_pairs": "WITH " + PAGE + _overlaps("page", "o") + " SELECT k1, k2, shared_g AS shared, jaccard_3gram FROM o",
    "jaccard_prefix_pairs": "WITH " + PAGE + _overlaps("page", "o") + " SELECT k1, k2, jaccard_3gram FROM o WHERE jaccard_3gram >= 0.7::DOUBLE",
    "tfidf_cosine_pairs": "WITH " + PAGE + _overlaps("page", "o") + " SELECT k1, k2, tfidf_cosine FROM o",
    "block_overlap_pairs": "WITH " + PAGE + _overlaps("page", "o") + " SELECT k1, k2, shared_b AS shared, block_overlap FROM o",
    "clean_view_pairs": (
        CLEANED + ", ct AS MATERIALIZED (SELECT page_id, coalesce(array_to_string(blocks, ' '), '') AS main_content, blocks FROM cleaned)" + _overlaps("ct", "o") + " SELECT k1, k2, "
        + ", ".join(f"CASE WHEN (SELECT count(*) FROM common) > 0 AND n_b1 > 0 AND n_b2 > 0 THEN {c} END AS {c}_clean" for c in ("jaccard_3gram", "tfidf_cosine", "block_overlap")) + " FROM o"
    ),
    "pairs_scored": SCORED + " SELECT k1, k2, url1, url2, sha256_match, jaccard_3gram, tfidf_cosine, block_overlap FROM scored",
    "pairs_classified": CLASSIFIED + " SELECT k1, k2, url1, url2, sha256_match, jaccard_3gram, tfidf_cosine, block_overlap, priority FROM classified",
    "trigger_flags": CLASSIFIED + f" SELECT k1, k2, priority, priority = 'P1' AND sha256_match AS hit_sha256, tfidf_cosine >= {_bound(0)} AS hit_tfidf_cosine, jaccard_3gram >= {_bound(1)} AS hit_jaccard_3gram, block_overlap >= {_bound(2)} AS hit_block_overlap FROM classified WHERE priority IS NOT NULL",
    "trigger_reasons": CLASSIFIED + (
        " SELECT k1, k2, priority, array_to_string([x FOR x IN [CASE WHEN priority = 'P1' AND sha256_match THEN 'SHA-256 exact match' END, "
        + ", ".join(_reason(*x) for x in ((0, "TF-IDF", "tfidf_cosine"), (1, "Jaccard", "jaccard_3gram"), (2, "Block overlap", "block_overlap")))
        + "] IF x IS NOT NULL], '; ') AS reasons FROM classified WHERE priority IS NOT NULL"
    ),
    "priority_counts": CLASSIFIED + f" SELECT {COUNTS} FROM classified",
    "ci_gate": CLASSIFIED + " SELECT p1, CASE WHEN p1 > 10 THEN 'fail' WHEN p1 > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM (SELECT count(*) FILTER (priority = 'P1') AS p1 FROM classified)",
    "p1_top20": CLASSIFIED + " SELECT k1, k2, url1, url2 FROM classified WHERE priority = 'P1' ORDER BY k1, k2 LIMIT 20",
    "most_duplicated_top5": CLASSIFIED + " SELECT url, count(*) AS n FROM (SELECT unnest([url1, url2]) AS url FROM classified WHERE priority = 'P1') GROUP BY url ORDER BY n DESC, url LIMIT 5",
    "duplicate_statistics": CLASSIFIED + f" SELECT (SELECT count(*) FROM page) AS total_pages, (SELECT count(*) FILTER (method = 'failed') FROM page) AS extraction_failures, {COUNTS}, count(*) FILTER (sha256_match) AS exact_duplicates FROM classified",
    "audit_summary": f"WITH {MIXED} SELECT count(*) AS total, count(*) FILTER (method IN ('markers', 'auto')) AS successful, count(*) FILTER (method = 'body_fallback') AS uncertain, count(*) FILTER (method IN ('fetch_failed', 'failed', 'markers_failed')) AS failed FROM rawm",
    "failure_gates": (
        "WITH g AS (SELECT count(*) FILTER (extraction_method = 'fetch_failed' OR status_code IS NULL OR status_code >= 400)::DOUBLE / count(*) AS fetch_rate, count(*) FILTER (extraction_method IN ('failed', 'selector_failed', 'markers_failed'))::DOUBLE / count(*) AS extraction_rate "
        f"FROM {V('status_pages')}) SELECT fetch_rate, extraction_rate, CASE WHEN fetch_rate > 0.2::DOUBLE THEN 2 WHEN extraction_rate > 0.2::DOUBLE THEN 3 ELSE 0 END::BIGINT AS exit_code FROM g"
    ),
    "robots_parse": f"WITH {ROBOTS} SELECT host, agent, rule_seq, allow, pattern, length FROM rules",
    "robots_verdict": (
        f"WITH {ROBOTS}, u AS (SELECT url, {netloc('url')} AS host, CASE WHEN {path('url')} = '' THEN '/' ELSE {path('url')} END || CASE WHEN {query('url')} <> '' THEN '?' || {query('url')} ELSE '' END AS target FROM {V('robots_urls')}) "
        "SELECT u.url, u.host, u.target, coalesce(max_by(allow, (length, allow::INT)), true) AS allowed FROM u LEFT JOIN own ON own.host = u.host AND regexp_matches(u.target, own.regex) GROUP BY ALL"
    ),
    "robots_crawl_delay": (
        f"WITH {ROBOTS}, d AS (SELECT host, max_by(try_cast(value AS DOUBLE), line_no) FILTER (try_cast(value AS DOUBLE) IS NOT NULL) AS crawl_delay FROM rf WHERE field = 'crawl-delay' GROUP BY host), "
        "p AS (SELECT *, CASE WHEN crawl_delay < 0 THEN NULL WHEN crawl_delay > 3600 THEN 3600::DOUBLE ELSE crawl_delay END AS used_delay, crawl_delay < 0 OR crawl_delay > 3600 AS warned FROM d WHERE crawl_delay IS NOT NULL) SELECT *, greatest(0.5::DOUBLE, coalesce(used_delay, 0::DOUBLE)) AS min_interval FROM p"
    ),
    "robots_sitemaps": f"WITH {ROBOTS} SELECT host, value AS sitemap FROM rf WHERE field = 'sitemap' AND value <> ''",
    "robots_nothing_disallowed": f"WITH {ROBOTS} SELECT host, bool_and(allow) AS nothing_disallowed FROM own GROUP BY host",
    "robots_availability": (
        f"SELECT *, CASE WHEN denied THEN 'robots.txt unavailable for ' || host || ' (' || coalesce('status ' || status::VARCHAR, 'unreachable') || '); crawling denied' END AS warning FROM (SELECT host, status, status IS NULL OR status = 429 OR status >= 500 OR status BETWEEN 300 AND 399 AS denied, coalesce(status = 200, false) AS has_rules FROM {V('robots_status')})"
    ),
    "ip_policy": (
        f"WITH n AS (SELECT ip, CASE WHEN regexp_full_match(ip, '{_OCTET}(\\.{_OCTET}){{3}}') THEN split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT END AS ip_number FROM {V('addresses')}) "
        f"SELECT ip, ip_number, ip_number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_RANGES} WHERE ip_number BETWEEN lo AND hi) AS is_public FROM n"
    ),
    "ip_policy_any": (
        f"WITH n AS (SELECT ip, CASE WHEN regexp_full_match(ip, '{_OCTET}(\\.{_OCTET}){{3}}') THEN split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT END AS ip_number FROM {V('addresses')}) "
        f"SELECT ip, ip_number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_RANGES} WHERE ip_number BETWEEN lo AND hi) AS is_public FROM n "
        "UNION ALL SELECT * FROM (VALUES ('::1', false), ('2606:4700::1111', true), ('::ffff:10.0.0.1', false), ('64:ff9b::808:808', true), ('fe80::1', false)) AS v(ip, is_public)"
    ),
    "media_type_filter": (
        "SELECT url, CASE WHEN t NOT IN ('text/html', 'application/xhtml+xml') THEN 'Unsupported content type: ' || CASE WHEN t = '' THEN 'missing' ELSE t END END AS type_problem, CASE WHEN e NOT IN ('', 'identity', 'gzip', 'deflate') THEN 'Unsupported content encoding: ' || e END AS encoding_problem "
        f"FROM (SELECT url, lower(trim(split_part(coalesce(content_type, ''), ';', 1))) AS t, lower(trim(coalesce(content_encoding, ''))) AS e FROM {V('responses')})"
    ),
    "response_size_filter": "SELECT page_id, CASE WHEN strlen(html) > 8000 THEN 'Response exceeded 8000 bytes' END AS problem FROM pages",
    "resume_remaining": f"SELECT input_idx, url FROM {V('planned')} WHERE url NOT IN (SELECT url FROM {V('fetched')})",
    "resume_inputs": (
        f"WITH i AS (SELECT url, arg_max(selector, input_idx) FILTER (true) AS s, max(input_idx) AS m FROM {V('csv_rows')} GROUP BY url), l AS (SELECT c.url, nullif(selector, '') AS selector, nullif(start_marker, '') AS start_marker, nullif(end_marker, '') AS end_marker FROM {V('csv_rows')} c JOIN i ON i.url = c.url AND i.m = c.input_idx), "
        f"u AS (SELECT url FROM {V('planned')} UNION ALL SELECT url FROM {V('csv_rows')}) SELECT u.url, selector, start_marker, end_marker FROM u LEFT JOIN l ON u.url = l.url"
    ),
    "plan_union_distinct": f"WITH b AS (SELECT 0 AS part, * FROM {V('fetched')} UNION ALL SELECT 1, * FROM {V('planned')}), o AS (SELECT url, min((part, input_idx)) AS a FROM b GROUP BY url) SELECT url, row_number() OVER (ORDER BY a) - 1 AS input_idx FROM o",
    "config_diff": f"SELECT coalesce(s.key, c.key) AS key, s.value AS saved, c.value AS current FROM {V('saved_config')} s FULL JOIN {V('current_config')} c ON s.key = c.key WHERE s.value IS DISTINCT FROM c.value",
    "markdown_escape": f"SELECT text, replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10), ' ') AS escaped FROM {V('markdown')}",
}
