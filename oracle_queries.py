"""SQL that says the same as the registered queries, for DuckDB over the same tables.

The pages share one layout, so patterns over the text can stand in for a parser.
"""


def text(x: str) -> str:
    """Decode the four references that occur; the last one may lack its ';' where a title is cut."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"')):
        x = f"replace({x}, '&{name};', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def between(open_: str, close: str) -> str:
    return f"regexp_extract(html, '{open_}(.*?){close}', 1, 's')"


def has(open_: str, close: str) -> str:
    return f"regexp_matches(html, '{open_}.*?{close}', 's')"


def value(column: str, open_: str, close: str) -> str:
    return (
        f"SELECT page_id, trim({text(between(open_, close))}) AS {column} "
        f"FROM pages WHERE {has(open_, close)}"
    )


NAV = """
nav AS (
  SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
         regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS texts
  FROM pages
), links AS (
  SELECT page_id, url, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS raw, unnest(texts) AS raw_text FROM nav
), link AS (
  SELECT page_id, url, pos, TEXT_HREF AS href, trim(TEXT_TEXT) AS txt FROM links
), abs AS (
  SELECT page_id, pos, href, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
         regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(href, '[?#;].*$', '') AS abs_url
  FROM link
), firsts AS (
  SELECT * FROM abs QUALIFY row_number() OVER (PARTITION BY host, abs_url ORDER BY page_id, pos) = 1
)
""".replace("TEXT_HREF", text("raw")).replace("TEXT_TEXT", text("raw_text"))

LI = (
    "SELECT page_id, string_agg({what}, '|' ORDER BY pos) AS {col} FROM link "
    "WHERE {cond} GROUP BY page_id"
)


def items(col: str, what: str, cond: str) -> str:
    return f"WITH {NAV} " + LI.format(col=col, what=what, cond=cond)


def js(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


HEAD = f"""
h AS (
  SELECT page_id, url, trim({text(between('<h1>', '</h1>'))}) AS h1, trim({text(between('<title>', '</title>'))}) AS title,
         regexp_extract(url, '^https?://([^/?#]*)', 1) AS host
  FROM pages
), art AS (
  SELECT page_id, url, host, '{{"h1":' || {js('h1')} || '}}' AS components FROM h
), ident AS (
  SELECT *, sha1(host || '-' || components) AS id FROM art
), uniq AS (
  SELECT * FROM ident QUALIFY row_number() OVER (PARTITION BY id ORDER BY page_id) = 1
)
"""
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SEEN_DAY = "(length(abs_url) % 30 + 1)"
VISITS = "SELECT 'http://h.com/u/' || user_id AS url, ts, event_type FROM events"
CHAIN = """
WITH RECURSIVE c AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL
  SELECT e.user_id, min(e.ts) AS ts FROM c JOIN events e
    ON e.user_id = c.user_id AND e.ts >= c.ts + INTERVAL 2 DAY GROUP BY e.user_id
) SELECT user_id, ts FROM c
"""
NO_MARKUP = (
    "regexp_replace(regexp_replace(regexp_replace(html, '<script>.*?</script>', '<script></script>', 'gs'), "
    "'<style>.*?</style>', '<style></style>', 'gs'), '<!--.*?-->', '', 'gs')"
)
OPEN_TAGS = f"regexp_extract_all({NO_MARKUP}, '<([a-z][a-z0-9]*)[^>]*>', 1)"
ARTICLE = "regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's')"
#: Offsets of the zones, in the order of their names: ACDT, ACST, AEDT, AEST, AWST, BST, CDT, CEST, CET, CST, EDT, EST, GMT, IST, MDT, MST, PDT, PST, UTC.
ZONES = (
    "['+10:30', '+09:30', '+11:00', '+10:00', '+08:00', '+01:00', '-05:00', '+02:00', '+01:00', '-06:00', '-04:00', '-05:00', "
    "'+00:00', '+05:30', '-06:00', '-07:00', '-07:00', '-08:00', '+00:00']"
)
CRAWL = f"""
WITH {NAV}, {HEAD}, alias AS (
  SELECT abs_url, min(page_id) AS page_id FROM abs WHERE pos = 0 GROUP BY abs_url
), found AS (
  SELECT abs_url, host, page_id AS seed, pos FROM abs
  QUALIFY row_number() OVER (PARTITION BY abs_url ORDER BY page_id, pos) = 1
), grp AS (SELECT unnest([0, 1]) AS g), kept AS (
  SELECT g, abs_url, host, seed, pos FROM found, grp WHERE COND
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY seed, pos) <= CAP
), res AS (
  SELECT k.g, k.seed, k.pos, k.abs_url AS url, k.host,
         CASE WHEN k.g = 0 THEN '{{"h1":' || {js('h.h1')} || '}}' ELSE '{{"t":' || {js('h.title')} || '}}' END AS components
  FROM kept k JOIN alias a ON a.abs_url = k.abs_url JOIN h ON h.page_id = a.page_id
), recs AS (
  SELECT CASE WHEN g = 0 THEN '{{"set": "demo"}}' END AS metadata,
         sha1(host || '-' || components) AS id, url, components, g, seed, pos FROM res
)
"""
ALL_LINKS = CRAWL.replace("COND", "true").replace("CAP", "9223372036854775807")

# an unclosed paragraph holds everything up to the end of the article
PARAGRAPHS = f"""
WITH {HEAD}, body AS (SELECT page_id, {ARTICLE} AS b FROM pages),
seg AS (
  SELECT page_id, unnest(string_split(b, '<p>')[2:]) AS s, unnest(range(len(string_split(b, '<p>')) - 1)) AS i FROM body
), plain AS (
  SELECT page_id, i, s, {text("regexp_replace(s, '<[^>]*>', '', 'g')")} AS t FROM seg
), para AS (
  SELECT page_id, i, trim(CASE WHEN s LIKE '%</p>' THEN t ELSE
    string_agg(t, '') OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END) AS t FROM plain
), ps AS (
  SELECT page_id, string_agg({js('t')}, ',' ORDER BY i) AS x FROM para GROUP BY page_id
), comp AS (
  SELECT url, host, '{{"article":[{{"h1":' || {js('h1')} || '}}' || coalesce(',{{"p":[' || x || ']}}', '') || ']}}' AS components
  FROM h LEFT JOIN ps USING (page_id)
) SELECT sha1(host || '-' || components) AS id, url, components FROM comp
"""

#: Messages from the ids in ``d``.
DONE = """SELECT md5(id)[1:2] AS part, '[' || string_agg('{"id":"' || id || '"}', ',' ORDER BY id) || ']' AS done FROM d GROUP BY part"""

ORACLE = {
    "article_components": PARAGRAPHS,
    "page_title": value("title", "<title>", "</title>"),
    "page_h1": value("h1", "<h1>", "</h1>"),
    "meta_charset": "SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset "
    "FROM pages WHERE regexp_matches(html, '<meta charset=\"')",
    "page_links": f"WITH {NAV} SELECT page_id, pos, href FROM link",
    "element_counts": f"SELECT tag, count(*) AS n FROM (SELECT unnest({OPEN_TAGS}) AS tag FROM pages) GROUP BY tag",
    "element_shape": f"SELECT page_id, len({OPEN_TAGS}) AS n_elements, true AS consistent FROM pages",
    "article_paragraph_count": f"SELECT page_id, len(regexp_extract_all({ARTICLE}, '<p>')) AS n_p FROM pages",
    "nav_links_nested": f"WITH {NAV} SELECT page_id, '{{\"nav\":[' || string_agg('{{\"a\":' || {js('trim(href)')} || '}}', ',' ORDER BY pos) || ']}}' AS nav FROM link GROUP BY page_id",
    "nav_both_nested": f"WITH {NAV} SELECT page_id, '{{\"nav\":[' || string_agg('{{\"to\":' || {js('trim(href)')} || '}},{{\"text\":' || {js('txt')} || '}}', ',' ORDER BY pos) || ']}}' AS nav FROM link GROUP BY page_id",
    "head_first_children": f"WITH {HEAD} SELECT page_id, '{{\"head\":[{{\"title\":' || {js('title')} || '}},{{\"h1\":' || {js('h1')} || '}}]}}' AS head FROM h",
    "include_self_order": f"WITH {HEAD}, {NAV}, n AS (SELECT page_id, string_agg('{{\"a\":' || {js('txt')} || '}}', ',' ORDER BY pos) AS x FROM link GROUP BY page_id) "
    f"SELECT page_id, '{{\"parts\":[{{\"h\":' || {js('title')} || '}},' || x || ',{{\"h\":' || {js('h1')} || '}}]}}' AS parts FROM h JOIN n USING (page_id)",
    "nth_nav_item": f"WITH {NAV} SELECT page_id, txt AS item FROM link WHERE pos = 1",
    "last_nav_item": f"WITH {NAV} SELECT page_id, txt AS item FROM link QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) = 1",
    "later_nav_items": items("items", "txt", "pos > 0"),
    "css_class_text": value("ad", '<div class="ad">', "</div>"),
    "css_attribute_prefix": items("hrefs", "trim(href)", "starts_with(href, '/t')"),
    "css_attribute_contains": items("hrefs", "trim(href)", "contains(href, 'en')"),
    "css_sibling": value("h1", "<h1>", "</h1>"),
    "css_has": items("texts", "txt", "href = '/de'"),
    "css_not": f"WITH {NAV}, m AS (SELECT *, max(pos) OVER (PARTITION BY page_id) AS top FROM link) "
    "SELECT page_id, string_agg(txt, '|' ORDER BY pos) AS texts FROM m WHERE pos > 0 AND pos < top GROUP BY page_id",
    "h1_html": f"SELECT page_id, '<h1>' || replace({text(between('<h1>', '</h1>'))}, '&', '&amp;') || '</h1>' AS html FROM pages WHERE {has('<h1>', '</h1>')}",
    "nav_html": "SELECT page_id, replace(regexp_extract(html, '<nav>.*?</nav>', 0, 's'), '&quot;', '\"') AS html FROM pages WHERE regexp_matches(html, '<nav>.*?</nav>', 's')",
    "ad_classes": "SELECT page_id, 'ad' AS words FROM pages WHERE contains(html, '<div class=\"ad\">')",
    "script_text": "SELECT page_id, trim(regexp_extract(html, '<script>(.*?)</script>', 1, 's')) AS script FROM pages WHERE contains(html, '<script>')",
    "link_pattern": items("hrefs", "trim(href)", "regexp_matches(trim(href), '^/[a-z]{2}$') OR contains(href, 'on')"),
    "abs_links": f"WITH {NAV} SELECT page_id, pos, abs_url FROM abs",
    "url_parts": "SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#;]*)', 1) AS path FROM pages",
    "valid_urls": "SELECT c_custkey, CASE c_custkey % 7 WHEN 2 THEN NOT contains(CAST(c_custkey AS VARCHAR), '0') WHEN 4 THEN NOT contains(CAST(c_custkey AS VARCHAR), '0') WHEN 6 THEN true ELSE false END AS valid, "
    "c_custkey % 7 IN (2, 4, 6) AS valid_loose FROM customer",
    "joined_links": "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'http://h.com/p' || p_partkey WHEN 1 THEN 'http://h.com/a/c' || p_partkey WHEN 2 THEN 'http://h.com/d' || p_partkey "
    "WHEN 3 THEN 'http://h.com/p' || p_partkey WHEN 4 THEN 'http://h.com/a/x' || p_partkey || '@y' WHEN 5 THEN 'https://o.com/p?q=' || p_partkey WHEN 6 THEN 'http://h.com/a/' || p_partkey || '/' ELSE '?q=' || p_partkey END AS abs_url FROM part",
    "links_distinct": f"WITH {NAV} SELECT host, abs_url, page_id AS seed_pos, pos AS link_pos FROM firsts",
    "links_capped": f"WITH {NAV} SELECT host, abs_url FROM firsts QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id, pos) <= 7",
    "links_unseen": f"WITH {NAV} SELECT host, abs_url FROM firsts WHERE {SEEN_DAY} <= 20",
    "seen_upsert": f"WITH v AS ({VISITS}), o AS (SELECT url, max(ts) AS ts FROM v WHERE event_type <> 'purchase' GROUP BY url), n AS (SELECT url, max(ts) AS ts FROM v WHERE event_type = 'purchase' GROUP BY url) "
    "SELECT coalesce(n.url, o.url) AS url, coalesce(n.ts, o.ts) + INTERVAL 2 DAY AS expiration_date FROM o FULL JOIN n ON o.url = n.url",
    "seen_prune": f"WITH v AS ({VISITS}) SELECT url, max(ts) + INTERVAL 2 DAY AS expiration_date FROM v GROUP BY url HAVING max(ts) + INTERVAL 2 DAY > TIMESTAMP '2024-01-20'",
    "ttl_admitted": CHAIN,
    "ttl_admitted_large_keys": CHAIN,
    "ttl_latest_seen": f"WITH v AS ({VISITS}) SELECT url, max(ts) + INTERVAL 2 DAY AS expiration_date FROM v GROUP BY url",
    "regex_original": r"SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}') OR regexp_matches(text, '@[a-z]+\.') OR contains(text, 'Copyright')",
    "regex_first": "SELECT doc_id, CASE WHEN regexp_matches(text, '[a-zA-Z0-9.]+@[a-z.]+') THEN regexp_extract(text, '[a-zA-Z0-9.]+@[a-z.]+') WHEN regexp_matches(text, '[0-9]+') THEN regexp_extract(text, '[0-9]+') ELSE regexp_extract(text, '[A-Z][a-z]+') END AS match "
    "FROM documents WHERE regexp_matches(text, '[a-zA-Z0-9.]+@[a-z.]+|[0-9]+|[A-Z][a-z]+')",
    "epoch_dates": "SELECT o_orderkey, CASE WHEN epoch(o_orderdate) >= 1000000000 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS iso FROM orders",
    "text_dates": f"""
WITH o AS (SELECT o_orderkey, o_orderkey % 14 AS form, strftime(o_orderdate, '%Y-%m-%dT') AS day,
  format('{{:02d}}:{{:02d}}:00', o_orderkey % 24, o_orderkey % 60) AS clock, {ZONES}[o_orderkey % 19 + 1] AS zone FROM orders)
SELECT o_orderkey, day || CASE WHEN form IN (3, 4, 7, 11) THEN '00:00:00' ELSE clock END
  || CASE WHEN form IN (0, 5) THEN zone WHEN form IN (1, 9, 10) THEN '+00:00' WHEN form IN (6, 12) THEN '+03:00' ELSE '' END AS iso FROM o""",
    "json_scalar": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "json_recursive": "SELECT event_id, json_extract_string(props, '$.k') || ',' || event_type || ',' || event_id AS ks FROM events",
    "json_repeated_keys": "SELECT event_id, event_type AS a FROM events",
    "json_bad_text": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events",
    "regex_braces": "SELECT event_id, props AS json FROM events",
    "ttl_small": f"WITH v AS ({VISITS}), d AS (SELECT DISTINCT url, ts FROM v) "
    "SELECT url, ts FROM d QUALIFY coalesce(ts - lag(ts) OVER (PARTITION BY url ORDER BY ts) >= INTERVAL 1 MILLISECOND, true)",
    "seed_listing": f"WITH {NAV}, s AS (SELECT min(url) AS url FROM pages GROUP BY regexp_extract(url, '^https?://[^/?#]*\\.([a-z]+)', 1)), "
    "l AS (SELECT max(page_id) AS page_id FROM pages JOIN s USING (url) GROUP BY url) SELECT DISTINCT abs_url FROM abs JOIN l USING (page_id)",
    "nav_first_child": f"WITH {NAV} SELECT page_id, '{{\"nav\":{{\"a\":' || {js('txt')} || '}}}}' AS nav FROM link WHERE pos = 0",
    "any_element": "SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset "
    "FROM pages WHERE regexp_matches(html, '<meta charset=\"')",
    "by_id": value("h1", "<h1>", "</h1>"),
    "no_root": f"SELECT * FROM ({value('h1', '<h1>', '</h1>')}) WHERE page_id % 2 = 0",
    "strip_unicode": f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^{SPACE}+', ''), '{SPACE}+$', '')) AS digest FROM documents",
    "utf8_pages": "SELECT page_id, length(html) AS n_chars FROM pages WHERE page_id % 7 <> 0",
    "spec_quality": "SELECT p_partkey, unnest(CASE p_partkey % 6 WHEN 1 THEN ['version'] WHEN 2 THEN ['urls', 'select'] WHEN 3 THEN ['select'] "
    "WHEN 4 THEN ['key'] WHEN 5 THEN ['extract.type'] ELSE [] END) AS rule FROM part",
    "article_ids": f"WITH {HEAD} SELECT id, url FROM uniq",
    "article_log": f"WITH {HEAD} SELECT url AS key, '{{\"id\":\"' || id || '\",\"url\":' || {js('url')} || ',\"scrape_time\":\"2024-01-20T00:00:00.000000\",\"components\":' || components || '}}' AS value FROM ident",
    "file_key_last_wins": f"WITH {HEAD}, f AS (SELECT *, regexp_extract(url, '^(https?://[^/]*/[^/?#]*)', 1) AS cut FROM ident) "
    "SELECT host || replace(regexp_extract(cut, '^https?://[^/]*([^;]*)', 1), '/', '_') || '.json' AS file_key, cut || '?v=' || page_id AS url, id FROM f "
    "QUALIFY row_number() OVER (PARTITION BY 1 ORDER BY page_id DESC) = 1".replace(
        "PARTITION BY 1",
        "PARTITION BY host || replace(regexp_extract(cut, '^https?://[^/]*([^;]*)', 1), '/', '_')",
    ),
    "insert_if_absent": f"WITH {HEAD} SELECT id, url FROM uniq WHERE id NOT IN (SELECT id FROM ident WHERE page_id % 3 = 0)",
    "done_message": f"WITH {HEAD}, d AS (SELECT DISTINCT id FROM ident) {DONE}",
    "done_after_failures": f"WITH {HEAD}, d AS (SELECT DISTINCT id FROM uniq WHERE id NOT IN (SELECT id FROM ident WHERE page_id % 3 = 0)) {DONE}",
    "keyed_two_runs": f"WITH {HEAD} SELECT id, url FROM ident QUALIFY row_number() OVER (PARTITION BY id ORDER BY page_id % 3 <> 0, page_id) = 1",
    "seen_two_runs": "SELECT url, max(CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-01-23' ELSE TIMESTAMP '2024-01-22' END) AS expiration_date "
    "FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0 GROUP BY url",
    "seen_generations": "SELECT url, max(CASE WHEN page_id % 6 = 0 THEN TIMESTAMP '2024-02-23' WHEN page_id % 5 = 0 THEN TIMESTAMP '2024-02-22' "
    "WHEN page_id % 4 = 0 THEN TIMESTAMP '2024-02-21' WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-02-20' ELSE TIMESTAMP '2024-02-19' END) AS expiration_date "
    "FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0 OR page_id % 5 = 0 GROUP BY url",
    "per_domain_counts": f"WITH {HEAD} SELECT host AS domain, count(DISTINCT id) AS n_articles FROM ident GROUP BY host",
    "total_count": f"WITH {HEAD} SELECT count(DISTINCT id) AS n_articles FROM ident",
    "stream_headlines": f"WITH {HEAD} SELECT page_id, components FROM art",
    "crawl_articles": f"{ALL_LINKS} SELECT metadata, id, url, components FROM recs",
    "crawl_limited": CRAWL.replace("COND", f"{SEEN_DAY} <= 20").replace("CAP", "100")
    + " SELECT metadata, id, url, components FROM recs",
    "crawl_repeated_pages": f"{ALL_LINKS} SELECT metadata, id, url, components FROM recs",
    "crawl_two_specs": f"{ALL_LINKS} SELECT id, url FROM recs QUALIFY row_number() OVER (PARTITION BY id ORDER BY g, seed, pos) = 1",
    "stream_crawl": f"{ALL_LINKS} SELECT id, url FROM recs",
    "crawl_unique": f"{ALL_LINKS} SELECT id, url FROM recs QUALIFY row_number() OVER (PARTITION BY id ORDER BY g, seed, pos) = 1",
}
