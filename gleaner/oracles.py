"""DuckDB SQL for the registered queries: written from what each operator means, on the same tables."""

RUN = r"[\t \x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"
WORD = r"[\p{L}\p{N}_\x{2019}''\-]+"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
STAMP = "'2024-02-01T00:00:00+00:00'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{RUN}', ' ', 'g'))"


LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {squeeze('x')}), lambda x: x <> '')"
HASH = f"'sha256:' || sha256(lower(array_to_string({LINES}, chr(10))))"


def iso(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%d') || strftime({t}, 'T%H:%M:%S+00:00')"


TERMS = """list_sort(list_distinct(list_filter(list_transform({x}, lambda v: lower(trim(trim(v), ' ,;|/'))),
    lambda t: t <> '' AND length(t) <= 80 AND t NOT IN ('all', 'categories', 'home', 'more', 'stories', 'story', 'tags'))))"""

RECORDS = f"""WITH d AS (SELECT documents.*, quality, 'https://' || source || '.example.com/d/' || doc_id AS url, {LINES} AS p
    FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, array_to_string(p, chr(10) || chr(10)) AS body, len(regexp_extract_all(array_to_string(p, chr(10) || chr(10)), '{WORD}')) AS words,
    CASE WHEN lang <> 'fr' THEN {TERMS.format(x="[lang, 'Home', ' /' || source || '; ']")} ELSE [] END AS tags,
    CASE WHEN lang <> 'de' THEN string_split(text, chr(10))[1] END AS title,
    CASE WHEN quality = 1 THEN source END AS author, CASE WHEN quality = 1 THEN '2024-01-15' END AS published FROM d),
b AS (SELECT *, concat_ws(chr(10), '---', '### Source & Archival Attribution', 'Source URL: ' || url, 'Source site: Site ' || source || ' (' || source || '.example.com)',
    'Author/submitter: ' || coalesce(author, 'not listed on source page'), 'Author profile: not listed on source page',
    'Published: ' || coalesce(published, 'not listed on source page'), 'Categories: not listed',
    'Tags: ' || CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'not listed' END, 'License/terms: CC BY 4.0',
    'Archived at: 2024-02-01T00:00:00+00:00') AS block,
    list_sort(list_filter([CASE WHEN coalesce(title, '') = '' THEN 'missing_title' END, CASE WHEN author IS NULL THEN 'missing_author' END,
        CASE WHEN published IS NULL THEN CASE WHEN lang = 'es' THEN 'unparseable_date' ELSE 'missing_date' END END,
        CASE WHEN len(tags) = 0 THEN 'missing_tags' END, CASE WHEN quality IS NULL THEN 'missing_canonical' END,
        CASE WHEN body = '' THEN 'empty_body' WHEN words < 120 THEN 'short_body' END], lambda x: x IS NOT NULL)) AS flags FROM r)
"""

#: Terms of one word, counted among the words of a text.
CLASSES = [("english", "west", "one", ["the", "with", "worthless"]), ("german", "north", "two", ["der", "nicht", "und"]), ("french", "south", "three", ["le", "pour", "dans"])]


def _count(tokens: str, term: str) -> str:
    return f"len(list_filter({tokens}, lambda x: x = '{term}'))"


def _classes(body: str = "text") -> str:
    scores, labels = [], []
    for _, _, _, terms in CLASSES:
        scores.append(" + ".join(f"4 * least({_count('tt', t)}, 2) + least({_count('bt', t)}, 3)" for t in terms))
        labels.append(" || ".join(f"CASE WHEN list_contains(tt, '{t}') THEN ['title:{t}'] ELSE []::VARCHAR[] END || CASE WHEN list_contains(bt, '{t}') THEN ['body:{t}x' || least({_count('bt', t)}, 3)] ELSE []::VARCHAR[] END" for t in terms))
    return f"""WITH n AS (SELECT doc_id, regexp_split_to_array(lower(string_split(text, chr(10))[1]), '[^\\p{{L}}\\p{{N}}_]+') AS tt,
    regexp_split_to_array(lower({body}), '[^\\p{{L}}\\p{{N}}_]+') AS bt FROM documents),
s AS (SELECT doc_id, {', '.join(f'{x} AS s{i}' for i, x in enumerate(scores))}, {', '.join(f'{x} AS m{i}' for i, x in enumerate(labels))} FROM n)
"""


STORE = """WITH w AS (SELECT 'd' || doc_id AS dedup_key, source AS source_site, lang AS title, md5(text) AS content_hash, doc_id AS arrival FROM documents
    UNION ALL SELECT 'd' || doc_id, source, NULL, md5(text || '!'), doc_id + 1000000000000 FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
l AS (SELECT dedup_key, arg_max(row(source_site, title, content_hash), arrival) AS r, count(*) AS writes FROM w GROUP BY 1),
o AS (SELECT 'd' || doc_id AS dedup_key, doc_id + 1 AS id, md5(text) AS old_hash FROM documents JOIN labels USING (doc_id)),
f AS (SELECT dedup_key, writes, id, old_hash, documents.source AS source_site, CASE WHEN quality = 1 THEN NULL ELSE lang END AS title,
    md5(CASE WHEN quality = 1 THEN text || '!' ELSE text END) AS content_hash, md5(text) AS first_hash
    FROM l LEFT JOIN o USING (dedup_key) JOIN documents ON dedup_key = 'd' || documents.doc_id LEFT JOIN labels ON labels.doc_id = documents.doc_id)
"""

QUEUE = """WITH q AS (SELECT 'e' || event_id AS dedup_key, 'site' || (user_id % 5) AS source_site, event_type, event_id,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'done' ELSE 'pending' END AS state, (event_id % 4)::INT AS attempts,
    CASE WHEN event_type = 'error' THEN 'timeout' END AS last_error, strftime(ts, '%Y-%m-%d') || strftime(ts, 'T%H:%M:%S+00:00') AS discovered_at FROM events)
"""

#: Parameters of the pages' URLs, without what tracks.
URL = """WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages),
n AS (SELECT *, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS plain,
    list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|mc_|ref_|_ga|(ref|referrer|source|share|from)(=|$))'))) AS kept FROM u)
"""

DATES = "%Y-%m-%d|%Y/%m/%d|%-d %B %Y|Posted on %b %-d, %Y|%d-%m-%Y|%d/%m/%Y|%Y-%m-%dT%H:%M:%SZ|%A %-d %B %Y".split("|")

PENALTY = """WITH RECURSIVE e AS (SELECT user_id AS host, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (SELECT DISTINCT host, 0::BIGINT AS n, 0::DOUBLE AS p FROM e UNION ALL SELECT e.host, e.n,
    CASE t WHEN 'error' THEN least(60::DOUBLE, p + 5) WHEN 'view' THEN CASE WHEN p > 0 THEN greatest(0::DOUBLE, p * 0.6::DOUBLE - 0.25::DOUBLE) ELSE p END ELSE p END
    FROM f JOIN e ON e.host = f.host AND e.n = f.n + 1)
SELECT host, round(arg_max(p, n), 6) AS penalty FROM f GROUP BY host"""

_C = _classes("substr(text, 1, 4000)")
_BEST = "CASE WHEN s0 + s1 + s2 = 0 THEN 'general' WHEN s0 >= s1 AND s0 >= s2 THEN '{0}' WHEN s1 >= s2 THEN '{1}' ELSE '{2}' END"
_pick = lambda i: _BEST.format(*(c[i] for c in CLASSES))

SQL = {
    "text_paragraphs": f"SELECT doc_id, len({LINES})::INT AS n_paragraphs, array_to_string({LINES}, chr(10) || chr(10)) AS body FROM documents",
    "text_clean_inline": f"SELECT doc_id, nullif(trim(regexp_replace(text, '{RUN}', ' ', 'g'), ' ' || chr(10)), '') AS cleaned FROM documents",
    "text_word_count": f"SELECT lang, count(*) AS docs, sum(len(regexp_extract_all(text, '{WORD}')))::BIGINT AS words, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang",
    "text_content_hash": f"SELECT doc_id, {HASH} AS content_hash FROM documents",
    "dedup_exact": f"SELECT {HASH} AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "slug": """SELECT doc_id, coalesce(nullif(lower(trim(regexp_replace(regexp_replace(strip_accents(string_split(text, chr(10))[1]), '[^\\x00-\\x7f]', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '-')), ''), 'untitled') AS slug FROM documents""",
    "url_normalize": URL + "SELECT page_id, plain || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_norm, plain AS url_plain, host FROM n",
    "url_site_match": URL + "SELECT page_id, " + ", ".join(f"(host = 'example.{x}' OR ends_with(host, '.example.{x}')) AS in_{x}" for x in ("com", "net", "org")) + " FROM u",
    "date_parse": "WITH r AS (SELECT o_orderkey, o_orderdate AS t, CASE o_orderkey % 8 "
    + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(DATES))
    + " END AS raw FROM orders), p AS (SELECT o_orderkey, coalesce("
    + ", ".join(f"try_strptime(raw, '{f}')" for f in [DATES[6], *DATES[:6], DATES[7]])
    + f") AS t, o_orderkey % 8 = 6 AS zoned FROM r), i AS (SELECT o_orderkey, CASE WHEN zoned THEN ({iso('t')}) ELSE strftime(t, '%Y-%m-%d') END AS iso FROM p) "
    + "SELECT o_orderkey, iso, iso IS NOT NULL AS ok, substr(iso, 1, 4)::INT AS year FROM i",
    "date_relative": f"SELECT event_id, {iso('t')} AS iso FROM (SELECT event_id, {NOW} - to_seconds((user_id % 50 + 1) * CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 4 THEN 604800 WHEN 5 THEN 2592000 ELSE 31536000 END) AS t FROM events)",
    "terms_normalize": f"WITH t AS (SELECT doc_id, {TERMS.format(x='string_split_regex(text, chr(91) || chr(32) || chr(10) || chr(93))')} AS t FROM documents) SELECT doc_id, len(t)::INT AS n_terms, array_to_string(t, '|') AS terms FROM t",
    "record_flags": RECORDS + "SELECT url AS dedup_key, array_to_string(flags, ',') AS flags, NOT list_has_any(flags, ['empty_body', 'missing_title', 'missing_canonical']) AS is_complete, CASE WHEN published IS NOT NULL THEN 2024 END::INT AS published_year FROM b",
    "record_measures": RECORDS + f"SELECT url AS dedup_key, len(p)::INT AS paragraph_count, words::INT AS word_count, length(body)::INT AS char_count, {HASH} AS content_hash, array_to_string(tags, ',') AS tags, {STAMP} AS fetched_at FROM b",
    "record_attribution": RECORDS + "SELECT url AS dedup_key, block AS attribution_block FROM b",
    "attribution_strip": RECORDS + "SELECT url AS dedup_key, CASE WHEN body = '' THEN block ELSE rtrim(body, ' ' || chr(10) || chr(9) || chr(160)) END AS body FROM b",
    "classify_best": _C
    + f"SELECT doc_id, {_pick(0)} AS primary_niche, {_pick(1)} AS target_funnel, {_pick(2)} AS recommended_affiliate, "
    + "CASE WHEN s0 + s1 + s2 = 0 THEN 0::DOUBLE ELSE round(list_sort([s0, s1, s2], 'DESC')[1] / (list_sort([s0, s1, s2], 'DESC')[1] + list_sort([s0, s1, s2], 'DESC')[2] + 1e-6::DOUBLE), 4) END AS confidence, "
    + "array_to_string(CASE WHEN s0 + s1 + s2 = 0 THEN [] WHEN s0 >= s1 AND s0 >= s2 THEN m0 WHEN s1 >= s2 THEN m1 ELSE m2 END, ',') AS matched FROM s",
    "classify_scores": _classes() + " UNION ALL ".join(f"SELECT doc_id, '{c[0]}' AS niche, s{i}::INT AS score FROM s WHERE s{i} > 0" for i, c in enumerate(CLASSES)),
    "store_upsert": STORE
    + f""", k AS (SELECT *, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY dedup_key) AS new_id FROM f WHERE id IS NULL),
a AS (SELECT dedup_key, source_site, title, content_hash, id, '2024-01-01T00:00:00+00:00' AS first_seen_at, {STAMP} AS updated_at, (writes + 1)::INT AS revision, 'unchanged' AS outcome, content_hash <> old_hash AS content_changed FROM f WHERE id IS NOT NULL
    UNION ALL SELECT dedup_key, source_site, title, content_hash, new_id, {STAMP}, {STAMP}, writes::INT, CASE WHEN writes = 1 THEN 'inserted' ELSE 'unchanged' END, content_hash <> first_hash FROM k)
SELECT * FROM a""",
    "store_exists": "SELECT 'd' || doc_id AS dedup_key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "store_scan": "SELECT doc_id + 1 AS id, 'd' || doc_id AS dedup_key, CASE WHEN lang = 'en' THEN 'a,b' ELSE '' END AS flags FROM documents JOIN labels USING (doc_id) WHERE source = 'src3'",
    "store_enqueue": URL
    + f""", k AS (SELECT plain || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS dedup_key, url FROM n JOIN pages USING (page_id)),
a AS (SELECT dedup_key, min(url) FILTER (url LIKE '%?%') AS old, min(url) AS new FROM k GROUP BY 1)
SELECT dedup_key, coalesce(old, new) AS url, 'pending' AS state, 0 AS attempts, CASE WHEN old IS NULL THEN {STAMP} ELSE '2024-01-01T00:00:00+00:00' END AS discovered_at FROM a""",
    "store_mark": QUEUE
    + f"""SELECT dedup_key, CASE event_type WHEN 'click' THEN 'done' ELSE state END AS state, (attempts + (event_type = 'error')::INT)::INT AS attempts,
CASE WHEN event_type = 'error' THEN 'again' END AS last_error, CASE WHEN event_type IN ('click', 'error') THEN {STAMP} ELSE discovered_at END AS updated_at FROM q""",
    "queue_pending": QUEUE + "SELECT dedup_key, state, attempts, discovered_at FROM q WHERE state <> 'done' AND attempts < 3 AND source_site = 'site2' ORDER BY discovered_at, dedup_key LIMIT 50",
    "tag_bridge": RECORDS + ", t AS (SELECT doc_id AS story_id, unnest(tags) AS name FROM b), g AS (SELECT name, row_number() OVER (ORDER BY name) AS tag_id FROM (SELECT DISTINCT name FROM t)) SELECT DISTINCT story_id, tag_id, name, 'tag' AS kind FROM t JOIN g USING (name)",
    "run_log": f"""WITH r AS (SELECT DISTINCT event_type AS kind, 'site' || (user_id % 5) AS source_site FROM events)
SELECT row_number() OVER (ORDER BY kind, source_site) AS id, kind, source_site, '2024-01-01T00:00:00+00:00' AS started_at, CASE WHEN kind <> 'view' THEN {STAMP} END AS finished_at,
CASE WHEN kind <> 'view' THEN kind <> 'error' END AS ok, CASE WHEN kind <> 'view' THEN '{{"n": 1}}' END AS stats, CASE WHEN kind = 'error' THEN 'x' END AS error FROM r""",
    "html_links": """WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) AS n FROM pages),
h AS (SELECT page_id, url, n, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS text FROM a)
SELECT page_id, (n - 1)::INT AS pos, href, text, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || href AS target FROM h""",
    "discover_bfs": """WITH n AS (SELECT page_id AS i FROM pages WHERE page_id < 100),
l AS (SELECT i, 'https://site.example.org/list/' || i AS listing_url, floor(log2(i + 1))::INT AS depth FROM n),
s AS (SELECT i, listing_url, depth, 'https://site.example.org/story/' || i AS url, 'Story ' || i AS hint_title FROM l
    UNION ALL SELECT min(i), arg_min(listing_url, i), min(depth), 'https://site.example.org/story/s' || (i % 7), 'Shared ' || (i % 7) FROM l GROUP BY i % 7)
SELECT url, listing_url, hint_title, depth FROM s""",
    "robots_allowed": """WITH p AS (SELECT page_id, url LIKE '%.example.com/%' AS ruled, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN NOT ruled THEN true WHEN path LIKE '/en/2%' THEN false WHEN path LIKE '/en%' THEN true WHEN path LIKE '/fr%' THEN false ELSE true END AS allowed, CASE WHEN ruled THEN 3::DOUBLE END AS crawl_delay FROM p""",
    "pace_schedule": """WITH e AS (SELECT event_id, user_id AS host, floor(epoch(ts) / 600)::DOUBLE AS a FROM events),
r AS (SELECT *, 2::DOUBLE * row_number() OVER (PARTITION BY host ORDER BY a, event_id) AS n FROM e),
s AS (SELECT event_id, a, n + max(a - n) OVER (PARTITION BY host ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS sent FROM r)
SELECT event_id, round(sent, 6) AS sent, round(sent - a, 6) AS delay FROM s""",
    "pace_penalty": PENALTY,
    "stream_penalty": PENALTY,
    "metric_counter": "SELECT event_type, user_id, count(*) AS value FROM events GROUP BY ALL",
    "metric_gauge": "SELECT event_type, arg_max(value, ts) AS value FROM events GROUP BY 1",
    "metric_histogram": """WITH b AS (SELECT le::DOUBLE AS b, le FROM (SELECT unnest(string_split('0.5 1 2 5 10 30 60 120 300', ' ')) AS le) UNION ALL SELECT 1e300, '+Inf')
SELECT event_type, le, count(*) FILTER (value <= b) AS count, count(*) AS total_count, sum(round(value * 100)::BIGINT)::BIGINT AS total_cents FROM events, b GROUP BY event_type, le""",
    "fetch_outcomes": "WITH e AS (SELECT event_id, event_id % 300 + 250 AS s FROM events) SELECT event_id, s >= 400 AS failed, s IN (408, 425, 429) OR s >= 500 AS retryable, s = 429 OR s >= 500 AS penalized FROM e",
    "log_lines": """SELECT event_id, '{"level":"INFO","message":"' || event_type || '","user":' || user_id || '}' AS line FROM events""",
    "export_jsonl": RECORDS + "SELECT url AS dedup_key, title, array_to_string(tags, ',') AS tags, array_to_string(flags, ',') AS flags, words::INT AS word_count FROM b",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_upsert": f"SELECT source || '/' || lang AS dedup_key, source AS source_site, lang AS title, arg_max(md5(text), doc_id) AS content_hash, count(*)::INT AS revision, {STAMP} AS first_seen_at FROM documents GROUP BY source, lang",
}


SQL["health_by_site"] = """WITH p AS (SELECT page_id, url, html, page_id % 10 = 0 AS broken, CASE WHEN page_id % 10 = 1 THEN 503 ELSE 200 END AS status FROM pages)
SELECT url AS site, CASE WHEN broken OR status >= 400 THEN 'FAIL' ELSE 'PASS' END AS status, url, CASE WHEN NOT broken THEN status END AS http_status,
    CASE WHEN NOT broken AND status < 400 THEN length(html)::INT END AS html_chars,
    CASE WHEN NOT broken AND status < 400 THEN len(list_filter(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda x: regexp_matches(x, '^/[a-z]+$')))::INT END AS story_links_found,
    CASE WHEN broken THEN 'timeout' END AS reason FROM p
UNION ALL SELECT 'absent', 'FAIL', NULL, NULL, NULL, NULL, 'Adapter absent not registered'"""

SQL["stream_queue"] = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS dedup_key, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (SELECT dedup_key, min(n) AS first FROM e WHERE t NOT IN ('error', 'view') GROUP BY 1),
m AS (SELECT dedup_key, arg_max(t, n) AS t, count(*) FILTER (t = 'error') AS bumps FROM e JOIN f USING (dedup_key) WHERE n > first AND t IN ('error', 'view') GROUP BY 1)
SELECT dedup_key, CASE m.t WHEN 'error' THEN 'failed' WHEN 'view' THEN 'done' ELSE 'pending' END AS state, coalesce(bumps, 0)::INT AS attempts, CASE WHEN m.t = 'error' THEN 'again' END AS last_error
FROM f LEFT JOIN m USING (dedup_key)"""

SQL["fetch_log"] = """WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, page_id % 5 AS k, (page_id % 20)::DOUBLE AS asked FROM pages),
a AS (SELECT *, NOT (ends_with(host, '.com') AND starts_with(path, '/de')) AS ok FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY asked, page_id) AS n FROM a WHERE ok),
s AS (SELECT page_id, max(asked - n * 2) OVER (PARTITION BY host ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 2 AS sent FROM o)
SELECT page_id AS request_id, ok AS allowed, round(sent, 6) AS sent, (CASE WHEN NOT ok THEN 0 WHEN k IN (2, 3) THEN 3 WHEN k = 1 THEN 2 ELSE 1 END)::INT AS attempts,
    CASE WHEN ok AND k <> 3 THEN CASE WHEN k = 2 THEN 404 ELSE 200 END END AS status, CASE WHEN ok AND k NOT IN (2, 3) THEN true END AS came,
    CASE WHEN NOT ok THEN 'robots' WHEN k = 3 THEN 'no answer' WHEN k = 2 THEN 'status' END AS reason, CASE WHEN NOT ok THEN false WHEN k = 3 THEN true WHEN k = 2 THEN false END AS retryable
FROM a LEFT JOIN s USING (page_id)"""

SQL["tag_replace"] = """WITH g AS (SELECT doc_id, bool_or(quality = 1) AS good FROM labels GROUP BY 1), d AS (SELECT documents.*, coalesce(good, false) AS good FROM documents LEFT JOIN g USING (doc_id))
SELECT doc_id AS story_id, lang AS name, 'tag' AS kind FROM d UNION ALL SELECT doc_id, CASE WHEN good THEN 'good' ELSE source END, 'tag' FROM d UNION ALL SELECT doc_id, lang, 'category' FROM d WHERE NOT good"""
