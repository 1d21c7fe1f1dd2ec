"""Edge cases that no test table holds, by values worked out by hand or by plain Python."""

import json
import unicodedata
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner import logs, registry
from gleaner.functions import dates, urls
from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.operators import classify, discover, metrics, pacing, records, robots, store
from gleaner.plans.pages import Site, probe, records_of, site_links
from gleaner.sources import io, shared
from gleaner.streaming import streams


def now():
    return F.lit("2026-08-20 12:00:00").cast("timestamp")


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_paragraphs(spark):
    texts = ["a\r\nb\rc", "x  　 y\n\n\n z ", "one\n \ntwo", "", None, "é"]
    got = one(spark, texts, lambda c: T.normalize_paragraphs(c, nfc=True))
    assert got == [["a\nb\nc"], ["x y", "z"], ["one\ntwo"], [], None, ["é"]]


def test_inline_words_hash(spark):
    assert one(spark, ["  a\t b ", "  ", None, "ﬁ"], lambda c: T.clean_inline(c, nfc=True)) == ["a b", None, None, "ﬁ"]
    assert one(spark, ["don’t stop-it - x_1", "", "é ü"], T.word_count) == [4, 0, 2]
    a, b = one(spark, [["A  b", " c "], ["a b", "c"]], T.content_hash, "array<string>")
    assert a == b and a.startswith("sha256:")


def test_slug_and_terms(spark):
    assert one(spark, ["Crème brûlée!", "ﬁne", "漢字", ""], T.slugify) == ["creme-brulee", "fine", "untitled", "untitled"]
    values = [["  Foo  Bar ", "foo bar", "Home", None, "", ", x /", "y" * 81], None, []]
    assert one(spark, values, T.normalize_terms, "array<string>") == [["foo bar", "x"], [], []]


@pytest.mark.parametrize("keep", [None, {"id", "utm_x"}])
def test_urls(spark, keep):
    def plain(url):
        p = urlsplit(url.strip())
        host = (p.hostname or "").lower()
        if p.port and (p.scheme, p.port) not in (("http", 80), ("https", 443)):
            host += f":{p.port}"
        bad = tuple(urls.TRACKING_PREFIXES)
        q = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if (keep is None or k.lower() in keep) and k.lower() not in urls.TRACKING and not k.lower().startswith(bad)]
        return urlunsplit(((p.scheme or "https").lower(), host, p.path or "/", urlencode(sorted(q)), ""))

    given_urls = [
        "HTTP://User:pw@Example.COM:80/A/b/?b=2&a=1&utm_source=x#f", "https://example.com", "https://example.com:8443/x?id=&ID=3", "https://[2001:DB8::1]:443/p",
        " https://e.org/a%20b?q=a+b%26c&q=*~ ", "https://e.org/x?ref=1&Ref=2&referrers=3", "https://e.org/?a=1&a=1&utm_x=3&id=7",
    ]
    assert one(spark, given_urls, lambda c: urls.normalize_url(c, keep_params=keep)) == [plain(u) for u in given_urls]
    named = [plain(u) for u in given_urls if "[" not in u]  # a literal address loses its brackets, and is no URL then
    assert one(spark, named, lambda c: urls.normalize_url(c, keep_params=keep)) == named
    assert one(spark, ["https://2001:db8::1/p"], urls.normalize_url) == [None]
    assert one(spark, ["https://e.org:99999/", "https://e.org:x/", None], urls.normalize_url) == [None, None, None]


def test_hosts_and_references(spark):
    assert one(spark, ["https://A.example.com:8/x", "nothing", "//h/p"], urls.host_of) == ["a.example.com", "", "h"]
    assert one(spark, ["https://a.x.com/", "https://notx.com/", "https://x.com"], lambda c: urls.registrable_match(c, "x.com")) == [True, False, True]
    refs = ["/r", "rel", "?q=1", "//cdn.org/z", "http://o.org/", "../up", "#x", "javascript:1", " mailto:a"]
    df = spark.createDataFrame([(i, "https://h.org/a/b/c?z", r) for i, r in enumerate(refs)], "i int, b string, r string")
    both = F.coalesce(urls.absolute(F.col("b"), F.col("r")), urls.joined("b", "r"))
    got = [r[0] for r in df.where(urls.followable(F.col("r"))).orderBy("i").select(both).collect()]
    assert got == ["https://h.org/r", "https://h.org/a/b/rel", "https://h.org/a/b/c?q=1", "https://cdn.org/z", "http://o.org/", "https://h.org/a/up"]


DATES = {
    "2026-08-19": "2026-08-19",
    "2026-08-19T10:11:12Z": "2026-08-19T10:11:12+00:00",
    "2026-08-19T10:11:12+02:00": "2026-08-19T08:11:12+00:00",
    "20260819": "2026-08-19",
    "2026-08-19 00:00:00": "2026-08-19",
    "2026-08-19 10:11": "2026-08-19T10:11:00+00:00",
    "2026/8/9": "2026-08-09",
    "Posted on August 19th, 2026": "2026-08-19",
    "19 Aug 2026": "2026-08-19",
    "1st of May 2026": "2026-05-01",
    "19 August 2026 14:05": "2026-08-19T14:05:00+00:00",
    "Wednesday 19 August 2026": "2026-08-19",
    "Wed, 19 August 2026": "2026-08-19",
    "01/02/2026": "2026-02-01",
    "12/25/2026": "2026-12-25",
    "19-08-2026": "2026-08-19",
    "3 days ago": "2026-08-17T12:00:00+00:00",
    "added 1 month ago": "2026-07-21T12:00:00+00:00",
    "seen 2026-08-19 somewhere": "2026-08-19",
    "30 February 2026": None,
    "an hour ago": None,
    "soon": None,
    "": None,
    None: None,
}


def test_dates(spark):
    got = one(spark, list(DATES), lambda c: dates.parse_date(c, now()))
    assert {k: r["iso"] for k, r in zip(DATES, got)} == DATES
    assert all(r["ok"] == (r["iso"] is not None) for r in got)
    assert one(spark, ["2026-01-01", "x", None, "12"], dates.year_of) == [2026, None, None, None]


def test_html_prose():
    page = """<html><head><title>T &amp; U</title><link rel="canonical" href="/c"></head><body><nav>menu</nav><div class="big ad">buy</div>
    <div id="top-banner">b</div><p>One <b>bold<p>Two<br>lines<hr><ul><li>x<li>y</ul><table><tr><td>c<td>d</table><script>var t="</p>";</script><!-- c --></body></html>"""
    r = H.parse(page)
    assert r["title"] == "T & U" and r["canonical"] == "/c" and r["fallback"] and r["container"] is None
    assert r["paragraphs"][-7:] == ["One bold", "Two\nlines", "* * *", "x", "y", "cd"][-7:] or r["paragraphs"] == ["T & U", "One bold", "Two\nlines", "* * *", "x", "y", "cd"]
    assert H.parse(None) is None and H.parse("")["paragraphs"] == [] and H.parse("")["density"] == 1.0
    assert H.parse("<div>" * 5000 + "deep")["paragraphs"] == ["deep"]


def test_html_container():
    body = "<p>" + "word " * 120 + "</p>"
    page = f"<div id=w><article id=a>{body}</article></div><div id=l><a href='/x'>{'link ' * 200}</a></div><section>{body}</section>"
    best = H.parse(page)["container"]
    assert best["tag"] == "article"  # the wrapper's child has all of its text; links are too dense; ties go to the first
    assert best["density"] == 0.0 and best["breaks"] == 1 and best["chars"] == 599


def parsed(spark, **fields):
    base = {"source_url": "https://x.org/1", "dedup_key": "k", "title": None, "body_paragraphs": None}
    row = base | fields
    kinds = {"title": "string", "source_url": "string", "dedup_key": "string", "body_paragraphs": "array<string>", "tags": "array<string>", "flags": "array<string>"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))


def record(df):
    return records.build_records(df, "x", "X", "x.org", "lic", "1", now()).collect()[0]


def test_records(spark):
    r = record(parsed(spark))
    assert r.flags == ["empty_body", "missing_author", "missing_canonical", "missing_date", "missing_tags", "missing_title"]
    assert not r.is_complete and r.body_with_attribution == r.attribution_block and r.word_count == 0
    full = parsed(spark, title="t", canonical_url="https://x.org/c", author_name="a", published_at="2026-01-02", tags=["B", "a", "a "], body_paragraphs=["p one", " ", "q"], flags=["zz", "zz"])
    r = record(full)
    assert r.flags == ["short_body", "zz", "zz"] and r.is_complete and r.tags == ["a", "b"] and r.body_text == "p one\n\nq" and r.published_year == 2026
    assert "Source URL: https://x.org/c\n" in r.attribution_block and "Categories: not listed\n" in r.attribution_block
    stripped = spark.createDataFrame([(r.body_with_attribution,), ("plain ",), (r.attribution_block,)], "v string").select(T.strip_attribution(F.col("v"))).collect()
    assert [x[0] for x in stripped] == ["p one\n\nq", "plain ", r.attribution_block]
    r = record(parsed(spark, title="", published_at_raw="??"))
    assert "unparseable_date" in r.flags and "missing_title" in r.flags
    assert one(spark, [["a"], ["b"]], lambda c: records.add_flag(c, "a"), "array<string>") == [["a"], ["b", "a"]]


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "title string, tags array<string>, body_text string").withColumns({"categories": F.array().cast("array<string>"), "source_keywords": F.array().cast("array<string>")})


def test_classify(spark):
    tax = classify.Taxonomy.of({"categories": [{"primary_niche": n, "target_funnel": f"f{n}", "recommended_affiliate": f"r{n}", "keywords": k} for n, k in (("sea", ["Boat", "deep sea"]), ("sky", ["cloud"]))]}, ("none_of", "x", "y"))
    rows = docs(spark, ("Boat boat boat", ["the deep-sea", "boat", "boat"], "cloud " * 100), ("Nothing", [], "boats"), (None, None, None), ("a", [], "boat cloud"), ("Straße", ["deep sea"], ""))
    got = classify.classified(rows, tax).select(*classify.RESULT).collect()
    assert [r.primary_niche for r in got] == ["sea", "none_of", "none_of", "sea", "sea"]
    assert got[0].scores == {"sea": 6 + 8, "sky": 3} and got[0].matched_terms == ["tag:Boat", "title:Boat"]
    assert got[0].confidence == round(14 / (17 + 1e-6), 4) and got[0].seo_slug == "boat-boat-boat-boat"
    assert got[1].confidence == 0.0 and got[1].seo_slug == "nothing-none_of" and got[2].seo_slug == "story-none_of"
    assert got[3].scores == {"sea": 1, "sky": 1} and got[3].confidence == 0.5
    assert got[4].matched_terms == ["tag:deep sea"] and got[4].seo_slug == "strae-deep-sea"


def test_classify_repeated_niche(spark):
    def of(*cats):
        return classify.Taxonomy.of({"categories": [{"primary_niche": n, "target_funnel": f"f{i}", "recommended_affiliate": "r", "keywords": k} for i, (n, k) in enumerate(cats)]})

    rows = spark.createDataFrame([("boat cloud rain",)], "title string").selectExpr("title", "array('') as tags", "cast(null as array<string>) as categories", "array('') as source_keywords", "cast(null as string) as body_text")
    # equal scores: the niche keeps the place of its first category that scored; matches are the last one's, the slug term the first one's
    r = classify.classified(rows, of(("a", ["boat"]), ("b", ["cloud"]), ("a", ["rain"]))).head()
    assert (r.primary_niche, r.target_funnel, r.matched_terms, r.seo_slug) == ("a", "f0", ["title:rain"], "boat-cloud-rain-boat")
    # a first category that doesn't score holds no place
    r = classify.classified(rows, of(("a", ["none"]), ("b", ["cloud"]), ("a", ["rain"]))).head()
    assert r.primary_niche == "b" and r.scores == {"a": 4, "b": 4}


def test_store(spark):
    cols = "dedup_key string, source_url string, title string, content_hash string"
    empty = store.empty(spark, cols + ", id bigint, first_seen_at string, updated_at string, revision int")
    batch = spark.createDataFrame([("a", "u1", "A", "h1", 0), ("b", "u2", "B", "h2", 1)], cols + ", n int")
    t0, t1 = F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-02").cast("timestamp")
    m = store.with_ids(store.merged(empty, batch, "n", t0))
    first = {r.dedup_key: r for r in m.collect()}
    assert (first["a"].id, first["b"].id) == (1, 2) and first["a"].outcome == "inserted"
    base = m.drop("outcome", "content_changed")
    again = spark.createDataFrame([("a", "u1", None, "h9", 0), ("c", "u2", "C", "h3", 1), ("c", "u2", "D", "h4", 2)], cols + ", n int")
    r = {x.dedup_key: x for x in store.with_ids(store.merged(base, again, "n", t1)).collect()}
    assert (r["a"].id, r["a"].revision, r["a"].title, r["a"].outcome, r["a"].content_changed) == (1, 2, None, "unchanged", True)
    assert r["a"].first_seen_at.startswith("2026-01-01") and r["a"].updated_at.startswith("2026-01-02")
    assert r["b"].outcome is None and (r["c"].id, r["c"].revision, r["c"].title) == (3, 2, "D")
    clash = store.source_url_clashes(store.merged(base, again, "n", t1)).collect()
    assert sorted(x.dedup_key for x in clash) == ["b", "c"]


def test_tags_replace(spark):
    tag = spark.createDataFrame([(1, "old", "tag"), (2, "kept", "category")], "id bigint, name string, kind string")
    bridge = spark.createDataFrame([(10, 1), (11, 1), (10, 2)], "story_id bigint, tag_id bigint")
    r = spark.createDataFrame([(10, ["new"], [])], "id bigint, tags array<string>, categories array<string>")
    dim, links = store.sync_tags(tag, bridge, r)
    assert sorted((x.id, x.name) for x in dim.collect()) == [(1, "old"), (2, "kept"), (3, "new")]
    assert sorted(tuple(x) for x in links.collect()) == [(10, 3), (11, 1)]


def test_queue(spark):
    q = store.empty(spark, store.QUEUE)
    found = spark.createDataFrame([("s", "u2", "k", None, None), ("s", "u1", "k", None, "t"), ("s", "u3", "l", None, None)], "source_site string, url string, dedup_key string, listing_url string, hint_title string")
    q = store.enqueue(q, found, now())
    assert sorted((r.dedup_key, r.url, r.state) for r in q.collect()) == [("k", "u1", "pending"), ("l", "u3", "pending")]
    ups = spark.createDataFrame([("k", "failed", "e", True, 0), ("k", "failed", None, True, 1), ("zz", "done", None, False, 0)], "dedup_key string, state string, error string, bump boolean, o int")
    q = store.mark(q, ups, now(), "o")
    r = {x.dedup_key: x for x in q.collect()}
    assert (r["k"].state, r["k"].attempts, r["k"].last_error) == ("failed", 2, None) and len(r) == 2
    assert [x.dedup_key for x in store.pending(q).collect()] == ["l"]
    assert [x.dedup_key for x in store.pending(q, limit=0, include_failed=True).collect()] == ["k", "l"]
    assert store.pending(q, include_failed=True, max_attempts=2).count() == 1 and store.pending(q, site="other").count() == 0


def graph(spark, links):
    html = lambda out: "".join(f'<a href="{u}"> {u} </a>' for u in out)
    return spark.createDataFrame([(f"https://s.org{u}", html(v)) for u, v in links.items()], "url string, html string")


def plain_bfs(links, start, max_pages, max_depth):
    queue, seen, out, n = [(start, 0)], set(), {}, 0
    while queue and n < max_pages:
        u, depth = queue.pop(0)
        if u in seen:
            continue
        seen.add(u)
        n += 1
        for v in links.get(u, []):
            if v.startswith("/story"):
                out.setdefault(v, u)
            elif v.startswith("/list") and depth < max_depth and v not in seen:
                queue.append((v, depth + 1))
    return {(f"https://s.org{v}", f"https://s.org{u}") for v, u in out.items()}


@pytest.mark.parametrize(("pages", "depth"), [(100, 3), (3, 3), (100, 1), (1, 0), (5, 9)])
def test_discover(spark, pages, depth):
    links = {
        "/list/a": ["/list/b", "/list/gone", "/story/1", "/list/c", "/story/1"],
        "/list/b": ["/list/a", "/list/d", "/story/2", "/other"],
        "/list/c": ["/list/d", "/story/2", "/story/3"],
        "/list/d": ["/list/e", "/story/4", "/list/b"],
        "/list/e": ["/story/5"],
    }
    e = discover.edges(graph(spark, links), "s.org", "/story", ["/list"])
    got = discover.discover(e, ["https://s.org/list/a"], pages, depth).collect()
    assert {(r.url, r.listing_url) for r in got} == plain_bfs(links, "/list/a", pages, depth)


def test_health(spark):
    checks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "site string")
    reg = spark.createDataFrame([("a", "ua", "^/s"), ("b", "ub", None), ("c", "uc", "x")], "site string, start_url string, story_re string")
    pages = spark.createDataFrame([("ua", None, '<a href="/s1">1</a><a href="/t">', None), ("ub", 404, "", None), ("uc", None, None, "boom")], "url string, status int, html string, error string")
    r = {x.site: x for x in discover.health(checks, reg, pages).collect()}
    assert (r["a"].status, r["a"].http_status, r["a"].story_links_found, r["a"].html_chars) == ("PASS", 200, 1, 32)
    assert (r["b"].status, r["b"].http_status) == ("FAIL", 404)
    assert r["c"].reason == "boom" and r["d"].reason == "Adapter d not registered"


def test_robots(spark):
    files = spark.createDataFrame([("https://a.org", "User-agent: *\nCrawl-delay: 2\nAllow: /p/ok\nDisallow: /p\nDisallow: /q%20r\nDisallow:"), ("https://b.org", None)], "origin string, body string")
    u = ["https://a.org/p/ok", "https://a.org/p/x", "https://a.org/q%20r/1", "https://a.org", "https://b.org/p", "https://c.org/p"]
    df = robots.allowed(spark.createDataFrame([(x,) for x in u], "url string"), robots.rule_table(files))
    got = {r.url: (r.allowed, r.crawl_delay) for r in df.collect()}
    assert [got[x][0] for x in u] == [True, False, False, True, True, True]
    assert got[u[0]][1] == 2.0 and got[u[4]][1] is None
    assert all(r.allowed for r in robots.allowed(df.select("url"), robots.rule_table(files), enabled=False).collect())


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["penalize", "relax", "none"])), min_size=1, max_size=40))
def test_pacing(spark, steps):
    df = spark.createDataFrame([(f"h{h}", i, o) for i, (h, o) in enumerate(steps)], "host string, i int, o string").withColumn("t", F.timestamp_seconds(F.col("i") * 20000))
    want = {}
    for h, o in steps:
        p = want.get(f"h{h}", 0.0)
        want[f"h{h}"] = min(60.0, p + 25) if o == "penalize" else max(0.0, p * 0.6 - 0.25) if o == "relax" and p > 0 else p
    got = {r.host: r.penalty for r in pacing.penalties(df, "host", "t", "o", 25.0).collect()}
    assert got == pytest.approx(want)
    s = pacing.schedule(df.withColumn("asked", F.col("i") * 0.7), "host", "asked").orderBy("host", "i").collect()
    last = {}
    for r in s:
        due = max(r.asked, last.get(r.host, -1e9) + 2.0)
        assert r.sent == pytest.approx(due)
        last[r.host] = r.sent


def test_metrics_and_logs(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 3.0), ("a", None), ("b", 500.0)], "site string, v double")
    h = {(r.site, r.le): r["count"] for r in metrics.histogram(df, ["site"], "v", metrics.DURATIONS).collect()}
    assert h["a", "0.5"] == 1 and h["a", "5"] == 2 and h["a", "+Inf"] == 2 and h["b", "300"] == 0 and h["b", "+Inf"] == 1
    log = spark.createDataFrame([("INFO", "m", None)], "level string, message string, site string")
    assert log.select(metrics.log_json(log, ["site"])).collect()[0][0] == '{"level":"INFO","message":"m"}'
    m = spark.sql("SELECT map('a', 1, 'b', CAST(NULL AS INT)) AS x, map('c', 2) AS y").select(records.without_nulls(F.col("x"), F.col("y"))).collect()[0][0]
    assert m == {"a": 1, "c": 2}


def test_fetch_rules(spark):
    got = one(spark, [200, 404, 408, 429, 500, None], discover.fetch_outcome, "int")
    assert [tuple(r) for r in got] == [(False, False, False), (True, False, False), (True, True, False), (True, True, True), (True, True, True), (False, False, False)]
    kinds = spark.createDataFrame([("image",), ("document",), ("font",)], "resource_type string")
    assert [r[0] for r in discover.keep_resources(kinds).collect()] == ["document"]
    assert one(spark, [["b", "a"], ["z"]], lambda c: discover.first_visible(c, ["a", "b"]), "array<string>") == ["a", None]


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("k", ["x", "ü"], None)], "dedup_key string, tags array<string>, title string")
    io.write_jsonl(r, str(tmp_path / "j"))
    assert spark.read.schema(r.schema).json(str(tmp_path / "j")).collect() == r.collect()
    io.write_csv(r, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()[0].tags == '["x","ü"]'


def test_taxonomy_file(tmp_path, spark):
    p = tmp_path / "t.json"
    p.write_text('{"weights": {"title": "9"}, "categories": [{"primary_niche": "n", "target_funnel": "f", "recommended_affiliate": "a"}]}')
    t = classify.load_taxonomy(str(p))
    assert t.weights["title"] == 9 and t.weights["body"] == 1 and t.categories[0].keywords == ()
    assert classify.load_taxonomy(str(tmp_path / "none")) is classify.DEFAULT
    assert classify.taxonomy_table(spark, classify.DEFAULT).count() == 12


def test_stream_store_replays(spark, tmp_path):
    empty = store.empty(spark, "dedup_key string, title string, id bigint, first_seen_at string, updated_at string, revision int")
    s = streams.Store(spark, f"file://{tmp_path}/s", empty, "n", lambda i: F.timestamp_seconds(F.lit(i)))
    batch = spark.createDataFrame([("a", "x", 0)], "dedup_key string, title string, n int")
    s.write(batch, 0)
    s.write(batch, 1)
    s.write(batch, 1)
    r = s.current().collect()
    assert len(r) == 1 and r[0].revision == 2 and s.versions() == [0, 1]


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=60))
def test_html_never_fails(text):
    r = H.parse(f"<div><p>{text}<a href={text}>")
    assert all(unicodedata.normalize("NFC", p) == p and p.strip() for p in r["paragraphs"])


def test_probe(spark, tmp_path):
    site = Site("x", "X", "https://x.org/", "x.org", "/story/")
    html = "<title>The boat</title><article>" + "<p>Some words about it.</p>" * 30 + "</article>"
    pages = spark.createDataFrame([("https://x.org/story/1?utm_a=b", html)], "url string, html string")
    r = probe(pages, site, "https://x.org/story/1?utm_a=b", now(), save_html=str(tmp_path / "p"))
    assert r["dedup_key"] == r["canonical_url"] == "https://x.org/story/1" and r["title"] == "The boat" and r["paragraph_count"] == 30
    assert r["flags"] == ["missing_author", "missing_date", "missing_tags"] and r["word_count"] == 120 and r["is_complete"]
    assert r["primary_niche"] == "general" and "classification_confidence" not in r
    assert probe(pages, site, "https://x.org/none", now()) is None
    assert spark.read.parquet(str(tmp_path / "p")).head().html == html
    assert [bool(x) for x in one(spark, ["https://x.org/story/1", "https://x.org/l"], site.is_story)] == [True, False]


def test_logs(tmp_path, capsys):
    path = tmp_path / "a" / "log"
    logs.setup("INFO", str(path), as_json=True)
    log = logs.Bound("gleaner.x", site="s", gone=1).bind(gone=None)
    with log.timer("done", n=2):
        pass
    said = json.loads(path.read_text().splitlines()[-1])
    assert (said["message"], said["site"], said["n"], said["level"]) == ("done", "s", 2, "INFO") and "gone" not in said and said["duration"] >= 0
    logs.setup("WARNING", as_json=False)


def test_store_rules(spark, tmp_path):
    path = str(tmp_path / "store")
    tables = store.open_store(spark, path)
    assert set(tables) == {"stories", "tag", "story_tag", "queue", "runs"} and len(tables["stories"].columns) == 41 and tables["stories"].count() == 0
    assert store.open_store(spark, path)["queue"].columns == tables["queue"].columns
    text = {c: "x" for c in "source_site source_site_name body_text body_with_attribution attribution_block content_hash first_seen_at updated_at fetched_at".split()}
    rows = [{"id": i, "dedup_key": k, "source_url": u, **text} for i, k, u in ((1, "a", "u1"), (2, "b", "u2"), (3, "b", "u2"), (4, "d", None))]
    df = store.as_stories(spark.createDataFrame(rows, "id bigint, dedup_key string, source_url string, " + ", ".join(f"{c} string" for c in text)))
    assert df.columns == tables["stories"].columns and df.head().flags == [] and df.head().revision == 1
    found = {r.problem: r.n for r in store.violations(df).collect()}
    assert found == {"NULL source_url": 1, "repeated dedup_key": 1, "repeated source_url": 1}
    with pytest.raises(ValueError, match="repeated dedup_key: 1"):
        store.write_stories(df, f"{path}/new")
    store.write_stories(df.where("id < 3"), f"{path}/new")
    assert spark.read.parquet(f"{path}/new").count() == 2


def test_sites_of_their_own(spark):
    def parser(pages, site):
        return pages.select(F.col("url").alias("source_url"), site.dedup_key(F.col("url")).alias("dedup_key"), site.external_id(F.col("url")).alias("external_id"), F.upper("html").alias("title"))

    one = Site("one", "One", "https://one.org/", "one.org", r"/s/\d+$", (r"/list",), key_of=lambda u: F.md5(u), id_of=lambda u: F.regexp_extract(u, r"/s/(\d+)", 1), parser=parser)
    two = Site("two", "Two", "https://two.org/", "two.org", "/story", normalize=lambda u: F.lower(u))
    pages = spark.createDataFrame([("https://one.org/s/7", "<p>x</p>"), ("https://one.org/list/2", ""), ("https://TWO.org/STORY/1", "<title>T</title><p>long enough</p>"), ("https://three.org/s/1", "")], "url string, html string")
    got = {r.source_site: r for r in records_of(pages, [one, two], F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got["one"].external_id == "7" and got["one"].title == "<P>X</P>" and len(got["one"].dedup_key) == 32
    assert got["two"].dedup_key == "https://two.org/story/1" and got["two"].external_id is None and len(got) == 2
    links = spark.createDataFrame([("https://one.org/list/2", '<a href="/s/1">a</a><a href="/list/3">b</a><a href="/x">c</a>')], "url string, html string")
    assert [(r.url, r.is_story) for r in site_links(links, one).orderBy("pos").collect()] == [("https://one.org/s/1", True), ("https://one.org/list/3", False)]


def test_shared_folder_is_no_machines_own():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert shared.shared_dir(Session).startswith("file:")


def repeated_pages(spark, tmp_path):
    """Three pages, two of them of one URL."""
    d = str(tmp_path)
    spark.createDataFrame([(1, "https://a.org/en/1", "<a href='/x'>x</a>"), (3, "https://a.org/en/1", "longer"), (4, "https://b.org/en/2", "p")], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def test_fetch_log_of_repeated_urls(spark, tmp_path):
    got = {r.request_id: (r.attempts, r.status, r.reason) for r in registry.fetch_log(spark, repeated_pages(spark, tmp_path)).collect()}
    assert got == {1: (2, 200, None), 3: (3, None, "no answer"), 4: (1, 200, None)}


def test_health_of_repeated_urls(spark, tmp_path):
    got = registry.health_by_site(spark, repeated_pages(spark, tmp_path)).collect()
    found = sorted((r.site, r.status, r.http_status or 0, r.html_chars or 0) for r in got)
    assert found == [("absent", "FAIL", 0, 0), ("https://a.org/en/1", "FAIL", 503, 0), ("https://a.org/en/1", "PASS", 200, 6), ("https://b.org/en/2", "PASS", 200, 1)]


def test_classify_reads_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "a\n" + "x " * 3000 + "the worthless", "en", "s")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.niche, r.score) for r in registry.classify_scores(spark, str(tmp_path)).collect()] == [("english", 2)]


def test_classify_counts_once(spark):
    """What is inferred from the exploded scores must not evaluate the texts again."""
    df = registry.classify_scores(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan


def test_occurrences():
    assert [classify.occurrences(x, "le") for x in ("le", "people le", "le le-le 'le'", "lele", "", "le2 éle")] == [1, 1, 4, 0, 0, 0]
    for x in ("A_b/c — d", "Straße’s ﬁ-x", "it's\tOK\n!"):
        assert classify.normal_term(x) == " ".join(classify.SIGNS.sub(" ", unicodedata.normalize("NFKC", x).casefold()).split())


def test_stream_pieces_have_several_files(spark, tmp_path):
    """Each piece is one micro-batch in order, of as many files as the table has splits; one that lacks rows has empty files."""
    for i in range(3):
        spark.range(i * 4, i * 4 + 4, 1, 1).selectExpr("id as n", "repeat('x', 10) as t").write.mode("append").parquet(f"{tmp_path}/rows.parquet")
    n = spark.read.parquet(f"{tmp_path}/rows.parquet").rdd.getNumPartitions()
    batches = []
    q = registry._stream(spark, str(tmp_path), "rows", "n").writeStream.foreachBatch(lambda df, i: batches.append((i, sorted(r.n for r in df.collect()), len(df.inputFiles())))).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    assert n > 1 and [b[0] for b in batches] == [0, 1, 2, 3] and sum((b[1] for b in batches), []) == list(range(12))


def test_stream_states_share_buckets(spark, tmp_path):
    keys = 2 * streams.BUCKETS
    rows = spark.range(keys * 3).selectExpr("cast(id %% %d as string) as dedup_key" % keys, "if(id < %d, 'found', 'mark') as action" % keys, "'failed' as state", "cast(id as string) as error", "true as bump", "id as n")
    rows.write.parquet(f"{tmp_path}/in")
    q = streams.queue_states(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "n").writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.dedup_key: (r.state, r.attempts, r.last_error, r.due) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {str(k): ("failed", 2, str(2 * keys + k), False) for k in range(keys)}
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress) <= streams.BUCKETS


def test_pages_are_parsed_in_pieces():
    long = "x" * H.PIECE
    got = [p.to_pylist() for p in H.pieces(pa.array(["a", long, None, "b"] + ["c"] * 2 * H.PIECE_ROWS))]
    assert sum(got, []) == ["a", long, None, "b"] + ["c"] * 2 * H.PIECE_ROWS
    assert [len(p) for p in got] == [1, 2, H.PIECE_ROWS, H.PIECE_ROWS, 1] and list(H.pieces(pa.array([], pa.string())))[0].to_pylist() == []
    assert H.parse("<a href='/x'>x</a>", want=("links",)) == {"links": H.parse("<a href='/x'>x</a>")["links"]}
