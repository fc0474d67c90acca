"""Operators on small tables, cases of their own."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from snapweave.functions.htmltree import parse
from snapweave.functions.registry import register_functions
from snapweave.operators import cleaning, extract, ingest, logs, mime, pages, resources, rewrite, security, shares, text
from snapweave.sources import store
from snapweave.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def one(spark, column, **values):
    """A column's value over a row of literals."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("url,good", [("https://a.com/", True), ("file:///x", False), ("about:blank", False), ("chrome://x", False), ("http://LOCALHOST:3/", False), ("http://a.local", False), ("http://192.168.1.1", False), ("http://192.169.1.1", True), ("http://[::1]/", False), ("http://[fd12::1]/", False), ("http://[2001:db8::1]/", True), ("http://[::ffff:10.0.0.1]/", False), ("not a url", True), (None, True)])
def test_admissible(spark, url, good):
    assert one(spark, ingest.admissible(F.col("u").cast("string")), u=url) is good


@pytest.mark.parametrize("url,domain", [("https://u:p@Ex_ample.com:8/x", "Ex_ample.com"), ("http://[::1]:80/", "::1"), ("x", ""), (None, ""), ("https://häuser.de?q", "häuser.de")])
def test_domain(spark, url, domain):
    assert one(spark, ingest.extract_domain(F.col("u").cast("string")), u=url) == domain


def test_content_hash_counts_frames_in_order(spark):
    kind = "html string, frames array<struct<key:string,url:string,title:string,html:string>>"
    a, b = {"key": "a", "url": "u", "title": "", "html": "x"}, {"key": "b", "url": "u", "title": "", "html": "x"}
    rows = spark.createDataFrame([("h", [a, b]), ("h", [b, a]), ("h", [a]), ("h", None), ("h", [])], kind)
    got = [r.x for r in rows.select(ingest.content_hash(F.col("html"), F.col("frames")).alias("x")).collect()]
    assert got[0] == got[1] != got[2] and got[3] == got[4]


def test_updates(spark):
    held = spark.createDataFrame([(1, "u1", "t", "h", "p", "b", T0, "pending"), (2, "u2", "t", "h", "p", "b", T0, "ready")], "id long, url string, title string, content_hash string, html_path string, body_text string, last_visited timestamp_ntz, snapshot_state string")
    new = spark.createDataFrame([(1, "u1", None, "h2", "p2", "", T0), (2, "other", "x", "h3", "p3", "y", T0), (3, "u3", "x", "h", "p", "y", T0)], "id long, url string, title string, content_hash string, html_path string, body_text string, updated_at timestamp_ntz")
    out, told = ingest.apply_updates(held, new)
    got = {r.id: r for r in out.collect()}
    assert (got[1].title, got[1].content_hash, got[1].body_text, got[1].snapshot_state) == ("t", "h2", "", "ready") and got[2].content_hash == "h"
    assert {r.id: r.action for r in told.collect()} == {1: "updated", 2: "rejected", 3: "unknown"}


def test_change_bursts(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, at(1), False)] * 6 + [(1, at(7), False)] * 5 + [(1, at(12), False)] * 9 + [(1, at(13), True)] * 9 + [(1, at(400), False)] * 50 + [(2, at(1), False)]
    got = ingest.change_bursts(spark.createDataFrame(rows, "page_id long, ts timestamp_ntz, hidden boolean")).collect()
    assert [(r.page_id, r.tick, r.changes) for r in got] == [(1, at(5), 11)]


@pytest.mark.parametrize("html,status", [("<body><script>x</script></body>", "empty"), ('<body class="a none">text</body>', "placeholder"), ('<body style="display: none">t</body>', "placeholder"), ("<body>text</body>", "ok"), ("", "empty")])
def test_frame_status(spark, html, status):
    assert one(spark, ingest.frame_status(F.col("h")), h=html) == status


def test_search(spark):
    rows = spark.createDataFrame([(1, "u", "100%_Done", "<b> Straße & more"), (2, "u", None, None)], "id long, url string, title string, body_text string")
    assert [r.id for r in rows.where(pages.search_filter("%_d")).collect()] == [1]
    assert rows.where(pages.concat_filter("u\n100")).count() == 1
    with pytest.raises(ValueError):
        pages.search_filter("")
    assert one(spark, pages.highlight_term(F.col("t"), "a<B"), t='xA<b"') == "x<mark>A&lt;b</mark>&quot;"
    assert one(spark, pages.highlight_term(F.col("t"), "q"), t="abc") == ""
    assert one(spark, pages.highlight_term(F.col("t"), r"a\Eb"), t=r"xA\Eb") == r"x<mark>A\Eb</mark>"
    assert one(spark, pages.search_snippet(F.col("t"), "key", 3), t="abcdefkeyghijkl") == "...def<mark>key</mark>ghi..."


def test_arguments():
    for bad in ((0, 0), (1001, 0), (5, -1)):
        with pytest.raises(ValueError):
            pages.check_page(*bad)
    with pytest.raises(ValueError):
        pages.date_range_filter("2024-1-1")
    with pytest.raises(ValueError):
        resources.retention_plan(None, None, None, 0)


def test_neighbours_skip_ties(spark):
    rows = [(1, "u", T0), (2, "u", T0), (3, "u", T0 + dt.timedelta(microseconds=1)), (4, "v", T0)]
    got = {r.id: (r.prev_id, r.next_id, r.total) for r in pages.snapshot_neighbors(spark.createDataFrame(rows, "id long, url string, first_visited timestamp_ntz")).collect()}
    assert got == {1: (None, 3, 3), 2: (None, 3, 3), 3: (2, None, 3), 4: (None, None, 1)}


@pytest.mark.parametrize("control,expires,seconds", [("max-age=60", None, 60), ("max-age=999999", None, 7200), ("no-cache, max-age=60", None, None), ("max-age=60, no-store", None, 60), ("max-age=x", None, None), ("public", "Mon, 01 Jan 2024 00:30:00 GMT", 1800), (None, "Mon, 01 Jan 2024 09:00:00 GMT", 7200), (None, "0", None), (None, None, None)])
def test_freshness(spark, control, expires, seconds):
    until = one(spark, resources.freshness(F.col("c").cast("string"), F.col("e").cast("string"), F.lit(T0).cast("timestamp_ntz")), c=control, e=expires)
    assert until == (None if seconds is None else T0 + dt.timedelta(seconds=seconds))


def test_fetches(spark):
    rows = [(1, "a", 200, "h1"), (2, "a", 200, "h1"), (3, "b", 200, "h1"), (4, "b", 500, None), (5, "c", 500, None), (6, "a", 304, None)]
    df = spark.createDataFrame([(i, u, T0 + dt.timedelta(seconds=i), s, h) for i, u, s, h in rows], "fetch_id long, url string, fetched_at timestamp_ntz, status int, content_hash string")
    assert {r.fetch_id: (r.action, r.source_fetch) for r in resources.resolve_fetches(df).collect()} == {1: ("create", 1), 2: ("reuse", 1), 3: ("share", 1), 4: ("fallback", 3), 5: ("error", None), 6: ("cached", 2)}


HTML = """<img data-src="no.png" src="a.png" srcset="b.png 1x, c,d.png 2x"><LINK rel="stylesheet" href='s.css'><link rel=x href="n"><link rel="preload" as="font" href="f.woff2">
<script src="//cdn.example.com/j.js"></script><iframe src="../f.html"></iframe><video poster="p.jpg"><source src="v.mp4"></video><i style="background:url(&quot;bg.png&quot;)"></i><img src="data:x"><img src="http://localhost/x.png">"""


def test_extract(spark):
    df = spark.createDataFrame([(1, "https://example.com/d/page.html", HTML)], "page_id long, url string, html string")
    got = {r.resource_url: r.type for r in extract.extract_resources(df).collect()}
    base = "https://example.com/d/"
    assert got == {base + "a.png": "image", base + "b.png": "image", base + "c,d.png": "image", base + "s.css": "css", base + "f.woff2": "font", "https://cdn.example.com/j.js": "js", "https://example.com/f.html": "html", base + "p.jpg": "image", base + "v.mp4": "other", base + "bg.png": "image"}


@pytest.mark.parametrize("base,ref,out", [("https://a.com/b/c", "../../../d", "https://a.com/d"), ("https://a.com/b/", "?q", "https://a.com/b/?q"), ("https://a.com", "//b.com/x", "https://b.com/x"), ("https://a.com", "#x", "#x"), ("https://a.com", "data:x", "data:x"), ("https://a.com/", "https://b.com/x/../y", "https://b.com/y"), ("https://a.com/", "http://[bad", "http://[bad")])
def test_join_url(base, ref, out):
    assert extract.join_url(base, ref) == out


def test_css_and_srcset(spark):
    css = "@import 'a.css'; x{background:url( \"b.png\" )} y{background:url(data:z)} z{src:url(b.png)}"
    assert one(spark, extract.extract_css_urls(F.col("c")), c=css) == ["a.css", "b.png"]
    assert one(spark, extract.join_srcset(extract.parse_srcset(F.col("v"))), v="a.jpg, b.jpg 2x,c,d.png 100w") == "a.jpg, b.jpg 2x, c,d.png 100w"


def test_viewport(spark):
    html = one(spark, extract.viewport_meta(F.col("h"), F.lit(10), F.lit(20), F.lit(2.0)), h="<html><head></head>")
    assert tuple(one(spark, extract.read_viewport(F.col("h")), h=html)) == (10, 20, 2.0)
    assert one(spark, extract.viewport_meta(F.col("h"), F.lit(0), F.lit(20), F.lit(2.0)), h="<head>") == "<head>"


def test_rewrite():
    html = """<a href="x/y?a=1&amp;b=2"><img src='/r.png' srcset="s.png 1x, t.png 2x"><a href="mailto:q"><i style="background:url('u.png')"></i>"""
    made = rewrite.absolute(html, "https://e.com/d/p")
    assert 'href="https://e.com/d/x/y?a=1&b=2"' in made and "src='/r.png'" in made and "https://e.com/d/s.png 1x, https://e.com/d/t.png 2x" in made and "mailto:q" in made
    out = rewrite.mapped(made, "https://e.com/d/p", {"https://e.com/r.png": "resources/r", "https://e.com/d/u.png": "resources/u"}, "/archive/1/2mp_/")
    assert "src='/archive/1/2mp_/https://e.com/r.png'" in out and "url('/archive/1/2mp_/https://e.com/d/u.png')" in out and "https://e.com/d/s.png 1x" in out
    assert rewrite.mapped("<img src='/r.png'>", "https://e.com/", {"https://e.com/r.png": "resources/r"}, "") == "<img src='/archive/resources/r'>"


def test_frame_tree_keeps_cycles(spark):
    tag = lambda k: f'<iframe data-snapweave-frame-key="{k}" src="old-{k}"></iframe>'
    rows = [(1, "a", "https://a/", tag("b") + tag("c")), (1, "b", "https://b/", tag("d")), (1, "d", "https://d/", tag("b")), (1, "c", "https://c/", "leaf")]
    got = {r.key: r.html for r in rewrite.resolve_frame_tree(spark.createDataFrame(rows, "capture_id long, key string, url string, html string"), F.lit("/archive/1/2mp_/")).collect()}
    assert "/archive/1/2mp_/https://b/" in got["a"] and "/archive/1/2mp_/https://c/" in got["a"] and "old-d" in got["b"] and "old-b" in got["d"] and got["c"] == "leaf"


def test_backfill_takes_the_text_of_whole_pages(spark):
    """Pages without text get that of their html, whole, however long; a lost file is told, an empty text stays null, others stay out."""
    long = "<body>" + "".join(f"<p>word{k}</p>" for k in range(3000)) + "<script>no</script></body>"
    pages_ = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", None), (4, "d", "has")], "id long, html_path string, body_text string")
    html = spark.createDataFrame([("a", long), ("b", "<body><style>x</style></body>"), ("d", "<p>other</p>")], "html_path string, html string")
    got = {r.id: (r.body_text, r.found) for r in ingest.backfill_body_text(pages_, html, text.body_text).collect()}
    assert got == {1: (" ".join(f"word{k}" for k in range(3000)), True), 2: (None, True), 3: (None, False)}


def test_frame_tree_sees_long_cycles(spark):
    tag = lambda k: f'<iframe data-snapweave-frame-key="{k}" src="old"></iframe>'
    rows = [(1, f"k{k}", f"https://{k}/", tag(f"k{(k + 1) % 23}") + tag("leaf")) for k in range(23)] + [(1, "leaf", "https://leaf/", "x")]
    rows += [(2, f"k{k}", f"https://{k}/", tag(f"k{k + 1}")) for k in range(40)]
    got = rewrite.resolve_frame_tree(spark.createDataFrame(rows, "capture_id long, key string, url string, html string"), F.lit("/a/")).collect()
    for r in got:
        if r.capture_id == 1 and r.key != "leaf":
            assert r.html.count('src="old"') == 1 and "/a/https://leaf/" in r.html
        if r.capture_id == 2:
            assert ("/a/https://" in r.html) == (r.key != "k39")


def test_text_and_markdown(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><p>one<p>two<script>no</script><ul><li>a<li>b</ul></body>"
    assert text.visible_text(page) == "menu one two a b"
    html = f"<body><div class='sidebar'>{'link ' * 40}</div><article><h2>Head</h2><p>Some <b>bold</b> <a href='u'>link</a> {'word ' * 40}</p><ul><li>x</li><li>y</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><pre>code  here</pre><blockquote>said</blockquote><del>gone</del></article><form><input></form></body>"
    got = text.to_markdown(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    md = got[0].markdown
    for part in ("## Head", "**bold**", "[link](u)", "- x\n- y", "| a | b |\n| --- | --- |\n| 1 | 2 |", "```\ncode  here\n```", "> said", "~~gone~~"):
        assert part in md
    assert "link link" not in md and "\n\n\n" not in md and md.endswith("\n")


def test_sanitize(spark):
    html = """<head><base href="x"><meta http-equiv="Content-Security-Policy" content="x"></head><script>a</script><noscript>n</noscript><a onclick="x()" href="javascript:void(0)" onload='y'>k</a><img loading="lazy" src="i">
<video autoplay src="v"></video><video autoplay></video><object data="o">z</object><picture><source srcset="p"><img src="q"></picture><source src="keep"><i style="background:url(https://x.com/a.png)"></i><div id="placeholder"><div>in</div></div><div>out</div>
<button>a<button>b</button></button><p data-animate="up" style="opacity:0; color:red; transform: translate(1px)">s</p>"""
    out = spark.createDataFrame([(1, html)], "page_id long, html string").transform(cleaning.sanitize_pages).first().html
    for gone in ("<base", "Content-Security", "<script", "<noscript", "onclick", "onload", "javascript:", "lazy", "autoplay", "<object", 'srcset="p"', "x.com", "placeholder", "opacity", "translate"):
        assert gone not in out
    for kept in ('href="#"', '<video src="v" controls>', 'style="display:none"', '<source src="keep">', "<div>out</div>", "<span>b</span>", "color:red", 'url("")'):
        assert kept in out


def test_cleaning_steps_leave_the_rest_as_written():
    same = lambda html, *steps: cleaning.cleaned(html, *steps) == html
    assert all(same(h, *cleaning.STEPS) for h in ("", "a < b > c", "<p title='x>y' data-on=\"z\">t</p>", "<svg><path style=\"transform: scale(2)\"/></svg>", "<p class='fade' style='opacity: 0.5'>x</p>", "<button>a</button><button>b</button>", "<script>never ended", "<video src='a'>"))
    for html, step, want in (
        ("<path style='opacity: 0; fill:red; stroke-dashoffset: 9'/>", "fix_hidden_animation", "<path style='fill:red'/>"),
        ("<i data-animate-in style=\"opacity:0.0;rotate:3deg\">x</i>", "fix_hidden_animation", "<i data-animate-in>x</i>"),
        ("<g style='opacity:0'>x</g>", "fix_hidden_animation", "<g style='opacity:0'>x</g>"),
        ("<button a><button b>x</button></button>", "fix_nested_buttons", "<button a><span b>x</span></button>"),
        ("<div id='ScriptLoadFailure'><div>a</div>b</div>c", "drop_overlays", "c"),
        ("<video autoplay=autoplay controls><source src=x></video>", "fix_video", "<video controls><source src=x></video>"),
        ("<VIDEO AUTOPLAY/>", "fix_video", '<VIDEO style="display:none"></video>'),
        ("<object><object>a</object>b</object>c<embed src='x'>d<frame src='y'>", "drop_frames", "cd"),
        ("<picture><source srcset=a><img src=b></picture><source src=c>", "drop_picture_sources", "<picture><img src=b></picture><source src=c>"),
        ("<a HREF='JavaScript:go()' onclick='a' x>b</a><SCRIPT>if (a<b) x()</SCRIPT>", "drop_active", '<a href="#" x>b</a>'),
    ):
        assert cleaning.cleaned(html, step) == want


def test_deep_pages_take_little_time():
    deep = "<div class='content'>" * 2000 + "word " * 50 + "</div>" * 2000
    began = time.perf_counter()
    rows = list(text._candidates(1, deep))
    assert len(rows) == 2000 and rows[0][6:] == (249, 0, 0, 0, 0, 0)
    assert text.page_markdown(deep, None).strip() == " ".join(["word"] * 50)
    assert time.perf_counter() - began < 1.5


def test_candidates_count_links_and_blocks():
    """Against a plain walk up from each text."""
    html = "<div id='main'>a <a>bb <i>c</i></a><p>ddd <a>e</a></p><a><p>ff</p>g</a><section><h2>h</h2><ul><li>x<li>y</ul><input></section></div>"
    got = {(r[2], r[4]): r[6:] for r in text._candidates(1, html)}
    assert got["div", "main"] == (14, 5, 8, 4, 1, 0) and got["section", ""] == (3, 0, 2, 2, 1, 0)


def test_layout_tables_are_no_tables():
    assert "|" not in text.page_markdown("<table><tr><td>a</td><td>b</td></tr></table>", None)
    for table in ("<table><tr><th>a</th><td>b</td></tr></table>", "<table role='grid'><tr><td>a</td><td>b</td></tr></table>", "<table class='my-data-table'><tr><td>a</td><td>b</td></tr></table>", "<table><caption>c</caption><tr><td>a</td><td>b</td></tr></table>"):
        assert "| a | b |" in text.page_markdown(table, None)
    assert "| a | b |" in text.page_markdown(f"<table><tr><td>{'<table><tr><th>a</th><th>b</th></tr></table>'}</td></tr></table>", None)


def test_html_tree_closes_what_it_must():
    root = parse("<table><tr><td>1<td>2<tr><td>3</table><p>a<div>b</div>")
    assert [n.tag for n in root.walk()] == ["#root", "table", "tr", "td", "td", "tr", "td", "p", "div"]


def test_safety(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("x.y.ck",), ("www.ck",), ("co.uk",), ("10.0.0.1",), ("deep.a.example.com",)], "host string")
    got = {r.host: r.root for r in security.root_domain(rows, security.suffix_rules(spark)).collect()}
    assert got == {"a.b.co.uk": "b.co.uk", "x.y.ck": "x.y.ck", "www.ck": "www.ck", "co.uk": "co.uk", "10.0.0.1": "10.0.0.1", "deep.a.example.com": "example.com"}
    for path, good in (("a/b", True), ("/a", False), ("a/../..", False), ("a/../b", True), ("..\\x", False)):
        assert one(spark, security.safe_path(F.col("p")), p=path) is good
    for url, ips, verdict in (("ftp://x", [], "bad_scheme"), ("http://", [], "no_host"), ("http://a.com", ["1.1.1.1", "10.0.0.1"], "private"), ("http://a.com", [], "ok"), ("http://a.com", ["169.254.169.254"], "metadata"), ("http://[fc00::1]/", [], "private"),
        ("http://[::ffff:127.0.0.1]/", [], "private"), ("http://a.com", ["::ffff:169.254.169.254"], "metadata"), ("http://a.com", ["::ffff:10.0.0.1"], "private"), ("http://[fd00:ec2::254]/", [], "metadata"), ("http://[::ffff:8.8.8.8]/", [], "ok"), ("http://[2001:db8::1]/", [], "ok"), ("http://[::ffff:7f00:1]/", [], "private")):
        assert one(spark, security.classify_fetch_url(F.lit(url), F.array(*[F.lit(i) for i in ips]).cast("array<string>"))) == verdict


def test_content_types(spark):
    assert one(spark, mime.content_type(F.lit("other"), F.lit("https://a/x?format=PNG"), F.lit("p.bin"))) == "image/png"
    assert one(spark, mime.font_magic(F.unhex(F.lit("00" * 34 + "4C50")))) == "application/vnd.ms-fontobject"
    assert one(spark, mime.looks_like_html(F.lit("https://a/x"), F.lit("  <!DOCTYPE html>"))) is True
    assert one(spark, mime.looks_like_html(F.lit("https://a/x.png"), F.lit("GIF89"))) is False


def test_logs(spark):
    lines = spark.createDataFrame([("f", k, "x" * k) for k in range(1, 8)], "file string, line_no long, line string")
    assert [r.line_no for r in logs.log_tail(lines, 2).orderBy("line_no").collect()] == [6, 7]
    part = logs.log_range(lines, 5, 9).orderBy("line_no").collect()
    assert [r.line_no for r in part] == [3, 4] and all(r.has_more_before and r.has_more_after for r in part)
    assert one(spark, logs.size_label(F.lit(3 << 20))) == "3.00 MB"


def test_shares(spark):
    df = spark.createDataFrame([(1, None, None), (2, T0, None), (3, T0 + dt.timedelta(days=9), None), (4, None, T0)], "id long, expires_at timestamp_ntz, revoked_at timestamp_ntz")
    assert sorted(r.id for r in shares.active_shares(df, F.lit(T0).cast("timestamp_ntz")).collect()) == [1, 3]
    assert one(spark, shares.rewrite_for_share(F.lit("/archive/12/20240101mp_/u /archive/resources/r"), F.lit("t/k"))) == "/share/t%2Fk/archive/20240101mp_/u /share/t%2Fk/resources/r"


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"url": "u", "html": "h", "frames": [{"key": "k", "html": "x"}], "headers": {"A": "b"}}
    (tmp_path / "in/a.json").write_text("\n".join([json.dumps(good), json.dumps({"url": "u"}), "{broken", json.dumps(good | {"frames": [{"key": "k"}]})]))
    taken, refused = store.read_captures(spark, str(tmp_path / "in"))
    assert taken.count() == 1 and refused.count() == 3 and taken.first().headers == {"A": "b"}
    assert jobs.run_available(store.stream_captures(spark, str(tmp_path / "in")), str(tmp_path / "s")).count() == 1
    pages_ = spark.createDataFrame([(1, "u", T0), (1, "u", T0), (2, "v", T0 + dt.timedelta(days=1))], "id long, url string, captured_at timestamp_ntz")
    links = spark.createDataFrame([(1, 5), (9, 5)], "page_id long, resource_id long")
    store.write_catalog({"pages": pages_, "page_resources": links}, str(tmp_path / "cat"))
    assert store.read_catalog(spark, str(tmp_path / "cat"), "pages").count() == 2 and store.read_catalog(spark, str(tmp_path / "cat"), "page_resources").count() == 1
    store.write_html_snapshots(pages_, str(tmp_path / "html"))
    assert store.read_html_snapshots(spark, str(tmp_path / "html"), "2024-01-02").count() == 1
    (tmp_path / "q").mkdir()
    (tmp_path / "q/x.json").write_text('{"html_path":"a","timestamp":"2024-01-01T00:00:00","page_id":1}\n{bad\n')
    assert store.read_deletion_queue(spark, str(tmp_path / "q")).count() == 1
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/archive-2024-01-02.001.log").write_text("a\nb\n")
    assert [(r.file[8:18], r.size, r.lines) for r in store.list_logs(store.read_logs(spark, str(tmp_path / "logs"))).collect()] == [("2024-01-02", 4, 2)]
    (tmp_path / "files").mkdir()
    (tmp_path / "files/r.bin").write_bytes(b"x")
    assert store.read_resources(spark, str(tmp_path / "files")).first().length == 1
    store.write_resources(spark.createDataFrame([("h",), ("h",), ("i",)], "content_hash string"), spark.createDataFrame([("i",)], "content_hash string"), str(tmp_path / "res"))
    assert [r.content_hash for r in spark.read.parquet(str(tmp_path / "res")).collect()] == ["h"]


def stream_of(spark, tmp_path, name, df, parts=3):
    """df as files that arrive one after the other."""
    df.repartition(parts).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(k, f"u{k % 4}", f"h{k % 3}", T0 + dt.timedelta(seconds=k)) for k in range(60)]
    captures = spark.createDataFrame(rows, "capture_id long, url string, content_hash string, captured_at timestamp_ntz")
    got = jobs.stream_dedup_captures(stream_of(spark, tmp_path, "c", captures), str(tmp_path / "merged"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.merge_snapshots(None, captures).collect()))
    aware = captures.withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    assert jobs.run_available(jobs.stream_recent_capture(stream_of(spark, tmp_path, "r", aware, 1), "1 hour"), str(tmp_path / "o")).count() == 4
    assert jobs.run_available(jobs.first_of_content(stream_of(spark, tmp_path, "d", aware, 1)), str(tmp_path / "o2")).count() == 12

    events = spark.createDataFrame([(k % 5, k, ("created", "failed", "finalized", "retried", "updated")[(k * 7 + k // 5) % 5], T0 + dt.timedelta(seconds=k)) for k in range(50)], "page_id long, seq long, event string, ts timestamp")
    stream, last = jobs.stream_lifecycle(stream_of(spark, tmp_path, "e", events, 1)), {}
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: last.update({r.page_id: (r.seq, r.snapshot_state) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert last == {r.page_id: (r.seq, r.snapshot_state) for r in jobs.fold_lifecycle(events).collect()}

    queue = spark.createDataFrame([(f"p{k}", T0 + dt.timedelta(days=k), k) for k in range(10)], "html_path string, timestamp timestamp_ntz, page_id long")
    held, now = spark.createDataFrame([("p1",)], "html_path string"), F.lit(T0 + dt.timedelta(days=10)).cast("timestamp_ntz")
    gone = jobs.stream_retention(stream_of(spark, tmp_path, "q", queue), held, now, 5, str(tmp_path / "ret"))
    assert sorted(r.html_path for r in gone.collect()) == sorted(r.html_path for r in resources.retention_plan(queue, held, now, 5)[0].collect()) == ["p0", "p2", "p3", "p4"]


def test_stream_joins_and_bursts(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    requests = spark.createDataFrame([(1, "a", at(100)), (2, "a", at(9000)), (3, "b", at(50)), (4, "z", at(90000))], "request_id long, url string, requested_at timestamp")
    fetches = spark.createDataFrame([("a", at(10), 11), ("a", at(60), 12), ("z", at(90000), 13)], "url string, fetched_at timestamp, fetch_id long")
    out = jobs.run_available(jobs.stream_freshness_join(stream_of(spark, tmp_path, "rq", requests, 1), stream_of(spark, tmp_path, "ft", fetches, 1)), str(tmp_path / "o"))
    got = {r.request_id: r.fetch_id for r in jobs.newest_fresh(out).collect()}
    assert got[1] == 12 and got.get(2) is None and got.get(3) is None
    changes = [(1, at(s), False) for s in (1, 2, 3, 6, 7, 8, 9, 11, 12, 13, 14, 15)] + [(9, at(10000), False)]
    df = spark.createDataFrame(changes, "page_id long, ts timestamp, hidden boolean")
    stream = jobs.run_available(jobs.stream_change_bursts(stream_of(spark, tmp_path, "ch", df, 1), 5), str(tmp_path / "b"))
    assert {tuple(r) for r in stream.collect()} == {tuple(r) for r in ingest.change_bursts(df.where("page_id = 1").withColumn("ts", F.col("ts").cast("timestamp_ntz")), 5).collect()}
    (tmp_path / "lg").mkdir()
    (tmp_path / "lg/archive-2024-01-01.001.log").write_text("one\nError two\n")
    assert [r.line for r in jobs.run_available(jobs.stream_log_follow(spark, str(tmp_path / "lg"), "error"), str(tmp_path / "o3")).collect()] == ["Error two"]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """A second run with the same root reads only what is new; a source without rows gives an empty table."""
    rows = [(f"u{k % 4}", f"h{k % 3}", T0 + dt.timedelta(seconds=k)) for k in range(60)]
    kind = "url string, content_hash string, captured_at timestamp_ntz"
    (tmp_path / "in").mkdir()
    source = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    assert jobs.stream_dedup_captures(source(), str(tmp_path / "out")).count() == 0
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = jobs.stream_dedup_captures(source(), str(tmp_path / "out"))
    want = sorted(map(tuple, jobs.merge_snapshots(None, spark.createDataFrame(rows, kind)).collect()))
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, jobs.compact_snapshots(spark, str(tmp_path / "out"), str(tmp_path / "whole")).collect())) == want
    log = tmp_path / "lines"
    log.mkdir()
    for n in (1, 2):
        (log / f"archive-2024-01-0{n}.001.log").write_text(f"line {n}\n")
        lines = jobs.run_available(jobs.stream_log_follow(spark, str(log)), str(tmp_path / "follow"))
        assert sorted(r.line for r in lines.collect()) == [f"line {k}" for k in range(1, n + 1)]


def test_bursts_count_a_page_s_life_from_hidden_changes_too(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    changes = [(1, at(0), True)] + [(1, at(s), False) for s in range(290, 320)] + [(9, at(10000), True)]
    df = spark.createDataFrame(changes, "page_id long, ts timestamp, hidden boolean")
    want = {tuple(r) for r in ingest.change_bursts(df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()}
    assert {t.minute * 60 + t.second for _, t, _ in want} == {295}
    assert {tuple(r) for r in jobs.run_available(jobs.stream_change_bursts(stream_of(spark, tmp_path, "ch", df, 1)), str(tmp_path / "b")).collect()} == want


def test_sql_functions(spark):
    register_functions(spark)
    assert spark.sql("SELECT extract_domain('https://u@a.com:1/x') d, guess_type('x.PNG') g, resource_path('abcdef', 'css') p, is_fetchable('http://localhost/') f, highlight_term('a<Bc', '<b') h").first() == ("a.com", "image", "resources/ab/cd/abcdef.css", False, "a<mark>&lt;B</mark>c")
    assert [r.url for r in spark.sql("SELECT * FROM extract_resources('<img src=\"a.png\">', 'https://e.com/d/')").collect()] == ["https://e.com/d/a.png"]


def test_plans_stay_in_the_jvm(spark):
    from snapweave.plans.queries import QUERIES

    for name in ("list_pages", "dedup_captures", "resolve_fetches", "snapshot_neighbors", "cookie_header", "log_level"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
    assert "TakeOrderedAndProject" in QUERIES["list_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def small_tables(spark, folder, page):
    """pages and events of the driver's form: three pages, the first of them with `page` in its body, and forty events."""
    html = [f"<html><head><title>T{k}</title></head><body><p>{page if k == 0 else 'short'}</p></body></html>" for k in range(3)]
    spark.createDataFrame([(k, f"https://www.example.com/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    rows = [(k, T0 + dt.timedelta(minutes=k), k % 5, "view", 1.0) for k in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_search_reads_whole_pages(spark, tmp_path):
    from snapweave.plans.fixtures import Tables
    from snapweave.plans.queries import QUERIES

    at = small_tables(spark, tmp_path, "word " * 2000 + "last")
    text = {r.id: r.body_text for r in Tables(spark, at).snapshots.where("url like '%/0' and id % 5 != 0").collect()}
    assert text and all(t == "T0 " + "word " * 2000 + "last" for t in text.values())
    got = {r.id: r.body_text for r in QUERIES["catalog_pages"](spark, at).collect()}
    assert all(got[i] == t for i, t in text.items())
    assert pages.search_count(Tables(spark, at).snapshots, "last").first()[0] == len(text)


def test_all_captures_and_pages_are_read(spark, tmp_path):
    from snapweave.plans.fixtures import Tables
    from snapweave.plans.queries import QUERIES

    at = small_tables(spark, tmp_path, "word " * 20 + "last")
    assert {r.capture_id for r in QUERIES["read_captures"](spark, at).collect()} == {k for k in range(40) if k % 3}
    todo = {r.id: "word " * 20 + "last" if r.url.endswith("/0") else "short" for r in Tables(spark, at).snapshots.where("body_text is null").collect()}
    got = {r.id: (r.body_text, r.found) for r in QUERIES["backfill_body_text"](spark, at).collect()}
    assert todo and got == {i: (t, True) for i, t in todo.items()}
