"""Queries of text, Markdown, cleaning and rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, pages, rewrite, shares, text
from .registry import ntz, query

TS = "20240101000000"


@query()
def body_text(t):
    return t.pages_raw.select("page_id", text.body_text("html").alias("text"))


@query()
def content_candidates(t):
    return text.content_candidates(t.rich)


@query()
def pick_main_content(t):
    return text.pick_main_content(text.content_candidates(t.pages_raw))


@query()
def to_markdown(t):
    return text.to_markdown(t.rich)


#: What the steps that are patterns alone make of a page of `rich`.
NATIVE = r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '\s+on\w+\s*=\s*"[^"]*"', '', 'gi'), '\s+on\w+\s*=\s*''[^'']*''', '', 'gi'),
    'href\s*=\s*["'']javascript:[^"'']*["'']', 'href="#"', 'gi'), '<embed\b[^>]*/?>', '', 'gis') AS h FROM rich"""


@query(f"SELECT page_id, length(h) AS n, md5(h) AS digest FROM ({NATIVE})")
def sanitize_native(t):
    return t.rich.select("page_id", cleaning.drop_external_css_refs(cleaning.cleaning_step("drop_active", "drop_frames")("html")).alias("h")).select("page_id", F.length("h").cast("long").alias("n"), F.md5("h").alias("digest"))


@query(f"SELECT page_id, md5(replace(h, ' autoplay></video>', ' controls></video>')) AS digest FROM ({NATIVE})")
def sanitize_pages(t):
    return cleaning.sanitize_pages(t.rich).select("page_id", F.md5("html").alias("digest"))


def _linked_css(t):
    return t.pages_raw.select("page_id", F.concat(F.lit('<style>a{background:url("'), "url", F.lit('")} b{background:url(/archive/x.png)}</style>')).alias("css"))


@query("""SELECT page_id, '<style>a{background:url("")} b{background:url(/archive/x.png)}</style>' AS css FROM pages""")
def drop_external_css_refs(t):
    return _linked_css(t).select("page_id", cleaning.drop_external_css_refs(F.col("css")).alias("css"))


@query("SELECT page_id, html FROM rich".replace("html FROM", "length(regexp_replace(html, '<script\\b[^>]*src\\s*=\\s*[\"''](?:https?:)?//[^\"''/]*cdn[^\"''/]*/[^\"'']*[\"''][^>]*>\\s*</script>', '', 'gis')) AS n FROM"))
def drop_third_party(t):
    return t.rich.select("page_id", F.length(cleaning.drop_third_party(F.col("html"))).cast("long").alias("n"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM pages""")
def escape_html(t):
    return t.pages_raw.select("page_id", F.md5(pages.escape_html(F.col("html"))).alias("digest"))


@query()
def shared_content(t):
    html = t.snapshots.select("html_path", "html")
    return shares.shared_content(t.shares, html, ntz("2024-01-20"), cleaning.sanitize_html, text.markdown)


def _dated(t):
    return t.rich.select("page_id", "url", "html", F.lit(TS).alias("timestamp"))


def _paths(t):
    from ..operators.extract import extract_resources

    return extract_resources(t.rich).select("page_id", "resource_url", F.concat(F.lit("resources/"), F.sha2("resource_url", 256)).alias("path"))


@query(r"""SELECT page_id, md5(replace(html, 'src="../frames', 'src="' || regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*/)', 1), '[^/]+/$', '') || 'frames')) AS digest FROM rich""")
def resolve_relative_refs(t):
    return t.rich.select("page_id", F.md5(rewrite.resolve_relative_refs("html", "url")).alias("digest"))


@query()
def rewrite_html(t):
    return rewrite.rewrite_html(_dated(t), _paths(t))


@query(rf"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '(\s(?:src|href|poster)\s*=\s*["''])//([^/"''])', '\1/archive/' || page_id || '/{TS}mp_/https://\2', 'gi'),
    '(\s(?:src|href|poster)\s*=\s*["''])/([^/])', '\1/archive/' || page_id || '/{TS}mp_/' || regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/\2', 'gi')) AS digest FROM rich""")
def rewrite_unmapped(t):
    return _dated(t).select("page_id", F.md5(rewrite.rewrite_unmapped(F.col("html"), F.col("page_id"), F.col("timestamp"), F.col("url"))).alias("digest"))


@query()
def rewrite_css(t):
    from .content_queries import _sheets
    from ..operators.extract import css_subresources

    sheets, css = _sheets(t)
    links = css_subresources(sheets, css).select("page_id", "resource_url", F.sha2("resource_url", 256).alias("path"))
    return rewrite.rewrite_css(sheets.join(css, "css_url").select("page_id", "css_url", "css"), links)


@query()
def normalize_html_urls(t):
    return t.rich.select("page_id", rewrite.normalize_html_urls("html", "url").alias("html"))


@query()
def rewrite_pages(t):
    return rewrite.rewrite_pages(_dated(t), _paths(t))


@query()
def mark_frames(t):
    n = F.array_size(F.regexp_extract_all("html", F.lit("<iframe"), 0))
    rows = t.rich.withColumn("_n", n).where("_n > 0").select("page_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("position"))
    frames = rows.select(F.col("page_id").alias("capture_id"), "position", F.concat(F.lit("k"), F.col("position").cast("string")).alias("key"), F.lit("https://frames.example.com/").alias("url"), F.when(F.col("position") % 3 == 2, "empty").otherwise("ok").alias("status"))
    return rewrite.mark_frames(t.rich.select(F.col("page_id").alias("capture_id"), "html"), frames)


@query()
def resolve_frame_tree(t):
    """Each page's links as frames, each of which holds the next one; in every third page the last holds the first."""
    paths = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)">'), 1))
    rows = t.pages_raw.select(F.col("page_id").alias("capture_id"), paths.alias("p")).select("capture_id", F.array_size("p").alias("n"), F.posexplode("p").alias("k", "path"))
    follow = F.when(F.col("k") + 1 < F.col("n"), F.col("k") + 1).when(F.col("capture_id") % 3 == 0, F.lit(0))
    tag = F.concat(F.lit('<iframe data-snapweave-frame-key="k'), follow.cast("string"), F.lit('" src="old"></iframe>'))
    frames = rows.select("capture_id", F.concat(F.lit("k"), F.col("k").cast("string")).alias("key"), F.concat(F.lit("https://frames.example.com"), "path").alias("url"), F.concat(F.lit("<p>"), F.coalesce(tag, F.lit("")), F.lit("</p>")).alias("html"))
    return rewrite.resolve_frame_tree(frames, F.lit("/archive/1/2mp_/"))


@query()
def strip_non_content(t):
    return t.rich.select("page_id", text.content_text("html").alias("html"))


#: Steps, html that is put behind a page's, and what each makes of it; all else of a page stays as it is.
SHAPES = {
    "drop_picture_sources": ("<picture><source srcset='a'><img src='b'></picture><source src='c'>", "<picture><img src='b'></picture><source src='c'>"),
    "drop_overlays": ("<div id='placeholder'><div>a</div>b</div><div id='x'>c</div>", "<div id='x'>c</div>"),
    "fix_nested_buttons": ("<button>a<button class='k'>b</button></button>", "<button>a<span class='k'>b</span></button>"),
    "fix_hidden_animation": ("<p data-animate='up' style='opacity: 0; color:red; rotate:3deg'>a</p><path style='scale: 2'/>", "<p data-animate='up' style='color:red'>a</p><path style='scale: 2'/>"),
    "drop_frames": ("<frame src='a'><object><object>b</object>c</object><embed src='d'/>e", "e"),
}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


for _name, (_given, _made) in SHAPES.items():
    query(f"SELECT page_id, md5(html || {_sql_text(_made)}) AS digest FROM rich", name=_name)(lambda t, n=_name, g=_given: t.rich.select("page_id", F.md5(cleaning.cleaning_step(n)(F.concat("html", F.lit(g)))).alias("digest")))


@query("SELECT page_id, md5(replace(html, ' autoplay></video>', ' controls></video>')) AS digest FROM rich")
def fix_video(t):
    return t.rich.select("page_id", F.md5(cleaning.cleaning_step("fix_video")("html")).alias("digest"))


@query(f"SELECT page_id, md5(html || {_sql_text(SHAPES['drop_picture_sources'][1] + 'e')}) AS digest FROM rich")
def drop_embeds(t):
    given = SHAPES["drop_picture_sources"][0] + SHAPES["drop_frames"][0]
    return t.rich.select("page_id", F.md5(cleaning.drop_embeds(F.concat("html", F.lit(given)))).alias("digest"))


@query("""SELECT page_id, '/p/' || url || ' 1x, ' || url || '.b 2x' AS srcset FROM pages""")
def rewrite_srcset(t):
    value = F.concat("url", F.lit(" 1x, "), "url", F.lit(".b 2x"))
    return t.pages_raw.select("page_id", rewrite.rewrite_srcset(value, F.create_map(F.col("url"), F.lit("path")), F.lit("/p/")).alias("srcset"))


@query()
def rewrite_with_resource_rows(t):
    return rewrite.rewrite_html(_dated(t), _paths(t), with_page=False)
