"""References in HTML and CSS as rows: patterns by regexp_extract_all, then resolve, filter and the last type of each url."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ATTR = r"""\s{0}\s*=\s*["']([^"']+)["']"""
FONTS, IMAGES = ("woff2", "woff", "ttf", "otf", "eot"), ("png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "avif")
SRCSET = r"([^\s,]\S*[^\s,]|[^\s,])(?:,+|\s+([^,]*))?"
CSS_URL, CSS_IMPORT = r"""url\(\s*["']?([^"')]+?)["']?\s*\)""", r"""(?i)@import\s+["']([^"']+)["']"""


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _attribute(tag: str, name: str) -> str:
    return rf"(?i)<{tag}\b[^>]*?" + ATTR.format(name)


def extract_img(html: Column) -> Column:
    return _all(html, _attribute("img", "src"))


def extract_script(html: Column) -> Column:
    return _all(html, _attribute("script", "src"))


def extract_iframe(html: Column) -> Column:
    return _all(html, _attribute("iframe", "src"))


def extract_link(html: Column) -> Column:
    """(url, type) of link tags by rel: stylesheet, icon, and preload by its as."""
    tags = F.transform(_all(html, r"(?i)<link\b[^>]*>", 0), lambda tag: F.struct(_get(tag, "href").alias("url"), _link_type(tag).alias("type")))
    return F.filter(tags, lambda x: x["type"].isNotNull() & (x["url"] != ""))


def _get(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, r"(?i)" + ATTR.format(name), 1)


def _link_type(tag: Column) -> Column:
    rel, as_ = F.lower(_get(tag, "rel")), F.lower(_get(tag, "as"))
    preload = F.when(as_ == "font", "font").when(as_ == "image", "image").when(as_ == "style", "css").when(as_ == "script", "js")
    return F.when(rel.contains("stylesheet"), "css").when(rel.contains("icon"), "image").when(rel.contains("preload"), preload)


def extract_media(html: Column) -> Column:
    """(url, type): posters are images, sources of video, audio and source tags other."""
    kind = lambda urls, name: F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit(name).alias("type")))
    return F.concat(kind(_all(html, _attribute("video", "poster")), "image"), *[kind(_all(html, _attribute(t, "src")), "other") for t in ("video", "audio", "source")])


def parse_srcset(value: Column) -> Column:
    """(url, descriptor) of each candidate; commas inside a url stay, those at its end go."""
    pairs = F.arrays_zip(_all(value, SRCSET, 1).alias("url"), _all(value, SRCSET, 2).alias("descriptor"))
    return F.transform(pairs, lambda p: F.struct(p["url"].alias("url"), F.trim(F.coalesce(p["descriptor"], F.lit(""))).alias("descriptor")))


def join_srcset(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda c: F.trim(F.concat(c["url"], F.lit(" "), c["descriptor"]))), ", ")


def extract_srcset(html: Column) -> Column:
    sets = _all(html, r"(?i)<(?:img|source)\b[^>]*?" + ATTR.format("srcset"))
    return F.transform(F.flatten(F.transform(sets, parse_srcset)), lambda c: c["url"])


def extract_inline_css_urls(html: Column) -> Column:
    return F.filter(_all(F.replace(html, F.lit("&quot;"), F.lit('"')), CSS_URL), lambda u: ~_skippable(u))


def extract_css_urls(css: Column) -> Column:
    """Distinct targets of @import and url(), imports first."""
    return F.filter(F.array_distinct(F.concat(_all(css, CSS_IMPORT), _all(css, CSS_URL))), lambda u: ~_skippable(u))


def _skippable(url: Column) -> Column:
    low = F.lower(F.trim(url))
    return (low == "") | low.startswith("#") | low.startswith("%23") | low.rlike(r"^(data|blob|javascript|mailto|about):")


def is_fetchable(url: Column) -> Column:
    """An http(s) url of a public-looking host without template marks."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    plain = F.coalesce(F.try_url_decode(low), low)
    host = F.regexp_extract(low, r"^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return low.rlike(r"^https?://") & ~plain.contains("${") & ~plain.contains("{{") & ~host.isin("localhost", "127.0.0.1", "") & ~host.rlike(r"""[\s"'<>(){}|\\^`]""")


def guess_type(url: Column) -> Column:
    """By what the url contains: font, image, html, else other."""
    low = F.lower(url)
    has = lambda names: low.rlike(r"\.(" + "|".join(names) + ")")
    return F.when(has(FONTS), "font").when(has(IMAGES), "image").when(has(("html", "htm")), "html").otherwise("other")


def suffix_type(url: Column) -> Column:
    """By the ending of the path: css, js, font, image, html, else other."""
    path = F.lower(F.regexp_replace(url, r"(?s)[?#].*$", ""))
    ends = lambda *names: path.rlike(r"\.(" + "|".join(names) + ")$")
    return F.when(ends("css"), "css").when(ends("js", "mjs"), "js").when(ends(*FONTS), "font").when(ends(*IMAGES), "image").when(ends("html", "htm"), "html").otherwise("other")


def join_url(base: str, ref: str) -> str:
    """RFC 3986 resolution; data urls and fragments, and what can't be read, stay as they are."""
    ref = (ref or "").strip()
    if not ref or ref.startswith("#") or ref.lower().startswith("data:"):
        return ref
    try:
        parts = urlsplit(urljoin(base or "", ref))
        if parts.scheme in ("http", "https"):
            path = urlsplit(urljoin(f"{parts.scheme}://{parts.netloc}/", parts.path or "/")).path
            while path.startswith("/../"):
                path = path[3:]
            parts = parts._replace(path=path if parts.path else parts.path)
        return urlunsplit(parts)
    except ValueError:
        return ref


@F.pandas_udf(StringType())
def resolve_url(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else join_url(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


def found_references(pages: DataFrame) -> DataFrame:
    """page_id, url (of the page), raw, type and ord of every reference in html, as it stands there."""
    html = F.col("html")
    plain = lambda urls, name: F.transform(urls, lambda u: F.struct(u.alias("url"), F.lit(name).alias("type")))
    typed = lambda urls: F.transform(urls, lambda u: F.struct(u.alias("url"), guess_type(u).alias("type")))
    parts = F.concat(plain(extract_img(html), "image"), plain(extract_script(html), "js"), plain(extract_iframe(html), "html"), extract_link(html), plain(extract_srcset(html), "image"), extract_media(html), typed(extract_inline_css_urls(html)))
    return pages.select("page_id", F.col("url"), F.posexplode(parts).alias("ord", "ref")).select("page_id", "url", "ord", F.col("ref.url").alias("raw"), F.col("ref.type").alias("type"))


def extract_resources(pages: DataFrame) -> DataFrame:
    """page_id, resource_url and type: every fetchable reference resolved against its page; the last type of a url wins.

    References that are absolute and without dot segments aren't resolved.
    """
    rows = found_references(pages)
    plain = F.col("raw").rlike(r"^https?://[^/?#]+/") & ~F.col("raw").contains("/.")
    # the pages are scanned once; the UDF gets a null for what needs no resolving, and returns one at once
    target = F.coalesce(F.when(plain, F.col("raw")), resolve_url(F.col("url"), F.when(~plain, F.col("raw"))))
    rows = rows.withColumn("target", target)
    return rows.where(is_fetchable(F.col("target"))).groupBy("page_id", F.col("target").alias("resource_url")).agg(F.max_by("type", "ord").alias("type"))


def css_subresources(sheets: DataFrame, css: DataFrame) -> DataFrame:
    """The second hop: page_id and the targets of its stylesheets (page_id, css_url), resolved against these; css: css_url, css."""
    rows = sheets.join(css, "css_url").select("page_id", "css_url", F.explode(extract_css_urls(F.col("css"))).alias("raw"))
    rows = rows.withColumn("resource_url", resolve_url("css_url", "raw")).where(is_fetchable(F.col("resource_url")))
    return rows.select("page_id", "resource_url", suffix_type(F.col("resource_url")).alias("type")).distinct()


def viewport_meta(html: Column, width: Column, height: Column, dpr: Column) -> Column:
    """html with a snapweave-viewport meta after <head>; the same html where a size isn't positive."""
    meta = F.concat(F.lit('<meta name="snapweave-viewport" content="'), F.concat_ws(",", width.cast("string"), height.cast("string"), dpr.cast("string")), F.lit('">'))
    bare = F.regexp_replace(html, r'<meta name="snapweave-viewport" content="[^"]*">', "")
    return F.when((width > 0) & (height > 0), F.regexp_replace(bare, F.lit(r"(?i)(<head\b[^>]*>)"), F.concat(F.lit("$1"), meta))).otherwise(html)


def read_viewport(html: Column) -> Column:
    parts = F.split(F.regexp_extract(html, r'<meta name="snapweave-viewport" content="([^"]*)">', 1), ",")
    at = lambda k: F.get(parts, F.lit(k))
    return F.struct(at(0).try_cast("int").alias("width"), at(1).try_cast("int").alias("height"), at(2).try_cast("double").alias("dpr"))
