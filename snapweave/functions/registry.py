"""Functions for SQL: Python UDFs by name, and SQL functions for what needs no Python."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators import extract, text

# Names of temporary SQL functions and their bodies.
SQL_FUNCTIONS = {
    "extract_domain(url STRING) RETURNS STRING": r"regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/:?#]*)', 1), '[\\[\\]]', '')",
    "content_hash(html STRING) RETURNS STRING": "sha2(html, 256)",
    "escape_html(html STRING) RETURNS STRING": r"""replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'', '&#39;')""",
    "resource_path(hash STRING, kind STRING) RETURNS STRING": "concat('resources/', substring(hash, 1, 2), '/', substring(hash, 3, 2), '/', hash, CASE kind WHEN 'image' THEN '.img' WHEN 'css' THEN '.css' WHEN 'js' THEN '.js' WHEN 'font' THEN '.font' WHEN 'html' THEN '.html' ELSE '.bin' END)",
    "guess_type(url STRING) RETURNS STRING": r"CASE WHEN lower(url) RLIKE '\\.(woff2|woff|ttf|otf|eot)' THEN 'font' WHEN lower(url) RLIKE '\\.(png|jpg|jpeg|gif|webp|svg|ico|bmp|avif)' THEN 'image' WHEN lower(url) RLIKE '\\.(html|htm)' THEN 'html' ELSE 'other' END",
    "is_fetchable(url STRING) RETURNS BOOLEAN": r"coalesce(lower(trim(url)) RLIKE '^https?://' AND NOT contains(coalesce(try_url_decode(lower(url)), url), '{{') AND NOT contains(coalesce(try_url_decode(lower(url)), url), concat('$', '{')) AND regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1) NOT IN ('localhost', '127.0.0.1', ''), false)",
    "highlight_term(body STRING, term STRING) RETURNS STRING": r"""CASE WHEN contains(lower(body), lower(term)) THEN replace(replace(replace(replace(replace(regexp_replace(body, concat('(?iu)\\Q', replace(term, '\\E', '\\E\\\\E\\Q'), '\\E'), '$0'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '', '<mark>'), '', '</mark>') ELSE '' END""",
}


_FLAGS = re.ASCII  # classes as the patterns of columns have them


def _every(pattern: str, html: str, group: int = 1) -> list[str]:
    return [m[group] or "" for m in re.finditer(pattern, html, _FLAGS)]


def _link_type(tag: str) -> str | None:
    at = lambda name: next(iter(_every("(?i)" + extract.ATTR.format(name), tag)), "").lower()
    rel = at("rel")
    if "stylesheet" in rel:
        return "css"
    if "icon" in rel:
        return "image"
    return {"font": "font", "image": "image", "style": "css", "script": "js"}.get(at("as")) if "preload" in rel else None


def references(html: str) -> Iterator[tuple[str, str]]:
    """(url, type) of every reference as it stands in html, in the order of extract.found_references."""
    attribute = lambda tag, name: _every(extract._attribute(tag, name), html)
    for tag, kind in (("img", "image"), ("script", "js"), ("iframe", "html")):
        yield from ((url, kind) for url in attribute(tag, "src"))
    for tag in _every(r"(?i)<link\b[^>]*>", html, 0):
        url, kind = next(iter(_every("(?i)" + extract.ATTR.format("href"), tag)), ""), _link_type(tag)
        if url and kind:
            yield url, kind
    for value in _every(r"(?i)<(?:img|source)\b[^>]*?" + extract.ATTR.format("srcset"), html):
        yield from ((url, "image") for url in _every(extract.SRCSET, value))
    yield from ((url, "image") for url in attribute("video", "poster"))
    for tag in ("video", "audio", "source"):
        yield from ((url, "other") for url in attribute(tag, "src"))
    for url in _every(extract.CSS_URL, html.replace("&quot;", '"')):
        low = url.strip(" ").lower()
        if low and not low.startswith(("#", "%23")) and not re.match(r"(data|blob|javascript|mailto|about):", low):
            yield url, next((kind for kind, ends in (("font", extract.FONTS), ("image", extract.IMAGES), ("html", ("html", "htm"))) if re.search(r"\.(" + "|".join(ends) + ")", url.lower())), "other")


def fetchable(url: str) -> bool:
    """extract.is_fetchable of one url."""
    low = url.strip(" ").lower()
    try:
        plain = unquote_plus(low, errors="strict") if not re.search(r"%(?![0-9a-f]{2})", low) else low
    except UnicodeDecodeError:
        plain = low
    host = re.match(r"https?://(?:[^/?#@]*@)?([^/?#:]*)", low)
    return bool(host) and "${" not in plain and "{{" not in plain and host[1] not in ("localhost", "127.0.0.1", "") and not re.search(r"""[\s"'<>(){}|\\^`]""", host[1], _FLAGS)


@udtf(returnType="ord int, url string, type string")
class ExtractResources:
    """extract_resources(html, page_url) as a lateral table: each fetchable target of the page once, with its last type and that one's place."""

    def eval(self, html: str, page_url: str) -> Iterator[Row]:
        last: dict[str, tuple[int, str]] = {}
        for k, (raw, kind) in enumerate(references(html or "")):
            target = raw if re.match(r"https?://[^/?#]+/", raw) and "/." not in raw else extract.join_url(page_url, raw)
            if fetchable(target):
                last[target] = (k, kind)
        for url, (k, kind) in last.items():
            yield Row(ord=k, url=url, type=kind)


def register_functions(spark: SparkSession) -> None:
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("resolve_url", extract.resolve_url)
    spark.udf.register("body_text", text.body_text)
    spark.udtf.register("extract_resources", ExtractResources)
