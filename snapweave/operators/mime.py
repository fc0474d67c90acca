"""Content types by extension, by the first bytes, and by what a text looks like."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types by extension.
TYPES = {
    "css": "text/css", "js": "application/javascript", "mjs": "application/javascript", "json": "application/json", "html": "text/html", "htm": "text/html", "xml": "application/xml",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "ico": "image/x-icon", "avif": "image/avif", "bmp": "image/bmp",
    "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "eot": "application/vnd.ms-fontobject", "mp4": "video/mp4", "webm": "video/webm", "mp3": "audio/mpeg", "txt": "text/plain",
}
OCTETS = "application/octet-stream"


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))


def _by(ext: Column, keep: str = "") -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*((k, v) for k, v in TYPES.items() if v.startswith(keep)))])
    return F.try_element_at(table, ext)


def content_type_by_path(path: Column) -> Column:
    return F.coalesce(_by(extension(path)), F.lit(OCTETS))


def content_type(kind: Column, url: Column, path: Column) -> Column:
    """css, js and html are fixed; images by the url, then the path; fonts by extension, else woff2; others by path, ?format=, url."""
    form = F.lower(F.regexp_extract(url, r"[?&]format=([A-Za-z0-9]+)", 1))
    other = F.coalesce(_by(extension(path)), _by(form), _by(extension(url)), F.lit(OCTETS))
    image = F.coalesce(_by(extension(url), "image/"), _by(extension(path), "image/"), _by(form, "image/"), F.lit("image/jpeg"))
    font = F.coalesce(F.when(extension(url).isin("woff", "woff2", "ttf", "otf", "eot"), _by(extension(url))), F.when(extension(path).isin("woff", "woff2", "ttf", "otf", "eot"), _by(extension(path))), F.lit("font/woff2"))
    return F.when(kind == "css", "text/css").when(kind == "js", "application/javascript").when(kind == "html", "text/html").when(kind == "image", image).when(kind == "font", font).otherwise(other)


def font_magic(content: Column) -> Column:
    """Font type from the first 36 bytes; null if they are of none."""
    first = F.hex(F.substring(content, 1, 4))
    named = F.create_map(*[F.lit(x) for x in ("774F4646", "font/woff", "774F4632", "font/woff2", "4F54544F", "font/otf", "74727565", "font/ttf", "00010000", "font/ttf")])
    return F.coalesce(F.try_element_at(named, first), F.when(F.hex(F.substring(content, 35, 2)) == "4C50", "application/vnd.ms-fontobject"))


def looks_like_html(url: Column, content: Column) -> Column:
    path = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)[?#].*$", ""))
    by_url = path.rlike(r"\.html?$") | path.contains("/html/") | (path.contains("cgi-bin") & path.rlike("html|iframe"))
    return by_url | F.coalesce(F.lower(F.ltrim(F.substring(content, 1, 512))).rlike(r"^\s*(<!doctype html|<html|<head|<body|<!--)"), F.lit(False))
