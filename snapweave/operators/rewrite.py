"""Rewriting jobs: references made absolute, mapped to archive paths, and frames put in place of their sources."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from .extract import SRCSET, join_srcset, join_url, parse_srcset

_ATTR = re.compile(r"""(?i)(\s(?:src|href|poster|data|action)\s*=\s*)(["'])([^"']*)\2""")
_SETS = re.compile(r"""(?i)(\s(?:srcset|imagesrcset)\s*=\s*)(["'])([^"']*)\2""")
_CSS = re.compile(r"""(?i)url\(\s*(&quot;|["']?)([^"')]+?)\1\s*\)""")
_IMPORT = re.compile(r"""(?i)(@import\s+)(["'])([^"']+)\2""")
_CANDIDATE = re.compile(SRCSET)
_ORIGIN = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+")
_DOUBLE = re.compile(r"""(?i)(\s(?:src|href|poster)\s*=\s*["'])//(?=[^/"'])""")
_ROOTED = re.compile(r"""(?i)(\s(?:src|href|poster)\s*=\s*["'])/(?!/|archive/)""")
_KEEP = re.compile(r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:|//|#|$)")


def each_reference(html: str, change) -> str:
    """html with every reference replaced by change(reference), in attributes, srcset candidates and url()."""
    html = _ATTR.sub(lambda m: f"{m[1]}{m[2]}{change(m[3])}{m[2]}", html)
    html = _SETS.sub(lambda m: f"{m[1]}{m[2]}{srcset(m[3], change)}{m[2]}", html)
    return _CSS.sub(lambda m: f"url({m[1]}{change(m[2])}{m[1]})", html)


def srcset(value: str, change) -> str:
    return ", ".join(f"{change(u)} {(d or '').strip()}".strip() for u, d in _CANDIDATE.findall(value))


def absolute(html: str, base: str) -> str:
    """Relative references against the page; absolute, rooted, protocol-relative, fragment and other schemes stay."""

    def change(ref: str) -> str:
        plain = entities.unescape(ref)
        return ref if _KEEP.match(plain) or plain.startswith("/") else join_url(base, plain)

    return each_reference(html, change)


def mapped(html: str, base: str, paths: dict[str, str], prefix: str) -> str:
    """Each reference whose resolved url is in `paths`, whichever way it is written, becomes prefix + url, or /archive/<path> without prefix."""

    def change(ref: str) -> str:
        plain = entities.unescape(ref).strip()
        if plain.startswith("/archive/") or plain.startswith("#") or not plain:
            return ref
        target = join_url(base, plain)
        if target not in paths:
            return ref
        return prefix + target if prefix else "/archive/" + paths[target]

    return each_reference(html, change)


def archive_prefix(page_id: Column, timestamp: Column) -> Column:
    return F.concat(F.lit("/archive/"), page_id.cast("string"), F.lit("/"), timestamp, F.lit("mp_/"))


@F.pandas_udf(StringType())
def resolve_relative_refs(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else absolute(h, b) for h, b in zip(html, base, strict=True)], dtype=object)


def rewrite_srcset(value: Column, paths: Column, prefix: Column) -> Column:
    """A srcset value whose urls that are keys of the map `paths` stand behind prefix; descriptors stay. Native."""
    kept = F.transform(parse_srcset(value), lambda c: F.struct(F.when(F.map_contains_key(paths, c["url"]), F.concat(prefix, c["url"])).otherwise(c["url"]).alias("url"), c["descriptor"].alias("descriptor")))
    return join_srcset(kept)


@F.pandas_udf(StringType())
def _mapped(html: pd.Series, base: pd.Series, urls: pd.Series, paths: pd.Series, prefix: pd.Series) -> pd.Series:
    rows = zip(html, base, urls, paths, prefix, strict=True)
    return pd.Series([None if h is None else mapped(h, b, dict(zip(u if u is not None else (), p if p is not None else (), strict=True)), x or "") for h, b, u, p, x in rows], dtype=object)


def _rewritten(pages: DataFrame, links: DataFrame, change, prefix: Column) -> DataFrame:
    """pages with html changed by their links, one path for a url, the smallest. A page's links are gathered next to its html: as many as the page has references."""
    one = links.groupBy("page_id", "resource_url").agg(F.min("path").alias("path"))
    held = one.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("resource_url", "path"))).alias("links"))
    rows = pages.join(held, "page_id", "left")
    return rows.withColumn("html", change("html", "url", F.transform("links", lambda x: x["resource_url"]), F.transform("links", lambda x: x["path"]), prefix)).select(pages.columns)


def rewrite_html(pages: DataFrame, links: DataFrame, with_page: bool = True) -> DataFrame:
    """pages (page_id, url, html, timestamp) rewritten by links (page_id, resource_url, path); one path per url, the smallest."""
    return _rewritten(pages, links, _mapped, archive_prefix(F.col("page_id"), F.col("timestamp")) if with_page else F.lit(""))


def rewrite_unmapped(html: Column, page_id: Column, timestamp: Column, url: Column) -> Column:
    """References to /path and //host that are left become archive urls on the page's origin; /archive/ stays."""
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    prefix = archive_prefix(page_id, timestamp)
    html = F.regexp_replace(html, F.lit(r"""(?i)(\s(?:src|href|poster)\s*=\s*["'])//(?=[^/"'])"""), F.concat(F.lit("$1"), prefix, F.lit("https://")))
    return F.regexp_replace(html, F.lit(r"""(?i)(\s(?:src|href|poster)\s*=\s*["'])/(?!/|archive/)"""), F.concat(F.lit("$1"), prefix, origin, F.lit("/")))


def css_mapped(css: str, base: str, paths: dict[str, str], prefix: str) -> str:
    change = lambda u: prefix + paths[t] if (t := join_url(base, u)) in paths else u
    css = _IMPORT.sub(lambda m: f"{m[1]}{m[2]}{change(m[3])}{m[2]}", css)
    return _CSS.sub(lambda m: f"url({m[1]}{change(m[2])}{m[1]})", css)


def rewrite_css(sheets: DataFrame, links: DataFrame, prefix: str = "/archive/") -> DataFrame:
    """sheets (page_id, css_url, css) with targets that the page has (links: page_id, resource_url, path) pointed at their files; quotes stay."""
    held = links.groupBy("page_id").agg(F.collect_list(F.struct("resource_url", "path")).alias("links"))

    @F.pandas_udf(StringType())
    def write(css: pd.Series, base: pd.Series, urls: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else css_mapped(c, b, dict(zip(u if u is not None else (), p if p is not None else (), strict=True)), prefix) for c, b, u, p in zip(css, base, urls, paths, strict=True)], dtype=object)

    return sheets.join(held, "page_id", "left").withColumn("css", write("css", "css_url", F.transform("links", lambda x: x["resource_url"]), F.transform("links", lambda x: x["path"]))).select(sheets.columns)


def normalize_dots(html: str) -> str:
    """Absolute urls in src, href and poster without their dot segments."""
    return _ATTR.sub(lambda m: f"{m[1]}{m[2]}{join_url(m[3], m[3])}{m[2]}" if ".." in m[3] and urlsplit(m[3]).scheme in ("http", "https") else m[0], html)


@F.pandas_udf(StringType())
def normalize_html_urls(html: pd.Series, base: pd.Series) -> pd.Series:
    """As normalize_dots where base is null; else all references made absolute against it."""
    out = [None if h is None else normalize_dots(h) if b is None else each_reference(h, lambda r, b=b: r if re.match(r"(?i)^(?:[a-z][a-z0-9+.-]*:|#|$)", r) else join_url(b, entities.unescape(r))) for h, b in zip(html, base, strict=True)]
    return pd.Series(out, dtype=object)


_FRAME = re.compile(r"(?is)<iframe\b[^>]*>")
_KEY = re.compile(r"""(?i)\sdata-snapweave-frame-key\s*=\s*["']([^"']*)["']""")


def _without(tag: str, *names: str) -> str:
    for n in names:
        tag = re.sub(rf"""(?i)\s{n}\s*=\s*(?:"[^"]*"|'[^']*')""", "", tag)
    return tag


def mark_frames(captures: DataFrame, frames: DataFrame) -> DataFrame:
    """Parents' html (capture_id, html) with each frame marked. frames: capture_id, position (of the tag), key, url, status.

    A captured frame gets its key, its first source and the frame's url as source; others get their status and lose the source; srcdoc goes.
    """
    held = frames.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("position", "key", "url", "status"))).alias("frames"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for capture, text, found in rows.itertuples(index=False):
                by = {f["position"]: f for f in (found if found is not None else [])}
                count = iter(range(1 << 30))

                def one(m: re.Match, by=by, count=count) -> str:
                    f = by.get(next(count))
                    if f is None:
                        return m[0]
                    source = re.search(r"""(?i)\ssrc\s*=\s*["']([^"']*)["']""", m[0])
                    bare = _without(m[0], "src", "srcdoc")[:-1].rstrip("/ ")
                    bare += f' data-original-src="{source[1]}"' if source else ""
                    return bare + (f' data-snapweave-frame-key="{f["key"]}" src="{f["url"]}">' if f["status"] == "ok" else f' data-frame-status="{f["status"]}">')

                out.append((capture, _FRAME.sub(one, text or "")))
            yield pd.DataFrame(out, columns=["capture_id", "html"])

    return captures.select("capture_id", "html").join(held, "capture_id", "left").mapInPandas(run, "capture_id long, html string")


def circular(edges: list[tuple[str, str]]) -> list[bool]:
    """Which edges (from, to) of a graph lie on a cycle: those within a strongly connected part. Linear in the edges, however deep they lead."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    seen: dict[str, int] = {}  # order in which nodes are met
    low: dict[str, int] = {}  # the earliest open node that a node leads back to
    part: dict[str, int] = {}
    open_: list[str] = []
    for root in after:
        if root in seen:
            continue
        way = [(root, iter(after[root]))]
        seen[root] = low[root] = len(seen)
        open_.append(root)
        while way:
            node, rest = way[-1]
            for to in rest:
                if to not in seen:
                    seen[to] = low[to] = len(seen)
                    open_.append(to)
                    way.append((to, iter(after.get(to, ()))))
                    break
                if to not in part:
                    low[node] = min(low[node], seen[to])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[node])
                if low[node] == seen[node]:
                    while node not in part:
                        part[open_.pop()] = seen[node]
    return [part[a] == part[b] for a, b in edges]


@F.pandas_udf(ArrayType(BooleanType()))
def _circular(parents: pd.Series, children: pd.Series) -> pd.Series:
    return pd.Series([circular(list(zip(p, c, strict=True))) for p, c in zip(parents, children, strict=True)])


def resolve_frame_tree(frames: DataFrame, prefix: Column) -> DataFrame:
    """frames (capture_id, key, url, html) whose nested frame tags point at the archived child; a tag that is part of a cycle keeps its source.

    Edges are keys found in html, without the html. A capture is one request of at most 32 MiB, so its edges are looked at together, in
    one pass that is linear in them.
    """
    keys = F.regexp_extract_all("html", F.lit(r"""data-snapweave-frame-key\s*=\s*["']([^"']*)["']"""), 1)
    edges = frames.select("capture_id", F.col("key").alias("parent"), F.explode(F.array_distinct(keys)).alias("child"))
    edges = edges.join(frames.select("capture_id", F.col("key").alias("child"), F.col("url").alias("child_url")), ["capture_id", "child"])
    whole = edges.where("parent is not null").groupBy("capture_id").agg(F.collect_list(F.struct("parent", "child", "child_url")).alias("e"))
    marked = whole.select("capture_id", F.explode(F.arrays_zip("e", _circular(F.col("e.parent"), F.col("e.child")).alias("on_cycle"))).alias("m"))
    good = marked.where("not m.on_cycle").select("capture_id", "m.e.*")
    held = good.groupBy("capture_id", F.col("parent").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("child", F.concat(prefix, F.col("child_url"))))).alias("to"))

    @F.pandas_udf(StringType())
    def write(html: pd.Series, keys: pd.Series, urls: pd.Series) -> pd.Series:
        out = []
        for text, k, u in zip(html, keys, urls, strict=True):
            to = dict(zip(k if k is not None else (), u if u is not None else (), strict=True))
            one = lambda m, to=to: f'{_without(m[0], "src")[:-1].rstrip("/ ")} src="{to[x[1]]}">' if (x := _KEY.search(m[0])) and x[1] in to else m[0]
            out.append(None if text is None else _FRAME.sub(one, text))
        return pd.Series(out, dtype=object)

    rows = frames.join(held, ["capture_id", "key"], "left")
    return rows.withColumn("html", write("html", F.map_keys("to"), F.map_values("to"))).select(frames.columns)


def unmapped(html: str, base: str, prefix: str) -> str:
    """rewrite_unmapped for one page."""
    origin = _ORIGIN.match(base or "")
    html = _DOUBLE.sub(lambda m: f"{m[1]}{prefix}https://", html)
    return _ROOTED.sub(lambda m: f"{m[1]}{prefix}{origin[0] if origin else ''}/", html)


@F.pandas_udf(StringType())
def _whole(html: pd.Series, base: pd.Series, urls: pd.Series, paths: pd.Series, prefix: pd.Series) -> pd.Series:
    out = []
    for h, b, u, p, x in zip(html, base, urls, paths, prefix, strict=True):
        held = dict(zip(u if u is not None else (), p if p is not None else (), strict=True))
        out.append(None if h is None or b is None or x is None else unmapped(mapped(absolute(h, b), b, held, x), b, x))
    return pd.Series(out, dtype=object)


def rewrite_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """The whole job for pages (page_id, url, html, timestamp) and links (page_id, resource_url, path): resolved, mapped and the rest rewritten in one pass over a page."""
    return _rewritten(pages, links, _whole, archive_prefix(F.col("page_id"), F.col("timestamp")))
