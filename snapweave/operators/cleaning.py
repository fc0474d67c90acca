"""Cleaning of pages for replay: one pass in Arrow batches over the tags of a page, in a fixed order of steps."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.tags import Attribute, Piece, Tag, element_ends, scan, without, write

# Ids of overlays, shapes that draw themselves, the mark of animated elements, and what moves or hides these.
OVERLAYS = {"placeholder", "ScriptLoadFailure"}
SHAPES = {"path", "circle", "line", "polyline", "polygon", "rect", "ellipse"}
ANIMATED = "data-animate"
MOVES = {"opacity", "transform", "translate", "rotate", "scale", "stroke-dashoffset"}


def drop_active(pieces: list[Piece]) -> list[Piece]:
    """No base, no content security policy, no scripts and what stands in for them, no handlers, script links or lazy loading."""

    def attribute(a: Attribute) -> str:
        if a.value is not None and a.quoted and (re.fullmatch(r"on\w+", a.name) or (a.name == "loading" and a.value.lower() == "lazy")):
            return ""
        if a.name == "href" and a.quoted and (a.value or "").lower().startswith("javascript:"):
            return a.raw[: len(a.raw) - len(a.raw.lstrip())] + 'href="#"'
        return a.raw

    def kept(p: Piece) -> bool:
        if isinstance(p, str) or p.ends:
            return True
        return not (p.name == "base" or (p.name == "meta" and (p.get("http-equiv") or "").lower() == "content-security-policy"))

    out = [p for p in without(without(pieces, {"script"}), {"noscript"}) if kept(p)]
    for p in out:
        if isinstance(p, Tag) and not p.ends:
            p.edited(attribute)
    return out


def fix_videos(pieces: list[Piece]) -> list[Piece]:
    """No video starts by itself; one with a source can be started, one without isn't shown."""
    ends = element_ends(pieces, {"video"})
    out: list[Piece] = []
    for k, p in enumerate(pieces):
        out.append(p)
        if not isinstance(p, Tag) or p.name != "video" or p.ends or not (k in ends or p.closed):
            continue
        p.edited(lambda a: "" if a.name == "autoplay" else a.raw)
        inside = pieces[k + 1 : ends[k]] if k in ends else []
        source = any(isinstance(x, Tag) and x.get("src") is not None for x in [p, *inside])
        more = "" if source and p.get("controls") is not None else " controls" if source else ' style="display:none"'
        if k not in ends:
            p.raw = p.raw[:-2].rstrip() + more + "></video>"
        else:
            p.raw = p.raw[:-1] + more + ">"
    return out


def drop_frames(pieces: list[Piece]) -> list[Piece]:
    """No frames, objects and embeds."""
    return [p for p in without(pieces, {"frame", "object"}, balanced=True) if isinstance(p, str) or p.name not in ("frame", "embed")]


def drop_picture_sources(pieces: list[Piece]) -> list[Piece]:
    inside = [range(a, b) for a, b in element_ends(pieces, {"picture"}).items()]
    gone = {k for r in inside for k in r if isinstance(pieces[k], Tag) and pieces[k].name == "source"}
    return [p for k, p in enumerate(pieces) if k not in gone]


def drop_overlays(pieces: list[Piece]) -> list[Piece]:
    """No div with the id of an overlay, to the end tag that balances it."""
    return without(pieces, {"div"}, lambda tag: tag.get("id") in OVERLAYS, balanced=True)


def fix_nested_buttons(pieces: list[Piece]) -> list[Piece]:
    """A button inside a button becomes a span."""
    depth = 0
    for p in pieces:
        if isinstance(p, Tag) and p.name == "button":
            depth += not p.ends
            if depth > 1:
                depth -= p.ends
                p.renamed("span")
            else:
                depth = max(0, depth - p.ends)
    return pieces


def fix_hidden_animation(pieces: list[Piece]) -> list[Piece]:
    """Elements that a script would have faded in are shown where they end up; what isn't hidden by its opacity stays as it is."""

    def style(a: Attribute) -> str:
        if a.name != "style" or not a.value or not a.quoted:
            return a.raw
        rules = [(r.partition(":")[0].strip().lower(), r.partition(":")[2].strip(), r.strip()) for r in a.value.split(";")]
        if not any(n == "opacity" and re.fullmatch(r"0+(\.0*)?%?", v) for n, v, _ in rules):
            return a.raw
        kept = "; ".join(r for n, _, r in rules if r and n not in MOVES)
        return a.raw.replace(a.value, kept, 1) if kept else ""

    for p in pieces:
        if isinstance(p, Tag) and not p.ends and (p.name in SHAPES or any(a.name == ANIMATED or a.name.startswith(ANIMATED + "-") for a in p.attributes())):
            p.edited(style)
    return pieces


_URL = r"""(?i)url\(\s*(?:&quot;|["'])?\s*(?:https?:)?//[^'")\s]+(?:["'])?\s*\)"""
_IMPORT = r"""(?i)@import\s+(?:url\()?["']?(?:https?:)?//[^"';)]+["']?\)?[^;]*;?"""


def drop_external_css_refs(html: Column) -> Column:
    """No url() and @import of other hosts."""
    return F.regexp_replace(F.regexp_replace(html, F.lit(_URL), F.lit('url("")')), F.lit(_IMPORT), F.lit(""))


def _without_external_css(html: str) -> str:
    return re.sub(_IMPORT, "", re.sub(_URL, 'url("")', html))


THIRD_PARTY = [
    r"""(?i)<link\b[^>]*rel\s*=\s*["']?(?:preconnect|dns-prefetch)["']?[^>]*>""",
    r"""(?i)<link\b[^>]*href\s*=\s*["'](?:https?:)?//(?:fonts\.[^"'/]+|[^"'/]*cdn[^"'/]*)/[^"']*["'][^>]*>""",
    r"""(?is)<script\b[^>]*src\s*=\s*["'](?:https?:)?//[^"'/]*cdn[^"'/]*/[^"']*["'][^>]*>\s*</script>""",
]


def drop_third_party(html: Column) -> Column:
    """No hints to connect, no fonts, styles and scripts of font hosts and CDNs."""
    for pattern in THIRD_PARTY:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(""))
    return html


#: Steps by name, each from pieces to pieces.
STEPS: dict[str, Callable[[list[Piece]], list[Piece]]] = {
    "drop_active": drop_active, "fix_video": fix_videos, "drop_frames": drop_frames, "drop_picture_sources": drop_picture_sources,
    "drop_overlays": drop_overlays, "fix_nested_buttons": fix_nested_buttons, "fix_hidden_animation": fix_hidden_animation,
}


def cleaned(html: str, *names: str) -> str:
    pieces = scan(html)
    for n in names:
        pieces = STEPS[n](pieces)
    return write(pieces)


def sanitized(html: str) -> str:
    """All steps in their order; references of styles in the middle, as they need no tags."""
    html = cleaned(html, "drop_active", "fix_video", "drop_frames", "drop_picture_sources")
    return cleaned(_without_external_css(html), "drop_overlays", "fix_nested_buttons", "fix_hidden_animation")


def _column(change: Callable[[str], str]):
    @F.pandas_udf(StringType())
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else change(h))

    return run


def cleaning_step(*names: str):
    """Some of the steps by themselves, as a function of an html column."""
    return _column(lambda h: cleaned(h, *names))


def drop_embeds(html: Column) -> Column:
    """Frames, objects and embeds out, and the sources of pictures."""
    return cleaning_step("drop_frames", "drop_picture_sources")(html)


def sanitize_html(html: Column) -> Column:
    """All cleaning steps in their order, in one pass; null stays null."""
    return _column(sanitized)(html)


def sanitize_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("html", sanitize_html(F.col("html")))
