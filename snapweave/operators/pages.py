"""Reads over the snapshot catalog: lists, search with marks and snippets, timelines, neighbours, favourites."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIVITY = "coalesce(last_visited, captured_at)"
LIST_COLUMNS = ["id", "url", "title", "content_hash", "captured_at", "first_visited", "last_visited", "domain", "snapshot_state"]


def date_range_filter(start: str | None = None, end: str | None = None) -> Column:
    """captured_at from the first day to the last, both included; days as YYYY-MM-DD, anything else is an error."""
    for day in (start, end):
        if day is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
            raise ValueError(f"not a day as YYYY-MM-DD: {day!r}")
    out = F.lit(True)
    if start:
        out &= F.col("captured_at") >= F.lit(start).cast("timestamp_ntz")
    if end:
        out &= F.col("captured_at") < F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return out


def domain_filter(domain: str | None) -> Column:
    """The domain or one below it; the name is taken literally."""
    return F.lit(True) if not domain else (F.col("domain") == domain) | F.col("domain").endswith("." + domain)


def check_page(limit: int = 100, offset: int = 0) -> tuple[int, int]:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be from 1 to 1000 and offset not negative")
    return limit, offset


def newest(pages: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    limit, offset = check_page(limit, offset)
    return pages.orderBy(F.expr(ACTIVITY).desc(), F.col("id").desc()).offset(offset).limit(limit)


def list_pages(pages: DataFrame, limit: int = 100, offset: int = 0, start: str | None = None, end: str | None = None, domain: str | None = None) -> DataFrame:
    return newest(pages.where(date_range_filter(start, end) & domain_filter(domain)), limit, offset).select(LIST_COLUMNS)


def count_pages(pages: DataFrame, start: str | None = None, end: str | None = None, domain: str | None = None) -> DataFrame:
    return pages.where(date_range_filter(start, end) & domain_filter(domain)).agg(F.count("*").alias("total"))


def paginate(pages: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the list with total, limit and offset on every row."""
    total = pages.agg(F.count("*").alias("total"))
    return newest(pages, limit, offset).select("id").join(F.broadcast(total)).withColumns({"limit": F.lit(limit), "offset": F.lit(offset)})


def after(pages: DataFrame, activity, id_: int, limit: int = 100) -> DataFrame:
    """Keyset form of a deep page: the rows that come after (activity, id) in the list's order."""
    a = F.expr(ACTIVITY)
    return newest(pages.where((a < activity) | ((a == activity) & (F.col("id") < id_))), limit)


def favorite_flags(ids: DataFrame, favorites: DataFrame) -> DataFrame:
    """id and is_favorite for each row of ids."""
    return ids.join(favorites.select(F.col("page_id").alias("id"), F.lit(True).alias("_f")).distinct(), "id", "left").select("id", F.col("_f").isNotNull().alias("is_favorite"))


def get_page(pages: DataFrame, favorites: DataFrame, id_: int) -> DataFrame:
    row = pages.where(F.col("id") == id_).select(LIST_COLUMNS)
    return row.join(favorite_flags(row.select("id"), favorites.where(F.col("page_id") == id_)), "id")


def _term(keyword: str) -> str:
    """The keyword as a literal pattern that knows no case; \\E in it can't end the quote."""
    return r"(?iu)\Q" + keyword.replace(r"\E", r"\E\\E\Q") + r"\E"


def search_filter(keyword: str) -> Column:
    """Is the keyword part of url, title or body text, in any case and literally?"""
    if not keyword:
        raise ValueError("an empty keyword")
    return F.coalesce(*[F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(keyword))), True) for c in ("url", "title", "body_text")], F.lit(False))


def concat_filter(keyword: str) -> Column:
    """As search_filter over the three columns joined by line feeds, so that a keyword may reach across."""
    whole = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("url", "title", "body_text")])
    return F.contains(F.lower(whole), F.lower(F.lit(keyword)))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight_term(text: Column, keyword: str) -> Column:
    """The text escaped, each match in <mark>; empty without a match. U+E000 and U+E001 stand for the marks meanwhile."""
    term = _term(keyword)
    marked = escape_html(F.regexp_replace(text, F.lit(term), F.lit("\ue000$0\ue001")))
    marked = F.replace(F.replace(marked, F.lit("\ue000"), F.lit("<mark>")), F.lit("\ue001"), F.lit("</mark>"))
    return F.when(text.rlike(term), marked).otherwise(F.lit(""))


def search_snippet(text: Column, keyword: str, around: int = 80) -> Column:
    """`around` characters on each side of the first match, dots where cut, all matches inside marked."""
    text = F.coalesce(text, F.lit(""))
    at = F.regexp_instr(text, F.lit(_term(keyword)))
    first = F.greatest(at - around, F.lit(1))
    last = F.least(at + len(keyword) - 1 + around, F.length(text))
    part = highlight_term(F.substring(text, first, last - first + 1), keyword)
    return F.when(at == 0, "").otherwise(F.concat(F.when(first > 1, "...").otherwise(""), part, F.when(last < F.length(text), "...").otherwise("")))


def search_pages(pages: DataFrame, keyword: str, limit: int = 100, offset: int = 0, start: str | None = None, end: str | None = None, domain: str | None = None) -> DataFrame:
    """A page of the matches, newest first. Marks and snippets are made for its rows alone."""
    rows = newest(pages.where(search_filter(keyword) & date_range_filter(start, end) & domain_filter(domain)), limit, offset)
    return rows.select(*LIST_COLUMNS, highlight_term(F.col("url"), keyword).alias("url_highlight"), highlight_term(F.coalesce("title", F.lit("")), keyword).alias("title_highlight"), search_snippet(F.col("body_text"), keyword).alias("snippet"))


def search_count(pages: DataFrame, keyword: str) -> DataFrame:
    return pages.where(search_filter(keyword)).agg(F.count("*").alias("total"))


def timeline(pages: DataFrame, url: str) -> DataFrame:
    rows = pages.where(F.col("url") == url)
    return rows.select(*LIST_COLUMNS, F.count("*").over(Window.partitionBy("url")).alias("total")).orderBy(F.desc("first_visited"), F.desc("id"))


def timeline_changes(pages: DataFrame) -> DataFrame:
    """Of each url from the newest snapshot on: latest, changed (the content differs from the row before), revisited."""
    order = Window.partitionBy("url").orderBy(F.desc("first_visited"), F.desc("id"))
    before = F.lag("content_hash").over(order)
    return pages.select("id", "url", (F.row_number().over(order) == 1).alias("latest"), F.coalesce(before != F.col("content_hash"), F.lit(False)).alias("changed"), (~F.col("first_visited").eqNullSafe(F.col("last_visited"))).alias("revisited"))


def snapshot_neighbors(pages: DataFrame) -> DataFrame:
    """Nearest strictly earlier and later snapshot of the url (of equal times the highest id), and how many it has.

    Times are numbered within a url, so that one row of each is looked at from its neighbours; both frames grow row by row.
    """
    each = pages.groupBy("url", "first_visited").agg(F.max("id").alias("_top"), F.count("*").alias("_n"))
    order = Window.partitionBy("url").orderBy("first_visited")
    each = each.select(F.col("url").alias("_url"), F.col("first_visited").alias("_at"), F.lag("_top").over(order).alias("prev_id"), F.lead("_top").over(order).alias("next_id"), F.sum("_n").over(Window.partitionBy("url")).alias("total"))
    return pages.join(each, F.col("url").eqNullSafe(F.col("_url")) & F.col("first_visited").eqNullSafe(F.col("_at"))).select("id", "url", "prev_id", "next_id", "total")


def favorites_list(pages: DataFrame, favorites: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    limit, offset = check_page(limit, offset)
    rows = pages.join(favorites.select(F.col("page_id").alias("id"), F.col("created_at").alias("favorited_at")), "id")
    return rows.orderBy(F.desc("favorited_at"), F.desc("id")).offset(offset).limit(limit).select(*LIST_COLUMNS, "favorited_at")


def favorites_search(pages: DataFrame, favorites: DataFrame, keyword: str) -> DataFrame:
    """Favourites that match; a blank keyword gives none, one over 200 bytes is an error."""
    if len(keyword.encode()) > 200:
        raise ValueError("the keyword is over 200 bytes")
    rows = pages.join(favorites.select(F.col("page_id").alias("id"), F.col("created_at").alias("favorited_at")), "id")
    return rows.where(search_filter(keyword) if keyword.strip() else F.lit(False)).select(*LIST_COLUMNS, "favorited_at")


def favorites_count(pages: DataFrame, favorites: DataFrame, keyword: str | None = None) -> DataFrame:
    """How many favourites there are, or match the keyword."""
    rows = pages.join(favorites.select(F.col("page_id").alias("id")), "id") if keyword is None else favorites_search(pages, favorites, keyword)
    return rows.agg(F.count("*").alias("total"))


def add_favorites(favorites: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """Favourites with those of `new` (page_id, created_at) whose page exists; the first created_at stays."""
    fresh = new.groupBy("page_id").agg(F.min("created_at").alias("created_at")).join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi")
    return favorites.select("page_id", "created_at").unionByName(fresh.join(favorites, "page_id", "left_anti").select("page_id", "created_at"))


def remove_favorites(favorites: DataFrame, gone: DataFrame) -> DataFrame:
    return favorites.join(gone.select("page_id"), "page_id", "left_anti")
