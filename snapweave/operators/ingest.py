"""Ingest and snapshot lifecycle as DataFrame jobs. Times are arguments, never the clock, so that a run can be repeated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE_COLUMNS = ["id", "url", "title", "content_hash", "captured_at", "first_visited", "last_visited", "domain", "snapshot_state"]


def content_hash(html: Column, frames: Column | None = None) -> Column:
    """SHA-256 over the page and its frames in order of key; each frame's fields stand after a line that names them."""
    if frames is None:
        return F.sha2(html, 256)
    names = ("key", "url", "title", "html")
    ordered = F.array_sort(F.transform(frames, lambda f: F.struct(*[f[n].alias(n) for n in names])))
    parts = F.transform(ordered, lambda f: F.concat(*[F.concat(F.lit(f"\n--frame-{n}--\n"), F.coalesce(f[n], F.lit(""))) for n in names]))
    return F.sha2(F.concat(html, F.array_join(F.coalesce(parts, F.array().cast("array<string>")), "")), 256)


def extract_domain(url: Column) -> Column:
    """Host without user, port or the brackets of an IPv6 address; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1)
    return F.regexp_replace(found, r"[\[\]]", "")


def admissible(url: Column) -> Column:
    """False for browser-internal and file urls and hosts that are local or private; what can't be read as a url is kept."""
    text = F.coalesce(url, F.lit(""))
    scheme, host = F.lower(F.regexp_extract(text, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)), F.lower(extract_domain(text))
    v4 = F.regexp_extract(host, r"^(?:::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    a, b = (F.get(F.split(v4, r"\."), F.lit(k)).try_cast("int") for k in (0, 1))
    private = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    first = F.conv(F.regexp_extract(host, r"^([0-9a-f]{1,4}):", 1), 16, 10).try_cast("int")
    v6 = host.contains(":") & ((host == "::1") | first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF))
    return ~(scheme.isin("file", "about", "chrome", "chrome-extension") | (host == "localhost") | host.endswith(".local") | F.coalesce(private & (v4 != ""), F.lit(False)) | F.coalesce(v6, F.lit(False)))


def dedup_captures(captures: DataFrame, pages: DataFrame) -> DataFrame:
    """Create or touch, one row per (url, content_hash) of captures: page_id (null: new), action, title, first and last capture.

    A ready page is unchanged and only visited again, a pending one is used again as created, a failed one is
    retried under its id, and without a page one is created. Of several pages the best is taken (pick_snapshot).
    """
    key = ["url", "content_hash"]
    new = captures.groupBy(key).agg(F.min_by("title", F.struct("captured_at", "capture_id")).alias("title"), F.min("captured_at").alias("first_visited"), F.max("captured_at").alias("last_visited"), F.count("*").alias("captures"))
    held = pick_snapshot(pages).select(*key, F.col("id").alias("page_id"), F.col("snapshot_state").alias("_state"))
    action = F.when(F.col("_state") == "ready", "unchanged").when(F.col("_state") == "failed", "retry").otherwise("created")
    return new.join(held, key, "left").select(*key, "page_id", action.alias("action"), "title", "first_visited", "last_visited", "captures")


def pick_snapshot(pages: DataFrame) -> DataFrame:
    """The best row of each (url, content_hash): ready before pending before others, then first visited, then id."""
    rank = F.when(F.col("snapshot_state") == "ready", 0).when(F.col("snapshot_state") == "pending", 1).otherwise(2)
    order = F.struct(rank.alias("r"), F.col("first_visited"), F.col("id"))
    best = pages.groupBy("url", "content_hash").agg(F.min_by(F.struct(*pages.columns), order).alias("best"))
    return best.select("best.*")


def new_page_rows(captures: DataFrame) -> DataFrame:
    """Rows of new pages with their defaults; the id is a hash of url and content."""
    key = F.xxhash64("url", "content_hash")
    return captures.select(key.alias("id"), "url", "title", "content_hash", "captured_at", F.col("captured_at").alias("first_visited"), F.col("captured_at").alias("last_visited"), extract_domain(F.col("url")).alias("domain"), F.lit("pending").alias("snapshot_state"))


def recent_capture(captures: DataFrame, within: str) -> DataFrame:
    """Each capture with recent: was the same url captured less than `within` (an interval) before?"""
    order = Window.partitionBy("url").orderBy("captured_at", "capture_id")
    before = F.lag("captured_at").over(order)
    return captures.withColumn("recent", F.coalesce(before > F.col("captured_at") - F.expr(f"INTERVAL {within}"), F.lit(False)))


def apply_updates(pages: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages after updates (id, url, title, content_hash, html_path, body_text, updated_at), and what became of each update.

    An update of another url is rejected, one of a missing page unknown, one of equal content unchanged (it only counts
    as a visit); else the page takes the new values, a null title or body_text keeping the old, and is ready.
    One update per page: see latest_update_wins.
    """
    u = updates.select([F.col(c).alias(f"_u_{c}") for c in updates.columns])
    both = pages.join(u, F.col("id") == F.col("_u_id"), "left")
    fits = F.coalesce(F.col("url") == F.col("_u_url"), F.lit(False))
    changed = fits & ~F.col("content_hash").eqNullSafe(F.col("_u_content_hash"))
    take = {"title": F.coalesce("_u_title", "title"), "body_text": F.coalesce("_u_body_text", "body_text"), "content_hash": F.col("_u_content_hash"), "html_path": F.col("_u_html_path"), "snapshot_state": F.lit("ready")}
    out = both.select([F.when(changed, take[c]).otherwise(F.col(c)).alias(c) if c in take else F.when(fits, F.col("_u_updated_at")).otherwise(F.col(c)).alias(c) if c == "last_visited" else F.col(c) for c in pages.columns])
    told = u.join(pages.select("id", "url", "content_hash"), F.col("id") == F.col("_u_id"), "left")
    action = F.when(F.col("id").isNull(), "unknown").when(F.col("url") != F.col("_u_url"), "rejected").when(F.col("content_hash").eqNullSafe(F.col("_u_content_hash")), "unchanged").otherwise("updated")
    return out, told.select(F.col("_u_id").alias("id"), action.alias("action"))


def latest_update_wins(updates: DataFrame) -> DataFrame:
    """Of the updates of a page (id, seq, ...) that of the highest seq."""
    return updates.groupBy("id").agg(F.max_by(F.struct(*updates.columns), "seq").alias("u")).select("u.*")


def advance_lifecycle(events: DataFrame) -> DataFrame:
    """page_id, snapshot_state and transitions after events (page_id, event, ts, event_id): created, retried -> pending, finalized, updated -> ready, failed -> failed.

    A failure after the page became ready changes nothing, as only pending pages can fail.
    """
    order = F.struct("ts", "event_id")
    good, bad = F.col("event").isin("finalized", "updated"), F.col("event") == "failed"
    folded = events.groupBy("page_id").agg(
        F.max(F.when(good, order)).alias("g"), F.max(F.when(bad, order)).alias("f"), F.max(F.when(F.col("event").isin("created", "retried"), order)).alias("c"), F.count("*").alias("transitions"))
    low = F.struct(F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    g, f, c = (F.coalesce(x, low) for x in ("g", "f", "c"))
    state = F.when((f > c) & (f > g) & ((g < c) | F.col("g").isNull()), "failed").when(F.col("g").isNotNull() & (g > c), "ready").otherwise("pending")
    return folded.select("page_id", state.alias("snapshot_state"), "transitions")


def link_page_resources(links: DataFrame, held: DataFrame, resources: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New links (distinct, resource 0 ignored, those held left out), and resources with last_seen at least now where linked."""
    new = links.where("resource_id != 0").dropDuplicates(["page_id", "resource_id"]).join(held, ["page_id", "resource_id"], "left_anti")
    seen = new.select(F.col("resource_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
    out = resources.join(seen, "id", "left").withColumn("last_seen", F.when(F.col("_seen"), F.greatest("last_seen", now)).otherwise(F.col("last_seen")))
    return new, out.select(resources.columns)


def shrink_guard(updates: DataFrame, share: float = 0.7) -> DataFrame:
    """Updates (page_id, ts, html) that aren't shorter than `share` of the first of their page."""
    first = F.first(F.length("html")).over(Window.partitionBy("page_id").orderBy("ts", "update_id").rowsBetween(Window.unboundedPreceding, 0))
    return updates.withColumn("_first", first).where(F.length("html") >= share * F.col("_first")).drop("_first")


def tick_counts(changes: DataFrame, tick: str = "5 seconds") -> DataFrame:
    """page_id, tick (start of the window) and changes that were visible in it."""
    return changes.where("not hidden").groupBy("page_id", F.window("ts", tick)["start"].alias("tick")).agg(F.count("*").alias("changes"))


def change_bursts(changes: DataFrame, least: int = 10, life: str = "5 minutes") -> DataFrame:
    """page_id, tick, changes: an emit at each tick where `least` changes have come together since the last one; none after `life`.

    Ticks are summed first, so a page's state walks over few rows, not over its changes.
    """
    first = changes.groupBy("page_id").agg(F.min("ts").alias("first"))
    return bursts_of_ticks(tick_counts(changes).join(first, "page_id"), least, life)


def bursts_of_ticks(ticks: DataFrame, least: int = 10, life: str = "5 minutes") -> DataFrame:
    """change_bursts from ticks (page_id, tick, changes, and `first`, the time of the page's first change)."""
    ticks = ticks.where((F.col("changes") > 0) & (F.col("tick") < F.col("first") + F.expr(f"INTERVAL {life}"))).select("page_id", "tick", "changes")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, held = None, 0
        for rows in batches:  # sorted by page and tick
            out = []
            for p, t, n in rows.itertuples(index=False):
                held = n if p != page else held + n
                page = p
                if held >= least:
                    out.append((p, t, held))
                    held = 0
            yield pd.DataFrame(out, columns=["page_id", "tick", "changes"]).astype({"page_id": "int64", "changes": "int64", "tick": "datetime64[us]"})

    return ticks.repartition("page_id").sortWithinPartitions("page_id", "tick").mapInPandas(walk, ticks.schema)


def fragment_text_key(html: Column) -> Column:
    """A fragment's text without tags, times like 1:23 / 4:56 and ages like ·14h, then the sources of its images, each after a NUL."""
    text = F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\d+:\d+ ?/ ?\d+:\d+", ""), r"·\s?\d+[smhdwy]", "")
    images = F.regexp_extract_all(html, F.lit(r"<img[^>]*\ssrc=[\"']([^\"']*)"), 1)
    return F.concat(F.trim(text), F.array_join(F.transform(images, lambda s: F.concat(F.lit("\0"), s)), ""))


def merge_fragments(present: DataFrame, dropped: DataFrame, least: int = 2048, cap: int = 10 << 20) -> DataFrame:
    """Rows of `dropped` (page_id, seq, key, html) that a page's union with `present` (page_id, key) gains.

    A fragment whose key the page has k times is gained from its (k+1)-th on; empty keys and fragments under `least` characters don't
    count, and a page gains no more once `cap` characters are reached.
    """
    rows = dropped.where((F.col("key") != "") & (F.length("html") >= least))
    rank = F.row_number().over(Window.partitionBy("page_id", "key").orderBy("seq"))
    count = present.groupBy("page_id", "key").agg(F.count("*").alias("_held"))
    rows = rows.withColumn("_rank", rank).join(count, ["page_id", "key"], "left").where(F.col("_rank") > F.coalesce("_held", F.lit(0)))
    size = F.sum(F.length("html")).over(Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_size", size).where(F.col("_size") <= cap).select(dropped.columns)


def order_fragments(children: DataFrame) -> DataFrame:
    """container_id, ordinal and position: by translateY where at least half of two or more children have one (others 0), else as they stand."""
    y = F.regexp_extract("style", r"translateY\(([\d.]+)px\)", 1)
    rows = children.withColumn("_y", F.when(y != "", y.cast("double")))
    own = Window.partitionBy("container_id")
    placed = (F.count("*").over(own) >= 2) & (F.count("_y").over(own) * 2 >= F.count("*").over(own))
    rows = rows.withColumn("_k", F.when(placed, F.coalesce("_y", F.lit(0.0))).otherwise(F.lit(0.0)))
    return rows.select("container_id", "ordinal", F.row_number().over(own.orderBy("_k", "ordinal")).alias("position"))


def explode_frames(captures: DataFrame) -> DataFrame:
    """capture_id and one frame a row; the last of a key wins, frames without key, url or html go."""
    rows = captures.select("capture_id", F.posexplode("frames").alias("pos", "frame")).select("capture_id", "pos", "frame.*")
    rows = rows.where("coalesce(key, '') != '' and coalesce(url, '') != '' and coalesce(html, '') != ''")
    return rows.groupBy("capture_id", "key").agg(F.max_by(F.struct("url", "title", "html"), "pos").alias("f")).select("capture_id", "key", "f.*", F.lit("html").alias("content_type"))


def frame_status(html: Column) -> Column:
    """placeholder where the body is hidden, empty where it has no text and nothing but script, style, link or meta, else ok."""
    body = F.regexp_extract(html, r"(?is)<body([^>]*)>", 1)
    hidden = body.rlike(r"(?i)class\s*=\s*[\"'][^\"']*\bnone\b") | body.rlike(r"(?i)style\s*=\s*[\"'][^\"']*(display\s*:\s*none|visibility\s*:\s*hidden)")
    inner = F.regexp_replace(F.regexp_replace(html, r"(?is)^.*?<body[^>]*>", ""), r"(?is)</body>.*$", "")
    inner = F.regexp_replace(inner, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<(link|meta)\b[^>]*>|<!--.*?-->", "")
    return F.when(hidden, "placeholder").when(F.trim(F.regexp_replace(inner, r"\s+", " ")) == "", "empty").otherwise("ok")


def delete_pages(gone: DataFrame, catalog: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """The tables without pages of ids in `gone` and the links, shares and favourites that go with them; their html paths join the queue."""
    ids = gone.select(F.col("id").alias("page_id")).distinct()
    out = {"pages": catalog["pages"].join(ids.withColumnRenamed("page_id", "id"), "id", "left_anti")}
    out |= {t: catalog[t].join(ids, "page_id", "left_anti") for t in ("page_resources", "page_shares", "favorites") if t in catalog}
    queue = catalog["pages"].join(ids.withColumnRenamed("page_id", "id"), "id", "left_semi").select("html_path", now.alias("timestamp"), F.col("id").alias("page_id"))
    return out | {"deletion_queue": catalog["deletion_queue"].unionByName(queue) if "deletion_queue" in catalog else queue}


def touch_pages(pages: DataFrame, visits: DataFrame) -> DataFrame:
    """Pages with last_visited and body_text of visits (id, last_visited, body_text) where these aren't null."""
    v = visits.select("id", *[F.col(c).alias(f"_v_{c}") for c in ("last_visited", "body_text")])
    both = pages.join(v, "id", "left")
    return both.select([F.coalesce(f"_v_{c}", c).alias(c) if c in ("last_visited", "body_text") else F.col(c) for c in pages.columns])


def backfill_body_text(pages: DataFrame, html: DataFrame, extract) -> DataFrame:
    """id and body_text of pages that have none and whose html (html_path, html) is there; an empty text stays null."""
    todo = pages.where("body_text is null").select("id", "html_path").join(html, "html_path", "left")
    return todo.select("id", F.nullif(extract(F.col("html")), F.lit("")).alias("body_text"), F.col("html").isNotNull().alias("found"))


def upgrade_tables(pages: DataFrame) -> DataFrame:
    """Rows of older versions with the defaults of today; running it again changes nothing."""
    held = set(pages.columns)
    old = lambda c, kind: F.col(c) if c in held else F.lit(None).cast(kind)
    empty = old("domain", "string").isNull() | (old("domain", "string") == "")
    text = lambda c: F.coalesce(*[F.try_to_timestamp(F.col(c).cast("string"), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd")])
    times = {c: text(c).cast("timestamp_ntz") for c in ("captured_at", "first_visited", "last_visited") if dict(pages.dtypes).get(c) == "string"}
    return pages.withColumns({"domain": F.when(empty, extract_domain(F.col("url"))).otherwise(old("domain", "string")), "snapshot_state": F.coalesce(old("snapshot_state", "string"), F.lit("ready"))} | times)
