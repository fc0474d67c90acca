"""Resources: lookup, reuse, freshness, integrity and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds for which a fetch may be reused at most.
TTL = 2 * 3600
MAX_BYTES = 200 << 20


def resource_by_id(resources: DataFrame, id_: int) -> DataFrame:
    return resources.where(F.col("id") == id_)


def _latest(rows: DataFrame, *key: str) -> DataFrame:
    """The row last seen of each key, the higher id of equals; combined before the shuffle, without a sort."""
    best = F.max_by(F.struct(*rows.columns), F.struct("last_seen", "id")).alias("r")
    return rows.groupBy(*key).agg(best).select("r.*")


def latest_by_hash(resources: DataFrame) -> DataFrame:
    return _latest(resources.where("not is_quarantined"), "content_hash")


def latest_by_url(resources: DataFrame, quarantined: bool = False) -> DataFrame:
    return _latest(resources if quarantined else resources.where("not is_quarantined"), "url")


def latest_by_url_like(resources: DataFrame, pattern: str) -> DataFrame:
    return resources.where(F.col("url").like(pattern)).orderBy(F.desc("last_seen"), F.desc("id")).limit(1)


def page_resources(links: DataFrame, resources: DataFrame) -> DataFrame:
    return links.join(resources.withColumnRenamed("id", "resource_id"), "resource_id")


def path_key(url: Column) -> Column:
    """A url without query and fragment (# or %23), spaces coded: what all steps of the ladder agree on."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)(\?|#|%23).*$", ""), " ", "%20")


def resolve_page_resource(refs: DataFrame, links: DataFrame, resources: DataFrame) -> DataFrame:
    """For refs (page_id, ref): the linked resource found first on the ladder, and the step; no row without one.

    1 the same url, 2 the same once re-coded, 3 with spaces coded, 4 the reference followed by a fragment, 5 the same
    without query (exact before with a query); ties by last_seen, then id. Only resources linked to the page count.
    """
    held = page_resources(links, resources).select("page_id", F.col("resource_id"), F.col("url").alias("_url"), "last_seen").withColumn("_key", path_key(F.col("_url")))
    ref, url = F.col("ref"), F.col("_url")
    spaced = F.replace(ref, F.lit(" "), F.lit("%20"))
    bare = F.regexp_replace(ref, r"(?s)\?.*$", "")
    step = (
        F.when(url == ref, 1).when(F.coalesce(F.try_url_decode(url) == F.try_url_decode(ref), F.lit(False)), 2).when(url == spaced, 3)
        .when(F.startswith(url, F.concat(ref, F.lit("#"))) | F.startswith(url, F.concat(ref, F.lit("%23"))), 4)
        .when(url == bare, 5).when(F.startswith(url, F.concat(bare, F.lit("?"))), 6)
    )
    both = refs.withColumn("_key", path_key(ref)).join(held, ["page_id", "_key"]).withColumn("step", step).where("step is not null")
    best = F.min_by(F.struct("resource_id", "step"), F.struct("step", (-F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', last_seen)")).alias("t"), (-F.col("resource_id")).alias("i")))
    return both.groupBy("page_id", "ref").agg(best.alias("b")).select("page_id", "ref", "b.resource_id", F.least("b.step", F.lit(5)).alias("step"))


def resource_by_url_and_page(refs: DataFrame, links: DataFrame, resources: DataFrame) -> DataFrame:
    """For refs (page_id, ref): the linked resource of exactly that url, else the newest of it anywhere, quarantined or not."""
    held = _latest(page_resources(links, resources).select("page_id", F.col("resource_id").alias("id"), "url", "last_seen"), "page_id", "url").select("page_id", F.col("url").alias("ref"), F.col("id").alias("_own"))
    anywhere = latest_by_url(resources, True).select(F.col("url").alias("ref"), F.col("id").alias("_any"))
    return refs.join(held, ["page_id", "ref"], "left").join(anywhere, "ref", "left").select("page_id", "ref", F.coalesce("_own", "_any").alias("resource_id"), F.col("_own").isNotNull().alias("linked"))


def freshness(cache_control: Column, expires: Column, now: Column) -> Column:
    """Until when a response may be reused: null is not fresh. Of no-store, no-cache and max-age the first decides; without them Expires; never over two hours."""
    parts = F.transform(F.split(F.lower(F.coalesce(cache_control, F.lit(""))), ","), lambda d: F.trim(d))
    first = F.get(F.filter(parts, lambda d: d.isin("no-store", "no-cache") | d.startswith("max-age=")), F.lit(0))
    age = F.substring(first, 9, 20).try_cast("bigint")
    until = now + F.make_dt_interval(secs=F.least(age, F.lit(TTL)).cast("decimal(18,6)"))
    cap = now + F.expr(f"INTERVAL {TTL} SECONDS")
    when = F.try_to_timestamp(F.regexp_extract(F.coalesce(expires, F.lit("")), r"^\w+, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    return F.when(first.isNotNull(), F.when(first.startswith("max-age=") & (age > 0), until)).when(when > now, F.least(when, cap))


def resolve_fetches(log: DataFrame) -> DataFrame:
    """What each fetch (fetch_id, url, fetched_at, status, content_hash) comes to, in order of time and id within its url.

    200: `reuse` of the row of that url and content if it was fetched before, `share` if another url had that content before (a new
    row, the same file), else `create`. 304 and failures take the url's last good fetch (`cached`, `fallback`), or are an `error`
    without one. source_fetch is the fetch whose row or file is used. A url's history is cut into hours: the last good fetch of each is
    carried over the hours, and then looked for within one, so that no task orders more than an hour of a url.
    """
    order = F.struct("fetched_at", "fetch_id")
    ok = log.where("status = 200")
    first_of_row = ok.groupBy("url", "content_hash").agg(F.min(order).alias("_row"))
    first_of_file = ok.groupBy("content_hash").agg(F.min(order).alias("_file"))
    good_fetch = F.struct("fetch_id", "content_hash")
    hour = F.coalesce(F.timestamp_diff("HOUR", F.lit("1970-01-01").cast(log.schema["fetched_at"].dataType), "fetched_at"), F.lit(-(1 << 62)))  # no time comes first
    log = log.withColumn("_hour", hour)
    hours = log.groupBy("url", "_hour").agg(F.max_by(F.when(F.col("status") == 200, good_fetch), F.when(F.col("status") == 200, order)).alias("_good"))
    earlier = Window.partitionBy("url").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(F.col("url").alias("_url"), F.col("_hour").alias("_of"), F.last("_good", ignorenulls=True).over(earlier).alias("_carried")).where("_carried is not null")
    before = Window.partitionBy("url", "_hour").orderBy("fetched_at", "fetch_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(F.when(F.col("status") == 200, good_fetch), ignorenulls=True).over(before), F.col("_carried"))
    log = log.join(hours, F.col("url").eqNullSafe(F.col("_url")) & (F.col("_hour") == F.col("_of")), "left")
    rows = log.withColumn("_last", last).join(first_of_row, ["url", "content_hash"], "left").join(first_of_file, "content_hash", "left")
    good = F.col("status") == 200
    action = (
        F.when(good & (F.col("_row") < order), "reuse").when(good & (F.col("_file") < order), "share").when(good, "create")
        .when(F.col("_last").isNull(), "error").when(F.col("status") == 304, "cached").otherwise("fallback")
    )
    source = F.when(good, F.when(F.col("_row") < order, F.col("_row.fetch_id")).otherwise(F.col("_file.fetch_id"))).otherwise(F.col("_last.fetch_id"))
    return rows.select("fetch_id", action.alias("action"), source.alias("source_fetch"))


def integrity_scan(resources: DataFrame, files: DataFrame) -> DataFrame:
    """Of each distinct path of live rows: ok, mismatch or missing, by the row of the least id. files: file_path, file_hash."""
    live = resources.where("not is_quarantined and coalesce(file_path, '') != ''")
    first = live.groupBy("file_path").agg(F.min_by("content_hash", "id").alias("content_hash"), F.count("*").alias("resources"))
    state = F.when(F.col("file_hash").isNull(), "missing").when(F.col("file_hash") != F.col("content_hash"), "mismatch").otherwise("ok")
    return first.join(files, "file_path", "left").select("file_path", state.alias("state"), "resources")


def integrity_totals(resources: DataFrame, files: DataFrame) -> DataFrame:
    scan = integrity_scan(resources, files)
    totals = scan.agg(F.count("*").alias("scanned_files"), F.count_if(F.col("state") == "mismatch").alias("corrupted"), F.count_if(F.col("state") == "missing").alias("missing"), F.coalesce(F.sum(F.when(F.col("state") != "ok", F.col("resources"))), F.lit(0)).alias("quarantined"))
    return resources.where("not is_quarantined").agg(F.count("*").alias("scanned_resources")).join(totals)


def quarantine(resources: DataFrame, bad: DataFrame) -> DataFrame:
    """Resources whose live rows of a bad path (file_path, state) are quarantined, with the reason and the path of the copy."""
    marks = bad.where("state != 'ok'").select("file_path", F.col("state").alias("_why"))
    rows = resources.join(marks, "file_path", "left")
    hit = F.col("_why").isNotNull() & ~F.col("is_quarantined")
    change = {"is_quarantined": F.col("is_quarantined") | hit, "quarantine_reason": F.when(hit, F.col("_why")).otherwise(F.col("quarantine_reason")), "file_path": F.when(hit, F.concat(F.lit("quarantine/"), "file_path")).otherwise(F.col("file_path"))}
    return rows.select([change[c].alias(c) if c in change else F.col(c) for c in resources.columns])


def retention_plan(queue: DataFrame, protected: DataFrame, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Queue records to delete (older than `days` and not protected) and those that stay."""
    if days <= 0:
        raise ValueError("days must be positive")
    old = F.col("timestamp") < as_of - F.expr(f"INTERVAL {days} DAYS")
    marked = queue.join(protected.select("html_path", F.lit(True).alias("_held")).distinct(), "html_path", "left").withColumn("_go", old & F.col("_held").isNull())
    return marked.where("_go").select(queue.columns), marked.where("not _go").select(queue.columns)


def size_limits(log: DataFrame, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Fetches within the limit, and those over it."""
    return log.where(F.col("content_length") <= most), log.where(F.col("content_length") > most)
