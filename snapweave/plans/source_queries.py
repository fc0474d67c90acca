"""Queries of sources, streams and SQL functions over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.registry import register_functions
from ..functions.shared import shared_folder
from ..operators import ingest
from ..sources import buckets, files, logfiles, store
from ..streaming import jobs
from . import catalog_queries, content_queries  # noqa: F401
from .fixtures import BURSTS, DOMAIN_SQL
from .registry import ORACLE_SQL, ntz, query


@query("SELECT capture_id, url, title, sha256(html) AS content_hash FROM captures WHERE capture_id % 3 != 0")
def read_captures(t):
    rows = t.captures.select(F.to_json(F.struct(F.when(F.col("capture_id") % 3 != 0, F.col("url")).alias("url"), F.concat(F.col("capture_id").cast("string"), F.lit("|"), "title").alias("title"), "html")).alias("value"))
    good, _ = store.captures_from_json(rows)
    at = F.split("title", r"\|", 2)
    return good.select(at[0].cast("long").alias("capture_id"), "url", at[1].alias("title"), F.sha2("html", 256).alias("content_hash"))


@query("""SELECT id, 'html/' || strftime(captured_at, '%Y/%m/%d/') || CAST(floor(epoch_us(captured_at) / 1000000) AS BIGINT) || '_' || substr(sha256(url || strftime(captured_at, '%Y-%m-%d %H:%M:%S.%f')), 1, 16) || '.html' AS path FROM snapshots""")
def html_snapshot_path(t):
    return t.snapshots.select("id", store.html_path(F.col("url"), F.col("captured_at")).alias("path"))


@query("SELECT id, 'resources/' || substr(content_hash, 1, 2) || '/' || substr(content_hash, 3, 2) || '/' || content_hash || ['.img', '.css', '.js', '.font', '.html', '.bin'][id % 6 + 1] AS path FROM snapshots")
def resource_path(t):
    kind = F.expr("element_at(array('image', 'css', 'js', 'font', 'html', 'other'), cast(id % 6 as int) + 1)")
    return t.snapshots.select("id", store.resource_path(F.col("content_hash"), kind).alias("path"))


@query("SELECT id, strlen(html) AS bytes, CAST(captured_at AS DATE) AS capture_date FROM snapshots WHERE CAST(captured_at AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'")
def html_snapshots(t):
    """The html store written, and a range of its days read."""
    path = _root(t)
    store.write_html_snapshots(t.snapshots.select("id", "url", "captured_at", "html"), path)
    return store.read_html_snapshots(t.spark, path, "2024-01-02", "2024-01-20").select("id", F.octet_length("html").alias("bytes"), "capture_date")


@query("SELECT sha256(html) AS content_hash, any_value(strlen(html)) AS bytes FROM pages GROUP BY 1")
def stored_resources(t):
    """Contents written twice, the second time with some that are stored: each is held once."""
    path = _root(t)
    rows = t.pages_raw.select(F.sha2("html", 256).alias("content_hash"), F.octet_length("html").alias("bytes"))
    empty = t.spark.createDataFrame([], "content_hash string")
    store.write_resources(rows.unionByName(rows).where(F.col("content_hash") < "8"), empty, path)
    store.write_resources(rows, t.spark.read.parquet(path), path)
    return t.spark.read.parquet(path)


@query("SELECT page_id FROM favorites WHERE page_id % 7 != 0")
def catalog_favorites(t):
    """Catalog tables written and read; favourites of pages that aren't there are left out."""
    path = _root(t)
    store.write_catalog({"pages": t.snapshots.where("id % 7 != 0"), "favorites": t.favorites}, path)
    return store.read_catalog(t.spark, path, "favorites").select("page_id")


def _log_files(t, lines=None, path=None):
    """Log lines as files of a day each, named as a server names them; with a path, what is added to its files."""
    path, each = path or _root(t), 1000
    lines = t.log_lines if lines is None else lines
    parts = lines.groupBy("file", F.floor(F.col("line_no") / each).alias("part")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    text = F.concat(F.array_join(F.col("l.line"), "\n"), F.lit("\n"))
    files.write_files(parts.select(F.col("file").alias("path"), "part", text.alias("content")), path, existing="append")
    return path


@query("SELECT file, CAST(substr(file, 9, 10) AS DATE) AS day, line_no, CAST(sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS stop, line FROM log_lines")
def read_logs(t):
    """Every line of real files with its number and where it ends, read in ranges of 4 KB."""
    lines = logfiles.numbered(logfiles.read_log_lines(t.spark, _log_files(t), 4096))
    return lines.select("file", logfiles.day_of(F.col("file")).alias("day"), "line_no", F.col("end").alias("stop"), "line")


@query("SELECT file, count(*) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS size, CAST(substr(file, 9, 10) AS DATE) AS day FROM log_lines GROUP BY file")
def list_logs(t):
    """Names, sizes and days of real files."""
    return store.list_logs(store.read_logs(t.spark, _log_files(t)))


@query("SELECT file, line FROM log_lines QUALIFY line_no > max(line_no) OVER (PARTITION BY file) - 40")
def log_files_tail(t):
    """The ends of real files, of which no more is read."""
    return logfiles.tail_of_files(t.spark, _log_files(t), 40).select("file", "line")


@query("""SELECT file, line, CAST(stop - strlen(line) - 1 AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, min(stop - strlen(line) - 1) OVER (PARTITION BY file) > 0 AS has_more_before, max(stop) OVER (PARTITION BY file) < total AS has_more_after
    FROM (SELECT *, max(stop) OVER (PARTITION BY file) AS total FROM (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY line_no) AS stop FROM log_lines)) WHERE stop - strlen(line) - 1 >= 500 AND stop <= 2500""")
def log_files_range(t):
    """2000 bytes of real files after an offset, of which no more is read."""
    return logfiles.range_of_files(t.spark, _log_files(t), after=500, limit=2000).select("file", "line", "start", F.col("end").alias("stop"), "has_more_before", "has_more_after")


@query("SELECT id, 'html/' || strftime(captured_at, '%Y/%m/%d/') || CAST(floor(epoch_us(captured_at) / 1000000) AS BIGINT) || '_' || substr(sha256(url || strftime(captured_at, '%Y-%m-%d %H:%M:%S.%f')), 1, 16) || '.html' AS html_path, sha256(html) AS hash FROM snapshots WHERE CAST(captured_at AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-20'")
def html_files(t):
    """The html store in its own layout, written twice, and a range of its days read."""
    path, rows = _root(t), t.snapshots
    store.write_html_files(rows.where("id % 2 = 0"), path)
    store.write_html_files(rows, path)
    found = store.read_html_files(t.spark, path, "2024-01-02", "2024-01-20").select("html_path", F.sha2("html", 256).alias("hash"))
    named = rows.select("id", store.html_path(F.col("url"), F.col("captured_at")).alias("html_path"))
    return named.join(found, "html_path").select("id", "html_path", "hash")


@query("SELECT DISTINCT 'resources/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.html' AS path, h AS file_hash, strlen(html) AS length FROM (SELECT sha256(html) AS h, html FROM pages)")
def resource_files(t):
    """Contents as files named by their hashes, some written twice, and their hashes read back in blocks."""
    path, rows = _root(t), t.pages_raw.select(F.col("html").alias("content"), F.lit("html").alias("kind"))
    store.write_resource_files(rows.where("length(content) % 2 = 0"), path)
    store.write_resource_files(rows, path)
    return store.read_resources(t.spark, path).select(F.regexp_extract("file_path", r"(resources/.*)$", 1).alias("path"), "file_hash", "length")


@query("SELECT id, url, domain, snapshot_state, body_text FROM snapshots")
def catalog_pages(t):
    return store.conform(t.snapshots, "pages").select("id", "url", "domain", "snapshot_state", "body_text")


@query()
def merge_stored_pages(t):
    """apply_updates on a stored table in buckets of url, in two merges; of the first only buckets of its urls are rewritten."""
    path, updates = _root(t), catalog_queries._updates(t)
    buckets.create_bucketed(t.snapshots, path, buckets=64)
    for part in ("id % 10 = 0", "id % 10 != 0"):
        buckets.merge_bucketed(updates.where(part), path, lambda rows, new: ingest.apply_updates(rows, new)[0])
    return buckets.read_bucketed(t.spark, path).select("id", "title", "content_hash", "html_path", "body_text", "snapshot_state", "last_visited")


@query()
def touch_stored_pages(t):
    """touch_pages on a stored table in buckets of url."""
    path = _root(t)
    buckets.create_bucketed(t.snapshots, path, buckets=64)
    visits = t.snapshots.where("id % 2 = 0").select("id", "url", ntz("2024-01-20").alias("last_visited"), F.when(F.col("id") % 4 == 0, "x").alias("body_text"))
    buckets.merge_bucketed(visits, path, ingest.touch_pages)
    return buckets.read_bucketed(t.spark, path).select("id", "last_visited", "body_text")


ORACLE_SQL["merge_stored_pages"], ORACLE_SQL["touch_stored_pages"] = ORACLE_SQL["apply_updates"], ORACLE_SQL["touch_pages"]


@query("SELECT html_path, page_id FROM deletion_queue")
def deletion_queue(t):
    root = f"{shared_folder(t.spark)}/queue"
    path = f"{root}-{uuid.uuid4().hex}"
    store.append_deletion_queue(t.deletion_queue, path)
    return store.read_deletion_queue(t.spark, path).select("html_path", "page_id")


@query(f"SELECT page_id, {DOMAIN_SQL.format('url')} AS domain, CASE WHEN contains(url, '.htm') THEN 'html' ELSE 'other' END AS type, true AS fetchable FROM pages")
def sql_functions(t):
    register_functions(t.spark)
    return t.pages_raw.select("page_id", F.expr("extract_domain(url)").alias("domain"), F.expr("guess_type(url)").alias("type"), F.expr("is_fetchable(url)").alias("fetchable"))


@query(name="sql_extract_resources")
def sql_extract_resources(t):
    """References of a page as a lateral table in SQL: the rows of the operator of that name."""
    register_functions(t.spark)
    t.rich.createOrReplaceTempView("rich_pages")
    return t.spark.sql("SELECT p.page_id, r.url AS resource_url, r.type FROM rich_pages p, LATERAL extract_resources(p.html, p.url) r")


ORACLE_SQL["sql_extract_resources"] = ORACLE_SQL["extract_resources"]


def _arriving(t, rows):
    """Rows as files that arrive in a folder."""
    path = f"{shared_folder(t.spark)}/arrivals-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return t.spark.readStream.schema(rows.schema).parquet(path)


def _events_stream(t):
    return _arriving(t, t.events)


def _root(t):
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


@query("""SELECT url, content_hash, epoch_us(min(ts)) AS first_visited, epoch_us(max(ts)) AS last_visited, count(*) AS visits FROM (SELECT 'u' || (user_id % 50) AS url, event_type AS content_hash, ts FROM events) GROUP BY ALL""")
def stream_dedup_captures(t):
    rows = _events_stream(t).select(F.concat(F.lit("u"), F.expr("CAST(user_id % 50 AS STRING)")).alias("url"), F.col("event_type").alias("content_hash"), F.col("ts").alias("captured_at"))
    return jobs.stream_dedup_captures(rows, f"{shared_folder(t.spark)}/dedup-{uuid.uuid4().hex}")


@query("""SELECT count(*) AS requests, count(fetch_id) AS fresh FROM (SELECT request_id, max(fetch_id) AS fetch_id FROM (SELECT r.event_id AS request_id, f.event_id AS fetch_id FROM events r LEFT JOIN events f
    ON f.user_id = r.user_id AND f.event_type != 'error' AND f.event_type != 'view' AND f.ts <= r.ts AND f.ts >= r.ts - INTERVAL 2 HOUR WHERE r.event_type = 'view') GROUP BY request_id)""")
def freshness_join(t):
    e = t.events
    r = e.where("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("url"), F.col("ts").alias("requested_at"))
    f = e.where("event_type not in ('view', 'error')").select(F.col("user_id").cast("string").alias("f_url"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("fetch_id"))
    near = F.expr("url = f_url AND fetched_at <= requested_at AND fetched_at >= requested_at - INTERVAL 2 HOURS")
    return jobs.newest_fresh(r.join(f, near, "left").select("request_id", "url", "requested_at", "fetch_id", "fetched_at")).agg(F.count("*").alias("requests"), F.count("fetch_id").alias("fresh"))


FOLD = """SELECT page_id, max(event_id) AS seq, CASE WHEN arg_max(event, event_id) FILTER (event != 'failed') IN ('finalized', 'updated') THEN 'ready'
    WHEN max(event_id) FILTER (event = 'failed') > coalesce(max(event_id) FILTER (event != 'failed'), -1) THEN 'failed' ELSE 'pending' END AS snapshot_state FROM lifecycle GROUP BY page_id"""


@query(FOLD)
def lifecycle_fold(t):
    return jobs.fold_lifecycle(t.lifecycle.select("page_id", F.col("event_id").alias("seq"), "event"))


@query("SELECT CAST(user_id % 50 AS VARCHAR) AS url, 1 AS captures FROM events GROUP BY 1")
def stream_recent_capture(t):
    """Within a span longer than the table's, one capture of each url is let through."""
    rows = t.events.select(F.expr("CAST(user_id % 50 AS STRING)").alias("url"), F.col("ts").cast("timestamp").alias("captured_at"))
    return jobs.run_available(jobs.stream_recent_capture(_arriving(t, rows), "100 days"), _root(t)).groupBy("url").agg(F.count("*").cast("int").alias("captures"))


@query(FOLD)
def stream_lifecycle(t):
    """The last state of each page after events of which the odd ones arrive first, in two runs."""
    rows, path = t.lifecycle.select("page_id", F.col("event_id").alias("seq"), "event", F.col("ts").cast("timestamp").alias("ts")), _root(t)
    for part in ("seq % 2 = 1", "seq % 2 = 0"):
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        stream = jobs.stream_lifecycle(t.spark.readStream.schema(rows.schema).parquet(f"{path}/in"), "400 days")
        jobs.run_batches(stream, path, lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/out/n={k}"), "update")
    return t.spark.read.parquet(f"{path}/out").groupBy("page_id").agg(F.max_by("snapshot_state", F.struct("seq", "batch")).alias("snapshot_state"), F.max("seq").alias("seq"))


@query(BURSTS)
def stream_change_bursts(t):
    """A last, hidden change an hour later lets the watermark pass all ticks."""
    late = t.spark.range(1).select(F.lit(-1).cast("long").alias("page_id"), F.lit("2024-01-01 01:00:00").cast("timestamp_ntz").alias("ts"), F.lit(True).alias("hidden"))
    rows = t.changes.unionByName(late).withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_available(jobs.stream_change_bursts(_arriving(t, rows)), _root(t)).withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("SELECT file, line FROM log_lines WHERE contains(line, 'failed')")
def stream_log_follow(t):
    """Files that grow between runs of the stream, the first time up to the middle of a line."""
    root, rows = _root(t), t.log_lines
    path = _log_files(t, rows.where("line_no <= 40"))
    half = rows.where("line_no = 41").select(F.col("file").alias("path"), F.expr("left(line, 7)").alias("content"))
    files.write_files(half, path, existing="append")
    jobs.run_available(jobs.stream_log_follow(t.spark, path, "FAILED"), root)
    rest = rows.where("line_no > 40").withColumn("line", F.when(F.col("line_no") == 41, F.expr("substr(line, 8)")).otherwise(F.col("line")))
    return jobs.run_available(jobs.stream_log_follow(t.spark, _log_files(t, rest, path), "FAILED"), root)


@query("SELECT html_path, page_id FROM deletion_queue WHERE timestamp < TIMESTAMP '2024-01-30' - INTERVAL 1 DAY AND html_path NOT IN (SELECT html_path FROM shares WHERE revoked_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20'))")
def stream_retention(t):
    from ..operators.shares import protected_html

    held = protected_html(t.shares, ntz("2024-01-20"))
    return jobs.stream_retention(_arriving(t, t.deletion_queue), held, ntz("2024-01-30"), 1, _root(t)).select("html_path", "page_id")


@query("""SELECT request_id, max_by(fetch_id, fetched_at) AS fetch_id FROM (SELECT r.event_id AS request_id, f.event_id AS fetch_id, f.ts AS fetched_at FROM events r JOIN events f
    ON f.user_id = r.user_id AND f.event_type NOT IN ('view', 'error') AND f.ts <= r.ts AND f.ts >= r.ts - INTERVAL 2 HOUR WHERE r.event_type = 'view') GROUP BY request_id""")
def stream_freshness_join(t):
    """Requests that a fetch can serve, and the newest such fetch."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    r = _arriving(t, e.where("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("url"), F.col("ts").alias("requested_at")))
    f = _arriving(t, e.where("event_type not in ('view', 'error')").select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("fetch_id")))
    found = jobs.run_available(jobs.stream_freshness_join(r, f), _root(t)).where("fetch_id is not null")
    return jobs.newest_fresh(found).select("request_id", "fetch_id")
