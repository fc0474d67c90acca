"""Tables derived from the driver's by fixed rules, as DataFrames and, for the oracle, as DuckDB text of the same meaning."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import extract_domain

TITLE = r"<title>([^<]*)</title>"
HREF = r'<a href="(/[^"]*)">'
TAGS = r"<[^>]*>"
#: What a link of a page is replaced by to give it images, styles, scripts, frames and media ({0}: the link's path).
RICH = (
    '<img class="i" data-src="{0}.lazy" src="{0}.png" srcset="{0}.png 1x, {0}@2x.png 2x"><link rel="stylesheet" href="{0}.css"><link rel="icon" href="{0}.ico">'
    '<link rel="preload" as="font" href="{0}.woff2"><script src="https://cdn.example.org{0}.js"></script><iframe src="../frames{0}.html"></iframe>'
    "<video poster='{0}.jpg' src='{0}.mp4' autoplay></video><i style=\"background:url('{0}-bg.png')\" onclick=\"go('x')\"></i><a href=\"{0}\">"
)


def path_id(column):
    """48 bits of a link's md5, as a number that SQL can make too."""
    return F.conv(F.substring(F.md5(column), 1, 12), 16, 10).cast("long")


class Tables:
    """The driver's tables and what is derived from them, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def pages_raw(self) -> DataFrame:
        return self.read("pages")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def captures(self) -> DataFrame:
        """One per event; each page gets three versions of its content."""
        pages = self.pages_raw
        n = pages.agg(F.count("*").alias("n"))
        rows = self.events.join(F.broadcast(n)).withColumn("page_id", F.expr("event_id % n")).join(pages, "page_id")
        html = F.concat("html", F.lit("<!--v"), F.expr("CAST((event_id div n) % 3 AS STRING)"), F.lit("-->"))
        return rows.select(F.col("event_id").alias("capture_id"), "url", F.regexp_extract("html", TITLE, 1).alias("title"), html.alias("html"), F.col("ts").alias("captured_at"), "event_type", "user_id")

    @cached_property
    def hashed(self) -> DataFrame:
        return self.captures.withColumn("content_hash", F.sha2("html", 256))

    @cached_property
    def snapshots(self) -> DataFrame:
        rows = self.hashed.groupBy("url", "content_hash").agg(
            F.min("capture_id").alias("id"), F.min("title").alias("title"), F.min("captured_at").alias("captured_at"), F.max("captured_at").alias("last_visited"), F.count("*").alias("visits"), F.min("html").alias("html"))
        state = F.expr("CASE id % 10 WHEN 7 THEN 'pending' WHEN 9 THEN 'failed' ELSE 'ready' END")
        text = F.trim(F.regexp_replace(F.regexp_replace("html", TAGS, " "), r"\s+", " "))
        return rows.select(
            "id", "url", "title", F.concat(F.lit("html/"), F.col("id").cast("string"), F.lit(".html")).alias("html_path"), "content_hash", "captured_at", F.col("captured_at").alias("first_visited"),
            "last_visited", "visits", extract_domain(F.col("url")).alias("domain"), state.alias("snapshot_state"), F.when(F.col("id") % 5 != 0, text).alias("body_text"), "html",
        )

    @cached_property
    def favorites(self) -> DataFrame:
        return self.snapshots.where("id % 3 = 0").select(F.col("id").alias("page_id"), F.col("last_visited").alias("created_at"))

    @cached_property
    def shares(self) -> DataFrame:
        created = F.col("last_visited")
        return self.snapshots.where("id % 4 = 0").select(
            "id", F.col("id").alias("page_id"), F.sha2(F.concat(F.lit("t"), F.col("id").cast("string")), 256).alias("token_hash"), "url", "title", "html_path", "content_hash", "captured_at", (F.col("id") % 16 != 0).alias("allow_markdown"),
            created.alias("created_at"), F.when(F.col("id") % 8 == 0, created + F.expr("INTERVAL 5 DAYS")).alias("expires_at"), F.when(F.col("id") % 12 == 0, created + F.expr("INTERVAL 1 DAY")).alias("revoked_at"),
        )

    @cached_property
    def hrefs(self) -> DataFrame:
        """page_id, url and path of every link of a raw page."""
        return self.pages_raw.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("path"))

    @cached_property
    def resources(self) -> DataFrame:
        """One per distinct link path and content version (0 or 1)."""
        rows = self.hrefs.groupBy("path").agg(F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))
        rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
        kind = F.expr("element_at(array('image','css','js','font','other'), cast(first_page % 5 as int) + 1)")
        day = F.lit("2024-01-01").cast("timestamp_ntz")
        return rows.select(
            (path_id("path") * 2 + F.col("v")).alias("id"), F.concat(F.lit("https://static.example.com"), F.col("path")).alias("url"), F.sha2(F.concat(F.col("path"), F.expr("CAST(v * (last_page % 2) AS STRING)")), 256).alias("content_hash"),
            F.concat(F.lit("resources/"), F.col("path")).alias("file_path"), kind.alias("resource_type"), (F.length("path") * 1000).cast("long").alias("file_size"), day.alias("first_seen"),
            (day + F.expr("make_dt_interval(0, 0, cast((last_page + v) % 1440 as int))")).alias("last_seen"), (F.col("first_page") % 17 == 0).alias("is_quarantined"), F.lit("").alias("quarantine_reason"),
        )

    @cached_property
    def page_resources(self) -> DataFrame:
        return self.hrefs.select("page_id", F.explode(F.array(path_id("path") * 2, path_id("path") * 2 + 1)).alias("resource_id")).distinct()

    @cached_property
    def fetch_log(self) -> DataFrame:
        """Events as fetches of 200 urls, whose content changes with the value."""
        e = self.events
        return e.select(
            F.col("event_id").alias("fetch_id"), F.concat(F.lit("https://static.example.com/r/"), F.expr("CAST(user_id % 200 AS STRING)")).alias("url"), F.col("ts").alias("fetched_at"),
            F.expr("CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 304 ELSE 200 END").alias("status"),
            F.sha2(F.concat(F.expr("CAST(user_id % 200 AS STRING)"), F.expr("CAST(CAST(floor(value / 100) AS BIGINT) % 3 AS STRING)")), 256).alias("content_hash"),
            F.expr("element_at(array('max-age=60', 'no-store', 'public, max-age=999999', 'max-age=0', '', 'private, max-age=oops'), cast(event_id % 6 as int) + 1)").alias("cache_control"),
            F.col("value"), (F.col("event_id") % 300 * 1000000).alias("content_length"),
        )

    @cached_property
    def lifecycle(self) -> DataFrame:
        """Events of 400 pages; the type of event says what happened."""
        return self.events.select("event_id", F.expr("user_id % 400").alias("page_id"), "ts", F.expr("CASE event_type WHEN 'view' THEN 'created' WHEN 'click' THEN 'finalized' WHEN 'signup' THEN 'updated' WHEN 'purchase' THEN 'retried' ELSE 'failed' END").alias("event"))

    @cached_property
    def changes(self) -> DataFrame:
        """Events as changes of 20 pages within 400 seconds; errors are hidden ones."""
        at = F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, cast(event_id % 400 as decimal(18,6)))")
        return self.events.select(F.expr("user_id % 20").alias("page_id"), at.alias("ts"), (F.col("event_type") == "error").alias("hidden"))

    @cached_property
    def deletion_queue(self) -> DataFrame:
        """Every snapshot that a later one of its url has replaced."""
        newest = self.snapshots.groupBy("url").agg(F.max("first_visited").alias("_newest"))
        return self.snapshots.join(newest, "url").where("first_visited < _newest").select("html_path", F.col("last_visited").alias("timestamp"), F.col("id").alias("page_id"))

    @cached_property
    def log_lines(self) -> DataFrame:
        """file, line_no and line of events written as a server would log them, one file a day."""
        line = F.expr("""CASE event_type WHEN 'view' THEN '[HTTP] GET /view/' || CAST(user_id AS STRING) WHEN 'click' THEN '[Update] page ' || CAST(user_id AS STRING)
            WHEN 'error' THEN 'download failed for ' || CAST(user_id AS STRING) WHEN 'signup' THEN 'resource not found, fallback used' ELSE 'archive success ' || CAST(event_id AS STRING) END""")
        rows = self.events.select(F.concat(F.lit("archive-"), F.expr("CAST(CAST(ts AS DATE) AS STRING)"), F.lit(".001.log")).alias("file"), F.col("event_id").alias("seq"), line.alias("line"))
        from pyspark.sql.window import Window

        return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("seq")).cast("long").alias("line_no"), "line")

    @cached_property
    def rich(self) -> DataFrame:
        """Raw pages whose links carry images, styles, scripts, frames and media."""
        return self.pages_raw.select("page_id", "url", F.regexp_replace("html", F.lit(HREF), F.lit(RICH.replace("{0}", "$1"))).alias("html"))


#: The walk over ticks of 5 seconds, one after the other; emits are the rows at which the sum is let go.
BURSTS = """WITH RECURSIVE c AS (SELECT user_id % 20 AS page_id, TIMESTAMP '2024-01-01' + to_seconds(event_id % 400) AS ts, event_type = 'error' AS hidden FROM events),
f AS (SELECT page_id, min(ts) AS first FROM c GROUP BY page_id),
k AS (SELECT page_id, time_bucket(INTERVAL 5 SECOND, ts) AS tick, count(*) AS n FROM c WHERE NOT hidden GROUP BY ALL),
o AS (SELECT page_id, tick, n, row_number() OVER (PARTITION BY page_id ORDER BY tick) AS i FROM k JOIN f USING (page_id) WHERE tick < first + INTERVAL 5 MINUTE),
w(page_id, i, tick, s) AS (SELECT page_id, i, tick, n FROM o WHERE i = 1 UNION ALL SELECT o.page_id, o.i, o.tick, CASE WHEN w.s >= 10 THEN o.n ELSE w.s + o.n END FROM w JOIN o ON o.page_id = w.page_id AND o.i = w.i + 1)
SELECT page_id, epoch_us(tick) AS tick, CAST(s AS BIGINT) AS changes FROM w WHERE s >= 10"""


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DOMAIN_SQL = r"regexp_replace(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)', 1), '[\[\]]', '', 'g')"

#: name -> DuckDB text; later ones may use earlier ones.
SQL: dict[str, str] = {
    "captures": f"""SELECT e.event_id AS capture_id, p.url, regexp_extract(p.html, '{TITLE}', 1) AS title,
        p.html || '<!--v' || CAST((e.event_id // n.n) % 3 AS VARCHAR) || '-->' AS html, e.ts AS captured_at, e.event_type, e.user_id
        FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) n JOIN pages p ON p.page_id = e.event_id % n.n""",
    "hashed": "SELECT *, sha256(html) AS content_hash FROM captures",
    "snapshots": rf"""SELECT id, url, title, 'html/' || id || '.html' AS html_path, content_hash, captured_at, captured_at AS first_visited, last_visited, visits, {DOMAIN_SQL.format("url")} AS domain,
        CASE id % 10 WHEN 7 THEN 'pending' WHEN 9 THEN 'failed' ELSE 'ready' END AS snapshot_state,
        CASE WHEN id % 5 != 0 THEN trim(regexp_replace(regexp_replace(html, '{TAGS}', ' ', 'g'), '\s+', ' ', 'g')) END AS body_text, html
        FROM (SELECT url, content_hash, min(capture_id) AS id, min(title) AS title, min(captured_at) AS captured_at, max(captured_at) AS last_visited, count(*) AS visits, min(html) AS html FROM hashed GROUP BY url, content_hash)""",
    "favorites": "SELECT id AS page_id, last_visited AS created_at FROM snapshots WHERE id % 3 = 0",
    "shares": """SELECT id, id AS page_id, sha256('t' || id) AS token_hash, url, title, html_path, content_hash, captured_at, id % 16 != 0 AS allow_markdown, last_visited AS created_at,
        CASE WHEN id % 8 = 0 THEN last_visited + INTERVAL 5 DAY END AS expires_at, CASE WHEN id % 12 = 0 THEN last_visited + INTERVAL 1 DAY END AS revoked_at FROM snapshots WHERE id % 4 = 0""",
    "hrefs": f"SELECT page_id, url, unnest(regexp_extract_all(html, {_lit(HREF)}, 1)) AS path FROM pages",
    "fetch_log": """SELECT event_id AS fetch_id, 'https://static.example.com/r/' || (user_id % 200) AS url, ts AS fetched_at,
        CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 304 ELSE 200 END AS status,
        sha256((user_id % 200) || '' || (CAST(floor(value / 100) AS BIGINT) % 3)) AS content_hash,
        ['max-age=60', 'no-store', 'public, max-age=999999', 'max-age=0', '', 'private, max-age=oops'][event_id % 6 + 1] AS cache_control, value, event_id % 300 * 1000000 AS content_length FROM events""",
    "lifecycle": """SELECT event_id, user_id % 400 AS page_id, ts, CASE event_type WHEN 'view' THEN 'created' WHEN 'click' THEN 'finalized' WHEN 'signup' THEN 'updated'
        WHEN 'purchase' THEN 'retried' ELSE 'failed' END AS event FROM events""",
    "deletion_queue": """SELECT html_path, last_visited AS timestamp, id AS page_id FROM (SELECT *, max(first_visited) OVER (PARTITION BY url) AS newest FROM snapshots) WHERE first_visited < newest""",
    "log_lines": """SELECT 'archive-' || CAST(CAST(ts AS DATE) AS VARCHAR) || '.001.log' AS file, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS line_no,
        CASE event_type WHEN 'view' THEN '[HTTP] GET /view/' || user_id WHEN 'click' THEN '[Update] page ' || user_id WHEN 'error' THEN 'download failed for ' || user_id
        WHEN 'signup' THEN 'resource not found, fallback used' ELSE 'archive success ' || event_id END AS line FROM events""",
    "rich": f"SELECT page_id, url, regexp_replace(html, {_lit(HREF)}, {_lit(RICH.replace('{0}', chr(92) + '1'))}, 'g') AS html FROM pages",
}


def oracle(query: str) -> str:
    """`query` behind the derived tables that it needs."""
    need, text = [], query
    for name in reversed(SQL):
        import re

        if re.search(rf"\b{name}\b", text):
            need.append(name)
            text += " " + SQL[name]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in reversed(need)) + " " + query if need else query
