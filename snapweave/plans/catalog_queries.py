"""Queries of ingest, page reads and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, pages, shares, text
from .fixtures import BURSTS, DOMAIN_SQL
from .registry import ntz, query

LIST = "id, url, title, content_hash, epoch_us(captured_at) AS captured_at, epoch_us(first_visited) AS first_visited, epoch_us(last_visited) AS last_visited, domain, snapshot_state"
AS_OF = "2024-01-20"
KEYWORD = "tion"

# ---------------------------------------------------------------- ingest


@query("SELECT capture_id, content_hash FROM hashed")
def content_hash(t):
    return t.captures.select("capture_id", ingest.content_hash(F.col("html")).alias("content_hash"))


@query("""SELECT event_id, url FROM (SELECT event_id, ['file:///a', 'https://example.com/a', 'http://localhost:80/', 'http://10.' || (event_id % 256) || '.0.1/', 'http://172.' || (event_id % 64) || '.0.1/x', 'http://[fe80::1]/', 'https://printer.local/', 'http://8.8.8.8/'][event_id % 8 + 1] AS url FROM events)
    WHERE NOT (url LIKE 'file:%' OR url LIKE '%localhost%' OR url LIKE 'http://10.%' OR url LIKE '%.local/%' OR url LIKE '%[fe80%'
      OR (url LIKE 'http://172.%' AND TRY_CAST(split_part(substr(url, 8), '.', 2) AS INT) BETWEEN 16 AND 31))""")
def admissible_captures(t):
    made = F.expr("element_at(array('file:///a', 'https://example.com/a', 'http://localhost:80/', concat('http://10.', event_id % 256, '.0.1/'), concat('http://172.', event_id % 64, '.0.1/x'), 'http://[fe80::1]/', 'https://printer.local/', 'http://8.8.8.8/'), cast(event_id % 8 as int) + 1)")
    return t.events.select("event_id", made.alias("url")).where(ingest.admissible(F.col("url")))


@query(f"SELECT page_id, {DOMAIN_SQL.format('url')} AS domain FROM pages")
def extract_domain(t):
    return t.pages_raw.select("page_id", ingest.extract_domain(F.col("url")).alias("domain"))


@query("""SELECT n.url, n.content_hash, p.id AS page_id, CASE p.snapshot_state WHEN 'ready' THEN 'unchanged' WHEN 'failed' THEN 'retry' ELSE 'created' END AS action, n.title,
    epoch_us(n.a) AS first_visited, epoch_us(n.b) AS last_visited, n.captures
    FROM (SELECT url, content_hash, arg_min(title, (captured_at, capture_id)) AS title, min(captured_at) AS a, max(captured_at) AS b, count(*) AS captures FROM hashed GROUP BY ALL) n
    LEFT JOIN (SELECT * FROM snapshots WHERE id % 2 = 0) p USING (url, content_hash)""")
def dedup_captures(t):
    return ingest.dedup_captures(t.hashed, t.snapshots.where("id % 2 = 0"))


@query(f"SELECT capture_id, url, title, content_hash, epoch_us(captured_at) AS captured_at, epoch_us(captured_at) AS first_visited, epoch_us(captured_at) AS last_visited, {DOMAIN_SQL.format('url')} AS domain, 'pending' AS snapshot_state FROM hashed")
def new_page_rows(t):
    rows = ingest.new_page_rows(t.hashed)  # ids are Spark's hashes, so the check has the capture's
    return t.hashed.select("capture_id", "url", "content_hash", "captured_at").join(rows.drop("id").distinct(), ["url", "content_hash", "captured_at"]).select("capture_id", *[c for c in rows.columns if c != "id"])


@query("""SELECT id, url, content_hash, snapshot_state FROM (SELECT capture_id AS id, url, content_hash, CASE capture_id % 10 WHEN 7 THEN 'pending' WHEN 9 THEN 'failed' ELSE 'ready' END AS snapshot_state, captured_at FROM hashed)
    QUALIFY row_number() OVER (PARTITION BY url, content_hash ORDER BY CASE snapshot_state WHEN 'ready' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, captured_at, id) = 1""")
def pick_snapshot(t):
    state = F.expr("CASE capture_id % 10 WHEN 7 THEN 'pending' WHEN 9 THEN 'failed' ELSE 'ready' END")
    return ingest.pick_snapshot(t.hashed.select(F.col("capture_id").alias("id"), "url", "content_hash", state.alias("snapshot_state"), F.col("captured_at").alias("first_visited"))).drop("first_visited")


@query("""SELECT capture_id, coalesce(lag(captured_at) OVER (PARTITION BY url ORDER BY captured_at, capture_id) > captured_at - INTERVAL 6 HOUR, false) AS recent FROM captures""")
def recent_capture(t):
    return ingest.recent_capture(t.captures, "6 HOURS").select("capture_id", "recent")


def _updates(t):
    rows = t.snapshots.select(
        "id", F.when(F.col("id") % 6 == 0, F.lit("https://other.example.com/")).otherwise(F.col("url")).alias("url"), F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.concat("title", F.lit("!"))).alias("title"),
        F.when(F.col("id") % 3 == 0, F.col("content_hash")).otherwise(F.sha2(F.concat("content_hash", F.lit("u")), 256)).alias("content_hash"), F.concat("html_path", F.lit(".new")).alias("html_path"),
        F.when(F.col("id") % 2 == 0, F.lit("")).alias("body_text"), (F.col("last_visited") + F.expr("INTERVAL 1 HOUR")).alias("updated_at"))
    return rows


_UPDATES_SQL = """(SELECT id, CASE WHEN id % 6 = 0 THEN 'https://other.example.com/' ELSE url END AS url, CASE WHEN id % 4 != 0 THEN title || '!' END AS title,
    CASE WHEN id % 3 = 0 THEN content_hash ELSE sha256(content_hash || 'u') END AS content_hash, html_path || '.new' AS html_path, CASE WHEN id % 2 = 0 THEN '' END AS body_text, last_visited + INTERVAL 1 HOUR AS updated_at FROM snapshots) u"""


@query(f"""SELECT p.id, CASE WHEN ch THEN coalesce(u.title, p.title) ELSE p.title END AS title, CASE WHEN ch THEN u.content_hash ELSE p.content_hash END AS content_hash, CASE WHEN ch THEN u.html_path ELSE p.html_path END AS html_path,
    CASE WHEN ch THEN coalesce(u.body_text, p.body_text) ELSE p.body_text END AS body_text, CASE WHEN ch THEN 'ready' ELSE p.snapshot_state END AS snapshot_state, epoch_us(CASE WHEN p.url = u.url THEN updated_at ELSE last_visited END) AS last_visited
    FROM snapshots p JOIN (SELECT u.*, q.url = u.url AND q.content_hash != u.content_hash AS ch FROM {_UPDATES_SQL} JOIN snapshots q ON q.id = u.id) u ON p.id = u.id""")
def apply_updates(t):
    return ingest.apply_updates(t.snapshots, _updates(t))[0].select("id", "title", "content_hash", "html_path", "body_text", "snapshot_state", "last_visited")


@query(f"SELECT u.id, CASE WHEN u.url != p.url THEN 'rejected' WHEN u.content_hash = p.content_hash THEN 'unchanged' ELSE 'updated' END AS action FROM {_UPDATES_SQL} JOIN snapshots p ON p.id = u.id")
def update_actions(t):
    return ingest.apply_updates(t.snapshots, _updates(t))[1]


@query("SELECT user_id AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS title FROM events GROUP BY user_id")
def latest_update_wins(t):
    return ingest.latest_update_wins(t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("title")))


@query("""SELECT page_id, CASE WHEN f > c AND (f > g OR g IS NULL) AND (g IS NULL OR g < c) THEN 'failed' WHEN g IS NOT NULL AND g > c THEN 'ready' ELSE 'pending' END AS snapshot_state, n AS transitions FROM (
    SELECT page_id, coalesce(max((ts, event_id)) FILTER (event = 'failed'), (TIMESTAMP '1900-01-01', -1)) AS f, max((ts, event_id)) FILTER (event IN ('finalized', 'updated')) AS g,
    coalesce(max((ts, event_id)) FILTER (event IN ('created', 'retried')), (TIMESTAMP '1900-01-01', -1)) AS c, count(*) AS n FROM lifecycle GROUP BY page_id)""")
def advance_lifecycle(t):
    return ingest.advance_lifecycle(t.lifecycle)


@query("""SELECT DISTINCT page_id, crc AS resource_id FROM (SELECT page_id, length(path) % 5 AS crc FROM hrefs) WHERE crc != 0 AND NOT (page_id % 3 = 0 AND crc = 1)""")
def link_page_resources(t):
    links = t.hrefs.select("page_id", F.expr("cast(length(path) % 5 as bigint)").alias("resource_id"))
    held = links.where("page_id % 3 = 0 and resource_id = 1").distinct()
    return ingest.link_page_resources(links, held, t.resources, ntz(AS_OF))[0]


@query("""SELECT update_id FROM (SELECT user_id AS page_id, event_id AS update_id, ts, length(props) AS n FROM events) u QUALIFY n >= 0.7 * first_value(n) OVER (PARTITION BY page_id ORDER BY ts, update_id)""")
def shrink_guard(t):
    rows = t.events.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("update_id"), "ts", F.col("props").alias("html"))
    return ingest.shrink_guard(rows).select("update_id")


@query(BURSTS)
def change_bursts(t):
    return ingest.change_bursts(t.changes)


@query("""SELECT page_id, seq, key, html FROM (SELECT d.*, row_number() OVER (PARTITION BY d.page_id, d.key ORDER BY seq) AS r, coalesce(k, 0) AS k
    FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY path) AS seq, path AS key, path AS html FROM hrefs WHERE length(path) >= 4) d
    LEFT JOIN (SELECT page_id, path AS key, count(*) AS k FROM hrefs WHERE length(path) % 2 = 0 AND page_id % 2 = 0 GROUP BY ALL) USING (page_id, key)) WHERE r > k""")
def merge_fragments(t):
    from pyspark.sql.window import Window

    rows = t.hrefs.where("length(path) >= 4").select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("path")).cast("long").alias("seq"), F.col("path").alias("key"), F.col("path").alias("html"))
    return ingest.merge_fragments(t.hrefs.where("length(path) % 2 = 0 and page_id % 2 = 0").select("page_id", F.col("path").alias("key")), rows, least=4)


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '\d+:\d+ ?/ ?\d+:\d+', '', 'g'), '·\s?\d+[smhdwy]', '', 'g'))
    || coalesce(list_aggregate(list_transform(regexp_extract_all(html, '<img[^>]*\ssrc=["'']([^"'']*)', 1), lambda s: chr(1) || s), 'string_agg', ''), '') AS key FROM rich""")
def fragment_text_key(t):
    # a NUL can't be written in the oracle's text, so the check reads it as U+0001
    return t.rich.select("page_id", F.translate(ingest.fragment_text_key(F.col("html")), "\0", "\1").alias("key"))


@query("""SELECT user_id AS container_id, event_id AS ordinal, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN c >= 2 AND k * 2 >= c THEN coalesce(y, 0) ELSE 0 END, event_id) AS position FROM (
    SELECT *, count(*) OVER (PARTITION BY user_id) AS c, count(y) OVER (PARTITION BY user_id) AS k FROM (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN CAST(event_id % 97 AS DOUBLE) END AS y FROM events))""")
def order_fragments(t):
    style = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("transform:translateY("), F.expr("cast(event_id % 97 as string)"), F.lit("px)"))).otherwise("top:0")
    return ingest.order_fragments(t.events.select(F.col("user_id").alias("container_id"), F.col("event_id").alias("ordinal"), style.alias("style"))).withColumn("position", F.col("position").cast("long"))


def _framed(t):
    """Raw pages as captures whose frames are their links; some lack a field."""
    frames = F.transform(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)">'), 1), lambda p, i: F.struct(F.when(i % 7 != 6, F.concat(F.lit("k"), (i % 4).cast("string"))).alias("key"), p.alias("url"), F.lit("").alias("title"), F.concat(F.lit("<p>"), p, F.lit("</p>")).alias("html")))
    return t.pages_raw.select(F.col("page_id").alias("capture_id"), "url", "html", frames.alias("frames"))


@query("""SELECT page_id AS capture_id, 'k' || (i % 4) AS key, arg_max(path, i) AS url, '' AS title, '<p>' || arg_max(path, i) || '</p>' AS html, 'html' AS content_type
    FROM (SELECT page_id, unnest(l) AS path, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)">', 1) AS l FROM pages)) WHERE i % 7 != 6 GROUP BY page_id, i % 4""")
def explode_frames(t):
    return ingest.explode_frames(_framed(t))


@query()
def content_hash_frames(t):
    return _framed(t).select("capture_id", ingest.content_hash(F.col("html"), F.col("frames")).alias("content_hash"))


@query("SELECT page_id, ['ok', 'placeholder', 'empty'][page_id % 3 + 1] AS status FROM pages")
def frame_status(t):
    """Pages as they are, with a hidden body, and with a body of which only a script and a link are left."""
    hidden = F.regexp_replace("html", F.lit("(?i)<body"), F.lit("<body style='display: none'"))
    bare = F.concat(F.lit("<body><script>"), F.regexp_replace("html", "(?i)</?(script|body)", ""), F.lit("</script><link rel='x'> \n</body>"))
    html = F.when(F.col("page_id") % 3 == 1, hidden).when(F.col("page_id") % 3 == 2, bare).otherwise(F.col("html"))
    return t.pages_raw.select("page_id", ingest.frame_status(html).alias("status"))


@query("SELECT id FROM snapshots WHERE id % 7 != 0")
def delete_pages(t):
    out = ingest.delete_pages(t.snapshots.where("id % 7 = 0").select("id"), {"pages": t.snapshots, "favorites": t.favorites}, ntz(AS_OF))
    return out["pages"].select("id")


@query("SELECT page_id FROM favorites WHERE page_id % 7 != 0")
def delete_pages_favorites(t):
    return ingest.delete_pages(t.snapshots.where("id % 7 = 0").select("id"), {"pages": t.snapshots, "favorites": t.favorites}, ntz(AS_OF))["favorites"].select("page_id")


@query("SELECT id, epoch_us(CASE WHEN id % 2 = 0 THEN TIMESTAMP '2024-01-20' ELSE last_visited END) AS last_visited, CASE WHEN id % 4 = 0 THEN 'x' ELSE body_text END AS body_text FROM snapshots")
def touch_pages(t):
    visits = t.snapshots.where("id % 2 = 0").select("id", ntz(AS_OF).alias("last_visited"), F.when(F.col("id") % 4 == 0, "x").alias("body_text"))
    return ingest.touch_pages(t.snapshots, visits).select("id", "last_visited", "body_text")


@query()
def backfill_body_text(t):
    return ingest.backfill_body_text(t.snapshots, t.snapshots.select("html_path", "html"), text.body_text)


@query(f"SELECT id, {DOMAIN_SQL.format('url')} AS domain, CASE WHEN id % 2 = 0 THEN snapshot_state ELSE 'ready' END AS snapshot_state, epoch_us(captured_at) AS captured_at FROM snapshots")
def upgrade_tables(t):
    old = t.snapshots.select("id", "url", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.col("domain")).alias("domain"), F.when(F.col("id") % 2 == 0, F.col("snapshot_state")).alias("snapshot_state"), F.expr("CAST(captured_at AS STRING)").alias("captured_at"))
    return ingest.upgrade_tables(old).drop("url")


# ---------------------------------------------------------------- page queries


@query(f"SELECT {LIST} FROM snapshots ORDER BY coalesce(snapshots.last_visited, snapshots.captured_at) DESC, id DESC LIMIT 100")
def list_pages(t):
    return pages.list_pages(t.snapshots)


@query("SELECT count(*) AS total FROM snapshots WHERE captured_at >= '2024-01-02' AND captured_at < TIMESTAMP '2024-01-20' + INTERVAL 1 DAY AND (domain = 'example.com' OR domain LIKE '%.example.com')")
def count_pages(t):
    return pages.count_pages(t.snapshots, "2024-01-02", "2024-01-20", "example.com")


@query("SELECT id FROM snapshots WHERE captured_at >= '2024-01-02' AND captured_at < TIMESTAMP '2024-01-20' + INTERVAL 1 DAY")
def date_range_filter(t):
    return t.snapshots.where(pages.date_range_filter("2024-01-02", "2024-01-20")).select("id")


@query("SELECT id FROM snapshots WHERE domain = 'example.org' OR ends_with(domain, '.example.org')")
def domain_filter(t):
    return t.snapshots.where(pages.domain_filter("example.org")).select("id")


@query('SELECT id, (SELECT count(*) FROM snapshots) AS total, 50 AS "limit", 100 AS "offset" FROM snapshots ORDER BY coalesce(last_visited, captured_at) DESC, id DESC LIMIT 50 OFFSET 100')
def paginate(t):
    return pages.paginate(t.snapshots, 50, 100)


@query(f"SELECT {LIST}, id IN (SELECT page_id FROM favorites) AS is_favorite FROM snapshots WHERE id = 33")
def get_page(t):
    return pages.get_page(t.snapshots, t.favorites, 33)


_FOUND = f"(contains(lower(url), '{KEYWORD}') OR contains(lower(title), '{KEYWORD}') OR contains(lower(coalesce(body_text, '')), '{KEYWORD}'))"
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_MARK = "CASE WHEN contains(lower({0}), '" + KEYWORD + "') THEN regexp_replace(" + _ESC + ", '(?i)(" + KEYWORD + ")', '<mark>\\1</mark>', 'g') ELSE '' END"


@query(f"""SELECT id, {_MARK.format("url")} AS url_highlight, {_MARK.format("title")} AS title_highlight FROM snapshots WHERE {_FOUND} ORDER BY coalesce(last_visited, captured_at) DESC, id DESC LIMIT 100""")
def search_pages(t):
    return pages.search_pages(t.snapshots, KEYWORD).select("id", "url_highlight", "title_highlight")


@query(f"SELECT count(*) AS total FROM snapshots WHERE {_FOUND}")
def search_count(t):
    return pages.search_count(t.snapshots, KEYWORD)


@query(f"SELECT id FROM snapshots WHERE contains(lower(url || chr(10) || coalesce(title, '') || chr(10) || coalesce(body_text, '')), '{KEYWORD}')")
def concat_search(t):
    return t.snapshots.where(pages.concat_filter(KEYWORD)).select("id")


@query(f"SELECT id, {_MARK.format('title')} AS marked FROM snapshots")
def highlight_term(t):
    return t.snapshots.select("id", pages.highlight_term(F.col("title"), KEYWORD).alias("marked"))


_CUT = "substr(b, greatest(p - 80, 1), least(p + 3 + 80, length(b)) - greatest(p - 80, 1) + 1)"


@query(f"""SELECT id, CASE WHEN p = 0 THEN '' ELSE (CASE WHEN p - 80 > 1 THEN '...' ELSE '' END) || {_MARK.format(_CUT)} || (CASE WHEN p + 83 < length(b) THEN '...' ELSE '' END) END AS snippet
    FROM (SELECT id, b, instr(lower(b), '{KEYWORD}') AS p FROM (SELECT id, coalesce(body_text, '') AS b FROM snapshots))""")
def search_snippet(t):
    return t.snapshots.select("id", pages.search_snippet(F.col("body_text"), KEYWORD).alias("snippet"))


_URL = "(SELECT min(url) FROM pages)"


@query(f"SELECT {LIST}, count(*) OVER () AS total FROM snapshots WHERE url = {_URL}")
def timeline(t):
    first = t.pages_raw.agg(F.min("url").alias("url"))
    rows = t.snapshots.join(F.broadcast(first), "url", "left_semi")
    from pyspark.sql.window import Window

    return rows.select(*pages.LIST_COLUMNS, F.count("*").over(Window.partitionBy("url")).alias("total"))


@query("""SELECT id, url, row_number() OVER w = 1 AS latest, coalesce(lag(content_hash) OVER w != content_hash, false) AS changed, first_visited IS DISTINCT FROM last_visited AS revisited FROM snapshots
    WINDOW w AS (PARTITION BY url ORDER BY first_visited DESC, id DESC)""")
def timeline_changes(t):
    return pages.timeline_changes(t.snapshots)


@query("""SELECT id, url, (SELECT arg_max(b.id, (b.first_visited, b.id)) FROM snapshots b WHERE b.url = a.url AND b.first_visited < a.first_visited) AS prev_id,
    (SELECT arg_min(b.id, (b.first_visited, -b.id)) FROM snapshots b WHERE b.url = a.url AND b.first_visited > a.first_visited) AS next_id, count(*) OVER (PARTITION BY url) AS total FROM snapshots a""")
def snapshot_neighbors(t):
    return pages.snapshot_neighbors(t.snapshots)


@query(f"SELECT {LIST}, epoch_us(f.created_at) AS favorited_at FROM snapshots JOIN favorites f ON f.page_id = id ORDER BY f.created_at DESC, id DESC LIMIT 100")
def favorites_list(t):
    return pages.favorites_list(t.snapshots, t.favorites)


@query(f"SELECT id, epoch_us(f.created_at) AS favorited_at FROM snapshots JOIN favorites f ON f.page_id = id WHERE {_FOUND}")
def favorites_search(t):
    return pages.favorites_search(t.snapshots, t.favorites, KEYWORD).select("id", "favorited_at")


@query("SELECT count(*) AS total FROM favorites")
def favorites_count(t):
    return pages.favorites_count(t.snapshots, t.favorites)


@query(f"SELECT count(*) AS total FROM snapshots JOIN favorites f ON f.page_id = id WHERE {_FOUND}")
def favorites_search_count(t):
    return pages.favorites_count(t.snapshots, t.favorites, KEYWORD)


@query("SELECT id, id % 3 = 0 AS is_favorite FROM snapshots")
def favorite_flags(t):
    return pages.favorite_flags(t.snapshots.select("id"), t.favorites)


@query("SELECT id AS page_id, epoch_us(CASE WHEN id % 3 = 0 THEN last_visited ELSE TIMESTAMP '2024-01-20' END) AS created_at FROM snapshots WHERE id % 3 = 0 OR id % 5 = 0")
def add_favorites(t):
    new = t.snapshots.where("id % 5 = 0").select(F.col("id").alias("page_id")).unionByName(t.events.where("event_id < 5").select((-F.col("event_id") - 1).alias("page_id"))).withColumn("created_at", ntz(AS_OF))
    return pages.add_favorites(t.favorites, new, t.snapshots)


@query("SELECT page_id FROM favorites WHERE page_id % 2 = 1")
def remove_favorites(t):
    return pages.remove_favorites(t.favorites, t.snapshots.where("id % 2 = 0").select(F.col("id").alias("page_id"))).select("page_id")


# ---------------------------------------------------------------- shares


@query("SELECT id, sha256('t' || id) AS token_hash FROM snapshots")
def share_token_hash(t):
    return t.snapshots.select("id", shares.share_token_hash(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("token_hash"))


@query("""SELECT id, page_id, url, title, html_path, content_hash, allow_markdown, sha256('s' || id) AS token_hash FROM (SELECT id, id AS page_id, url, title, html_path, content_hash, id % 4 != 0 AS allow_markdown FROM snapshots
    WHERE snapshot_state = 'ready' AND id % 5 != 0)""")
def create_shares(t):
    requests = t.snapshots.select("id", F.col("id").alias("page_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("token"), F.when(F.col("id") % 4 == 0, False).alias("allow_markdown"), F.when(F.col("id") % 5 == 0, ntz("2024-01-01")).alias("expires_at"))
    out, _ = shares.create_shares(requests, t.snapshots, t.page_resources, ntz(AS_OF))
    return out.select("id", "page_id", "url", "title", "html_path", "content_hash", "allow_markdown", "token_hash")


@query("SELECT id, token_hash FROM shares WHERE revoked_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20')")
def active_shares(t):
    return shares.active_shares(t.shares, ntz(AS_OF)).select("id", "token_hash")


@query("SELECT id, epoch_us(created_at) AS created_at FROM shares WHERE page_id = 40")
def list_shares(t):
    return shares.list_shares(t.shares, 40).select("id", "created_at")


@query("SELECT id, epoch_us(coalesce(revoked_at, CASE WHEN id % 20 = 0 THEN TIMESTAMP '2024-01-20' END)) AS revoked_at FROM shares")
def revoke_shares(t):
    return shares.revoke_shares(t.shares, t.snapshots.where("id % 20 = 0").select("id"), ntz(AS_OF)).select("id", "revoked_at")


@query("SELECT DISTINCT html_path FROM shares WHERE revoked_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20')")
def protected_html(t):
    return shares.protected_html(t.shares, ntz(AS_OF))


@query(r"""SELECT id, replace(regexp_replace(h, '/archive/\d+/(\d+(?:[a-z]+_)?)/', '/share/t' || id || '/archive/\1/', 'g'), '/archive/resources/', '/share/t' || id || '/resources/') AS html
    FROM (SELECT id, '<a href="/archive/' || id || '/20240101mp_/' || url || '"><img src="/archive/resources/' || content_hash || '">' AS h FROM snapshots)""")
def rewrite_for_share(t):
    html = F.concat(F.lit('<a href="/archive/'), F.col("id").cast("string"), F.lit("/20240101mp_/"), F.col("url"), F.lit('"><img src="/archive/resources/'), F.col("content_hash"), F.lit('">'))
    return t.snapshots.select("id", shares.rewrite_for_share(html, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("html"))
