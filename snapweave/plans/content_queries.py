"""Queries of resources, extraction, safety, content types and logs."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import extract, logs, mime, networks, resources, security
from .fixtures import DOMAIN_SQL
from .registry import ntz, query

#: Resources as the oracle can make them.
R = """(SELECT CAST('0x' || substr(md5(path), 1, 12) AS BIGINT) * 2 + v AS id, 'https://static.example.com' || path AS url, sha256(path || (v * (last_page % 2))) AS content_hash, 'resources/' || path AS file_path,
    ['image','css','js','font','other'][first_page % 5 + 1] AS resource_type, length(path) * 1000 AS file_size, TIMESTAMP '2024-01-01' + to_minutes(CAST((last_page + v) % 1440 AS BIGINT)) AS last_seen, first_page % 17 = 0 AS is_quarantined, path, v
    FROM (SELECT path, min(page_id) AS first_page, max(page_id) AS last_page FROM hrefs GROUP BY path), (VALUES (0), (1)) t(v))"""


def linked(t):
    """Pages and the resources of their links."""
    return t.page_resources


L = f"(SELECT DISTINCT h.page_id, r.id AS resource_id FROM hrefs h JOIN {R} r USING (path))"


#: The first version of one link's resource.
ONE = int(hashlib.md5(b"/to").hexdigest()[:12], 16) * 2


@query(f"SELECT id, url, file_size FROM {R} WHERE id = {ONE}")
def resource_by_id(t):
    return resources.resource_by_id(t.resources, ONE).select("id", "url", "file_size")


@query(f"SELECT content_hash, arg_max(id, (last_seen, id)) AS id FROM {R} WHERE NOT is_quarantined GROUP BY content_hash")
def latest_by_hash(t):
    return resources.latest_by_hash(t.resources).select("content_hash", "id")


@query(f"SELECT url, arg_max(id, (last_seen, id)) AS id FROM {R} WHERE NOT is_quarantined GROUP BY url")
def latest_by_url(t):
    return resources.latest_by_url(t.resources).select("url", "id")


@query(f"SELECT id, url FROM {R} WHERE url LIKE '%/th%' ORDER BY last_seen DESC, id DESC LIMIT 1")
def latest_by_url_like(t):
    return resources.latest_by_url_like(t.resources, "%/th%").select("id", "url")


@query(f"SELECT l.page_id, r.id AS resource_id, r.url FROM {L} l JOIN {R} r ON r.id = l.resource_id")
def page_resources(t):
    return resources.page_resources(linked(t), t.resources).select("page_id", "resource_id", "url")


@query(f"""SELECT page_id, ref, arg_min(id, (step, -epoch_us(last_seen), -id)) AS resource_id, least(min(step), 5) AS step FROM (
    SELECT p.page_id, p.ref, r.id, r.last_seen, CASE WHEN r.url = p.ref THEN 1 WHEN r.url = regexp_replace(p.ref, '\\?.*$', '') THEN 5 END AS step
    FROM (SELECT DISTINCT page_id, 'https://static.example.com' || path || CASE WHEN length(path) % 2 = 0 THEN '?v=1' ELSE '' END AS ref FROM hrefs) p JOIN {L} l USING (page_id) JOIN {R} r ON r.id = l.resource_id) WHERE step IS NOT NULL GROUP BY page_id, ref""")
def resolve_page_resource(t):
    refs = t.hrefs.select("page_id", F.concat(F.lit("https://static.example.com"), "path", F.when(F.length("path") % 2 == 0, "?v=1").otherwise("")).alias("ref")).distinct()
    return resources.resolve_page_resource(refs, linked(t), t.resources)


@query(f"""SELECT page_id AS share_id, ref, arg_max(id, (last_seen, id)) AS resource_id, 1 AS step FROM (SELECT l.page_id, r.url AS ref, r.id, r.last_seen FROM {L} l JOIN {R} r ON r.id = l.resource_id WHERE l.page_id % 4 = 0 AND l.resource_id % 3 != 0) GROUP BY ALL""")
def shared_resource_lookup(t):
    from ..operators import shares

    pins = linked(t).where("page_id % 4 = 0 and resource_id % 3 != 0").withColumnRenamed("page_id", "share_id")
    refs = t.hrefs.select(F.col("page_id").alias("share_id"), F.concat(F.lit("https://static.example.com"), "path").alias("ref")).distinct()
    return shares.shared_resource_lookup(refs, pins, t.resources)


@query(f"""SELECT page_id, ref, coalesce(own, anywhere) AS resource_id, own IS NOT NULL AS linked FROM (SELECT DISTINCT page_id, 'https://static.example.com' || path AS ref FROM hrefs)
    LEFT JOIN (SELECT l.page_id, r.url AS ref, arg_max(r.id, (r.last_seen, r.id)) AS own FROM {L} l JOIN {R} r ON r.id = l.resource_id WHERE l.page_id % 2 = 0 GROUP BY ALL) USING (page_id, ref)
    LEFT JOIN (SELECT url AS ref, arg_max(id, (last_seen, id)) AS anywhere FROM {R} GROUP BY url) USING (ref)""")
def resource_by_url_and_page(t):
    refs = t.hrefs.select("page_id", F.concat(F.lit("https://static.example.com"), "path").alias("ref")).distinct()
    return resources.resource_by_url_and_page(refs, linked(t).where("page_id % 2 = 0"), t.resources)


@query("""SELECT fetch_id, CASE WHEN status = 200 AND r < (fetched_at, fetch_id) THEN 'reuse' WHEN status = 200 AND f < (fetched_at, fetch_id) THEN 'share' WHEN status = 200 THEN 'create' WHEN last IS NULL THEN 'error' WHEN status = 304 THEN 'cached' ELSE 'fallback' END AS action,
    CASE WHEN status = 200 AND r < (fetched_at, fetch_id) THEN r[2] WHEN status = 200 THEN f[2] ELSE last END AS source_fetch
    FROM (SELECT *, min((fetched_at, fetch_id)) FILTER (status = 200) OVER (PARTITION BY url, content_hash) AS r, min((fetched_at, fetch_id)) FILTER (status = 200) OVER (PARTITION BY content_hash) AS f,
    last_value(CASE WHEN status = 200 THEN fetch_id END IGNORE NULLS) OVER (PARTITION BY url ORDER BY fetched_at, fetch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM fetch_log)""")
def resolve_fetches(t):
    return resources.resolve_fetches(t.fetch_log)


@query("""SELECT fetch_id, epoch_us(CASE event_id_mod WHEN 0 THEN fetched_at + INTERVAL 60 SECOND WHEN 2 THEN fetched_at + INTERVAL 7200 SECOND END) AS fresh_until FROM (SELECT fetch_id, fetched_at, fetch_id % 6 AS event_id_mod FROM fetch_log)""")
def freshness(t):
    return t.fetch_log.select("fetch_id", resources.freshness(F.col("cache_control"), F.lit(None).cast("string"), F.col("fetched_at")).alias("fresh_until"))


_STATE = "CASE WHEN length(path) % 7 = 0 THEN 'missing' WHEN length(path) % 5 = 0 THEN 'mismatch' ELSE 'ok' END"


def _files(t):
    rows = t.resources.groupBy("file_path").agg(F.min_by("content_hash", "id").alias("file_hash"))
    n = F.length("file_path") - len("resources/")
    return rows.where(n % 7 != 0).select("file_path", F.when(n % 5 == 0, F.lit("bad")).otherwise(F.col("file_hash")).alias("file_hash"))


@query(f"SELECT file_path, {_STATE} AS state, count(*) AS resources FROM {R} WHERE NOT is_quarantined GROUP BY file_path, path")
def integrity_scan(t):
    return resources.integrity_scan(t.resources, _files(t))


@query(f"""SELECT count(*) AS scanned_resources, count(DISTINCT file_path) AS scanned_files, count(DISTINCT file_path) FILTER (s = 'mismatch') AS corrupted, count(DISTINCT file_path) FILTER (s = 'missing') AS missing, count(*) FILTER (s != 'ok') AS quarantined
    FROM (SELECT *, {_STATE} AS s FROM {R} WHERE NOT is_quarantined)""")
def integrity_totals(t):
    return resources.integrity_totals(t.resources, _files(t))


@query(f"SELECT id, is_quarantined OR {_STATE} != 'ok' AS is_quarantined, CASE WHEN NOT is_quarantined AND {_STATE} != 'ok' THEN {_STATE} ELSE '' END AS quarantine_reason, CASE WHEN NOT is_quarantined AND {_STATE} != 'ok' THEN 'quarantine/' ELSE '' END || file_path AS file_path FROM {R}")
def quarantine(t):
    return resources.quarantine(t.resources, resources.integrity_scan(t.resources, _files(t))).select("id", "is_quarantined", "quarantine_reason", "file_path")


@query("SELECT html_path, page_id FROM deletion_queue WHERE timestamp < TIMESTAMP '2024-01-30' - INTERVAL 1 DAY AND html_path NOT IN (SELECT html_path FROM shares WHERE revoked_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-20'))")
def retention_plan(t):
    from ..operators.shares import protected_html

    return resources.retention_plan(t.deletion_queue, protected_html(t.shares, ntz("2024-01-20")), ntz("2024-01-30"), 1)[0].select("html_path", "page_id")


@query("SELECT fetch_id FROM fetch_log WHERE content_length <= 200 * 1024 * 1024")
def size_limits(t):
    return resources.size_limits(t.fetch_log)[0].select("fetch_id")


# ---------------------------------------------------------------- extraction


def _tag_sql(tag: str, attr: str) -> str:
    return rf"""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<{tag}\b[^>]*?\s{attr}\s*=\s*["'']([^"'']+)["'']', 1)) AS target FROM rich"""


def _urls(t, column):
    return t.rich.select("page_id", F.explode(column).alias("target"))


@query(_tag_sql("img", "src"))
def extract_img(t):
    return _urls(t, extract.extract_img(F.col("html")))


@query(_tag_sql("script", "src"))
def extract_script(t):
    return _urls(t, extract.extract_script(F.col("html")))


@query(_tag_sql("iframe", "src"))
def extract_iframe(t):
    return _urls(t, extract.extract_iframe(F.col("html")))


@query("""SELECT page_id, path || x.e AS target, x.t AS type FROM hrefs CROSS JOIN (VALUES ('.css', 'css'), ('.ico', 'image'), ('.woff2', 'font')) x(e, t)""")
def extract_link(t):
    return t.rich.select("page_id", F.inline(extract.extract_link(F.col("html")))).withColumnRenamed("url", "target")


@query("SELECT page_id, path || x.e AS target, x.t AS type FROM hrefs CROSS JOIN (VALUES ('.jpg', 'image'), ('.mp4', 'other')) x(e, t)")
def extract_media(t):
    return t.rich.select("page_id", F.inline(extract.extract_media(F.col("html")))).withColumnRenamed("url", "target")


@query("SELECT page_id, path || x.e AS target FROM hrefs CROSS JOIN (VALUES ('.png'), ('@2x.png')) x(e)")
def extract_srcset(t):
    return _urls(t, extract.extract_srcset(F.col("html")))


@query(r"""SELECT page_id, list_aggregate(list_transform(list_zip(regexp_extract_all(v, '([^\s,]\S*[^\s,]|[^\s,])(?:,+|\s+([^,]*))?', 1), regexp_extract_all(v, '([^\s,]\S*[^\s,]|[^\s,])(?:,+|\s+([^,]*))?', 2)), lambda x: trim(x[1] || ' ' || trim(coalesce(x[2], '')))), 'string_agg', ', ') AS joined
    FROM (SELECT page_id, url || ' 1x, ' || url || '.b 2x, ' || url || '/c,' AS v FROM pages)""")
def parse_srcset(t):
    value = F.concat("url", F.lit(" 1x, "), "url", F.lit(".b 2x, "), "url", F.lit("/c,"))
    return t.pages_raw.select("page_id", extract.join_srcset(extract.parse_srcset(value)).alias("joined"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, 'url\(\s*["'']?([^"'')]+?)["'']?\s*\)', 1)) AS target FROM rich""")
def extract_inline_css_urls(t):
    return _urls(t, extract.extract_inline_css_urls(F.col("html")))


@query("""SELECT page_id, list_aggregate(list_concat(['/base.css'], list_distinct_sorted), 'string_agg', ' ') AS targets FROM (SELECT page_id, list(DISTINCT path || '.png' ORDER BY path || '.png') AS list_distinct_sorted FROM hrefs GROUP BY page_id)""")
def extract_css_urls(t):
    css = t.hrefs.groupBy("page_id").agg(F.array_sort(F.collect_list("path")).alias("p"))
    text = F.concat(F.lit("@import '/base.css'; "), F.array_join(F.transform("p", lambda p: F.concat(F.lit("a{background:url(\""), p, F.lit('.png")}'))), " "))
    found = extract.extract_css_urls(text)
    return css.select("page_id", F.concat_ws(" ", F.slice(found, 1, 1), F.array_sort(F.slice(found, 2, 100000))).alias("targets"))


def _sheets(t):
    sheets = t.hrefs.select("page_id", F.concat(F.lit("https://static.example.com"), F.col("path"), F.lit("/s.css")).alias("css_url")).distinct()
    return sheets, sheets.select("css_url", F.lit("@import 'base.css'; a{background:url(../i.png)} b{background:url('data:x')}").alias("css")).distinct()


@query("""SELECT DISTINCT page_id, 'https://static.example.com' || u AS resource_url, ty AS type FROM hrefs h, LATERAL (VALUES (CASE WHEN regexp_matches(h.path, '[?#]') THEN '' ELSE h.path END || '/base.css', 'css'), ('/i.png', 'image')) x(u, ty)""")
def css_subresources(t):
    return extract.css_subresources(*_sheets(t))


@query(r"""SELECT page_id, CASE WHEN x.e = '.js' THEN 'https://cdn.example.org' WHEN x.e = '.html' THEN origin || up || 'frames' ELSE origin END || path || x.e AS resource_url, x.t AS type
    FROM (SELECT DISTINCT page_id, path, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*/)', 1), '[^/]+/$', '') AS up FROM hrefs) CROSS JOIN (VALUES ('.png', 'image'), ('@2x.png', 'image'), ('.css', 'css'), ('.ico', 'image'),
    ('.woff2', 'font'), ('.js', 'js'), ('.html', 'html'), ('.jpg', 'image'), ('.mp4', 'other'), ('-bg.png', 'image')) x(e, t)""")
def extract_resources(t):
    return extract.extract_resources(t.rich)


@query()
def resolve_url(t):
    return extract.found_references(t.rich).select("page_id", "ord", extract.resolve_url("url", "raw").alias("resolved"))


_MADE = "['https://a.example.com/x', 'ftp://a.example.com/', 'http://localhost/x', 'http://127.0.0.1/', 'https://a.example.com/${x}', 'https://a.example.com/%7B%7Bx', 'javascript:void(0)', 'https://b.example.com/' || event_id]"
_SPARK_MADE = "array('https://a.example.com/x', 'ftp://a.example.com/', 'http://localhost/x', 'http://127.0.0.1/', concat('https://a.example.com/$', '{x}'), 'https://a.example.com/%7B%7Bx', 'javascript:void(0)', concat('https://b.example.com/', event_id))"


@query(f"SELECT event_id, event_id % 8 IN (0, 7) AS fetchable FROM (SELECT event_id, {_MADE}[event_id % 8 + 1] AS u FROM events)")
def is_fetchable(t):
    made = t.events.select("event_id", F.expr(f"element_at({_SPARK_MADE}, cast(event_id % 8 as int) + 1)").alias("u"))
    return made.select("event_id", extract.is_fetchable(F.col("u")).alias("fetchable"))


_EXT = "['.woff2', '.PNG', '.html', '.css?v=1', '.js#a', '.svg', '']"


@query(f"SELECT event_id, ['font', 'image', 'html', 'other', 'other', 'image', 'other'][event_id % 7 + 1] AS guessed, ['font', 'image', 'html', 'css', 'js', 'image', 'other'][event_id % 7 + 1] AS by_suffix, ({_EXT})[event_id % 7 + 1] AS ext FROM events")
def guess_type(t):
    ext = F.expr("element_at(array('.woff2', '.PNG', '.html', '.css?v=1', '.js#a', '.svg', ''), cast(event_id % 7 as int) + 1)")
    url = F.concat(F.lit("https://a.example.com/"), F.col("event_id").cast("string"), F.col("ext"))
    return t.events.select("event_id", ext.alias("ext")).select("event_id", extract.guess_type(url).alias("guessed"), extract.suffix_type(url).alias("by_suffix"), "ext")


@query("SELECT page_id, 100 + page_id AS width, 50 AS height, 1.5 AS dpr FROM pages WHERE page_id % 3 != 0".replace("100 + page_id", "CAST(100 + page_id AS INT)").replace("1.5", "CAST(1.5 AS DOUBLE)"))
def viewport_meta(t):
    width = F.when(F.col("page_id") % 3 == 0, 0).otherwise(100 + F.col("page_id"))
    html = extract.viewport_meta(F.col("html"), width, F.lit(50), F.lit(1.5))
    return t.pages_raw.select("page_id", extract.read_viewport(html).alias("v")).select("page_id", "v.*").where("width is not null")


# ---------------------------------------------------------------- safety


@query(f"""SELECT host, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host ELSE list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') END AS root FROM (SELECT DISTINCT {DOMAIN_SQL.format("url")} AS host FROM pages)""")
def root_domain(t):
    hosts = t.pages_raw.select(security.host(F.col("url")).alias("host"))
    return security.root_domain(hosts, security.suffix_rules(t.spark))


@query("""SELECT event_id, CASE WHEN event_id % 8 = 4 THEN ['ok', 'private', 'metadata'][event_id // 8 % 3 + 1] ELSE ['bad_scheme', 'no_host', 'private', 'metadata', 'ok', CASE WHEN event_id % 256 BETWEEN 16 AND 31 THEN 'private' ELSE 'ok' END, 'private', 'ok'][event_id % 8 + 1] END AS verdict FROM events""")
def classify_fetch_url(t):
    url = F.expr("element_at(array('ftp://a.example.com/', 'http:///x', 'http://10.1.2.3/', 'http://169.254.169.254/latest', 'https://a.example.com/', concat('http://172.', event_id % 256, '.3.4/'), 'https://b.example.com/', 'http://8.8.8.8/'), cast(event_id % 8 as int) + 1)")
    mapped = F.expr("element_at(array('::ffff:8.8.8.8', '::ffff:a00:1', '::FFFF:169.254.169.254'), cast(event_id div 8 % 3 as int) + 1)")
    ips = F.when(F.col("event_id") % 8 == 6, F.array(F.lit("8.8.4.4"), F.lit("fd00::1"))).when(F.col("event_id") % 8 == 4, F.array(mapped))
    return t.events.select("event_id", security.classify_fetch_url(url, ips).alias("verdict"))


@query("""SELECT event_id, CASE WHEN user_id % 32 > 24 THEN 'ten' WHEN event_id % 8 = user_id % 32 % 8 THEN 't' || user_id % 32 ELSE 'n' || user_id % 32 END AS label FROM events""")
def network_of_address(t):
    """Addresses, half of them written as IPv6, in networks of four sizes made of the nations."""
    ip = F.expr("concat(if(event_id % 2 = 0, '::FFFF:', ''), '10.', user_id % 32, '.', event_id % 8, '.', event_id % 256)")
    k = F.col("n_nationkey").cast("string")
    own = F.array(F.struct(F.concat(F.lit("10."), k, F.lit(".0.0/16")).alias("network"), F.concat(F.lit("n"), k).alias("label")), F.struct(F.concat(F.lit("10."), k, F.lit("."), (F.col("n_nationkey") % 8).cast("string"), F.lit(".0/24")).alias("network"), F.concat(F.lit("t"), k).alias("label")), F.struct(F.lit("10.0.0.0/8").alias("network"), F.lit("ten").alias("label")), F.struct(F.lit("::/0").alias("network"), F.lit("all").alias("label")))
    nets = t.read("nation").select(F.explode(own).alias("n")).select("n.*").distinct()
    return networks.locate(t.events.select("event_id", ip.alias("ip")), "ip", nets).select("event_id", "label")


@query("SELECT event_id, [true, false, false, true, false, true][event_id % 6 + 1] AS safe FROM events")
def safe_path(t):
    path = F.expr("element_at(array(concat('a/b/', event_id), '/etc/passwd', '../x', 'a/../b', 'a/../../b', './a//b'), cast(event_id % 6 as int) + 1)")
    return t.events.select("event_id", security.safe_path(path).alias("safe"))


def _cookies(t):
    """Every raw page asks for resources of its host; ten users' events set cookies."""
    res = t.hrefs.select(F.col("page_id").alias("capture_id"), F.concat(F.col("page_id").cast("string"), F.lit("|"), F.col("path")).alias("resource_id"), F.concat(F.lit("https://"), security.host(F.col("url")), F.col("path")).alias("url")).distinct()
    res = res.withColumns({"site": F.lit("https://x"), "page_site": F.lit("https://x")})
    cookies = t.pages_raw.select(F.col("page_id").alias("capture_id"), security.host(F.col("url")).alias("h")).select(
        "capture_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), F.concat(F.lit(d), F.col("h")).alias("domain"), F.lit(p).alias("path"), F.lit(e).cast("double").alias("expires"), F.lit(s).alias("secure"), F.lit(w).alias("same_site"), F.lit(False).alias("session"), F.lit(ho).alias("host_only"), F.lit(None).cast("string").alias("partition_key"))
        for n, v, d, p, e, s, w, ho in (("a", "1", "", "/", None, False, "lax", True), ("b", "2", ".", "/the", 2e9, True, "", False), ("old", "3", "", "/", 1.0, False, "", False), ("x", "4", "other.", "/", None, False, "", True))])).alias("c")).select("capture_id", "c.*")
    return security.match_cookies(res, cookies, F.lit(1.7e9))


@query("SELECT DISTINCT page_id || '|' || path AS resource_id, name, value, p AS path FROM hrefs CROSS JOIN (VALUES ('a', '1', '/'), ('b', '2', '/the')) c(name, value, p) WHERE name = 'a' OR path = '/the' OR starts_with(path, '/the/')")
def match_cookies(t):
    return _cookies(t)


@query("SELECT DISTINCT page_id || '|' || path AS resource_id, CASE WHEN path = '/the' OR starts_with(path, '/the/') THEN 'b=2; a=1' ELSE 'a=1' END AS header FROM hrefs")
def cookie_header(t):
    return security.cookie_header(_cookies(t))


# ---------------------------------------------------------------- content types


@query("SELECT event_id, ['text/css', 'image/png', 'font/woff2', 'application/json', 'application/javascript', 'image/webp', 'application/octet-stream'][event_id % 7 + 1] AS content_type FROM events")
def content_type(t):
    kind = F.expr("element_at(array('css', 'image', 'font', 'other', 'js', 'image', 'other'), cast(event_id % 7 as int) + 1)")
    url = F.concat(F.lit("https://a.example.com/"), F.col("event_id").cast("string"), F.expr("element_at(array('.x', '.png?a=1', '', '?format=json', '.js', '', '.unknown'), cast(event_id % 7 as int) + 1)"))
    path = F.expr("element_at(array('a.css', 'a.img', 'a.font', 'a.bin', 'a.js', 'a.webp', 'a.bin'), cast(event_id % 7 as int) + 1)")
    return t.events.select("event_id", mime.content_type(kind, url, path).alias("content_type"))


@query("SELECT page_id, path, 'image/png' AS content_type FROM (SELECT DISTINCT page_id, path || '.png' AS path FROM hrefs)")
def content_type_by_path(t):
    return t.hrefs.select("page_id", F.concat("path", F.lit(".png")).alias("path")).distinct().withColumn("content_type", mime.content_type_by_path(F.col("path")))


@query("SELECT event_id, ['font/woff', 'font/woff2', 'font/otf', 'font/ttf', NULL][event_id % 5 + 1] AS content_type FROM events")
def font_magic(t):
    first = F.expr("element_at(array('wOFF', 'wOF2', 'OTTO', 'true', 'none'), cast(event_id % 5 as int) + 1)")
    return t.events.select("event_id", mime.font_magic(F.concat(first, F.col("props")).cast("binary")).alias("content_type"))


@query("SELECT page_id, page_id % 4 != 2 AS html FROM pages")
def looks_like_html(t):
    """Pages, pages behind white space, texts without any tag, and such under a name of html."""
    body = F.when(F.col("page_id") % 4 == 1, F.concat(F.lit(" \n\t"), "html")).when(F.col("page_id") % 4 > 1, F.concat(F.lit("plain "), F.regexp_replace("html", "[<>]", " "))).otherwise(F.col("html"))
    url = F.concat(F.lit("https://a.example.com/p"), F.when(F.col("page_id") % 4 == 3, ".HTML?x=1").otherwise("/x"))
    return t.pages_raw.select("page_id", mime.looks_like_html(url, body).alias("html"))


# ---------------------------------------------------------------- logs


@query("SELECT file, line_no, line FROM log_lines QUALIFY line_no > max(line_no) OVER (PARTITION BY file) - 50")
def log_tail(t):
    return logs.log_tail(t.log_lines, 50)


@query("SELECT file, line_no FROM log_lines WHERE contains(lower(line), 'update')")
def log_grep(t):
    return logs.log_grep(t.log_lines, "UPDATE").select("file", "line_no")


@query("""SELECT file, line_no, CAST(stop - strlen(line) - 1 AS BIGINT) AS start, min(stop - strlen(line) - 1) OVER (PARTITION BY file) > 0 AS has_more_before, max(stop) OVER (PARTITION BY file) < total AS has_more_after
    FROM (SELECT *, max(stop) OVER (PARTITION BY file) AS total FROM (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY line_no) AS stop FROM log_lines)) WHERE stop - strlen(line) - 1 >= 500 AND stop <= 2500""")
def log_range(t):
    return logs.log_range(t.log_lines, 500, 2000).select("file", "line_no", "start", "has_more_before", "has_more_after")


@query("""SELECT file, CASE WHEN line LIKE '%failed%' THEN 'error' WHEN line LIKE '%fallback%' THEN 'warn' WHEN line LIKE '[Update]%' THEN 'update' WHEN line LIKE '[HTTP]%' THEN 'http' WHEN line LIKE '%success%' THEN 'success' ELSE 'none' END AS level, count(*) AS lines FROM log_lines GROUP BY ALL""")
def log_level(t):
    return logs.level_counts(t.log_lines)


@query("SELECT DISTINCT file FROM log_lines WHERE CAST(substr(file, 9, 10) AS DATE) < DATE '2024-01-20' - 7")
def log_retention(t):
    return logs.log_retention(t.log_lines.select("file").distinct(), ntz("2024-01-20"))


@query("""SELECT fetch_id, CASE WHEN content_length >= 1048576 THEN printf('%.2f MB', content_length / 1048576.0) WHEN content_length >= 1024 THEN printf('%.2f KB', content_length / 1024.0) ELSE content_length || ' B' END AS size_label FROM fetch_log WHERE value * 10 >= 500""")
def slow_resources(t):
    work = t.fetch_log.select("fetch_id", "url", (F.col("value") * 10).alias("total_ms"), F.col("content_length").alias("size"))
    return logs.slow_resources(work).select("fetch_id", "size_label")
