"""Cookies, sites and the safety of urls and paths."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import extract_domain

# A small part of the public suffix list; pass another table for the whole of it.
SUFFIXES = "com net org edu gov int mil io dev app info biz co uk co.uk org.uk ac.uk gov.uk jp co.jp ne.jp cn com.cn net.cn org.cn au com.au de fr es it nl br com.br in co.in tw com.tw hk com.hk *.ck !www.ck github.io".split()
# Networks that a fetch must not reach, first and last address, and the addresses of cloud metadata.
BLOCKED = [("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255"), ("224.0.0.0", "255.255.255.255")]
METADATA = ["169.254.169.254", "fd00:ec2::254"]


def suffix_rules(spark: SparkSession, rules: list[str] = SUFFIXES) -> DataFrame:
    return spark.sql("SELECT explode(from_json(:r, 'array<string>')) AS rule", args={"r": json.dumps(rules)})


def root_domain(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and root: one label more than the longest matching suffix (an exception rule counts without its first label); an address or a bare suffix stays."""
    rows = hosts.select("host").distinct()
    parts = F.split("host", r"\.")
    n = F.array_size(parts)
    each = rows.select("host", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("tail", F.array_join(F.slice(F.split("host", r"\."), F.col("k"), F.lit(1000)), "."))
    size = F.array_size(F.split("tail", r"\."))
    names = each.select("host", "tail", size.alias("labels"), F.explode(F.array(F.col("tail"), F.concat(F.lit("!"), F.col("tail")), F.concat(F.lit("*."), F.regexp_replace("tail", r"^[^.]*\.?", "")))).alias("rule"))
    hit = names.join(F.broadcast(rules) if rules.count() <= 100_000 else rules, "rule")  # the whole public list has some ten thousand
    taken = F.when(F.col("rule").startswith("!"), F.struct(F.lit(1).alias("e"), (F.col("labels") - 1).alias("n"))).otherwise(F.struct(F.lit(0).alias("e"), F.col("labels").alias("n")))
    best = hit.groupBy("host").agg(F.max(taken).alias("b")).select("host", F.col("b.n").alias("suffix"))
    out = rows.join(best, "host", "left")
    keep = F.coalesce("suffix", F.lit(1)) + 1
    root = F.array_join(F.slice(parts, F.greatest(n - keep + 1, F.lit(1)), keep), ".")
    return out.select("host", F.when(F.col("host").rlike(r"^[\d.]+$|:"), F.col("host")).otherwise(root).alias("root"))


def host(url: Column) -> Column:
    return F.lower(extract_domain(url))


def _path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def match_cookies(resources: DataFrame, cookies: DataFrame, now: Column) -> DataFrame:
    """resource_id and cookie (name, value, path) that a request would carry. resources: capture_id, resource_id, url, site, page_site; cookies: capture_id and the fields of a cookie.

    site and page_site are schemeful (scheme and registrable domain). An equi-join on the capture, the rest as conditions.
    """
    both = resources.join(cookies.withColumnsRenamed({c: f"c_{c}" for c in cookies.columns if c != "capture_id"}), "capture_id")
    domain, path, h = F.lower(F.regexp_replace("c_domain", r"^\.", "")), F.coalesce(F.nullif(F.col("c_path"), F.lit("")), F.lit("/")), host(F.col("url"))
    named = (F.coalesce("c_name", F.lit("")) != "") & (domain != "")
    alive = F.coalesce("c_session", F.lit(False)) | F.col("c_expires").isNull() | (F.col("c_expires") > now)
    secure = ~F.coalesce("c_secure", F.lit(False)) | F.col("url").startswith("https://")
    where = (h == domain) | (~F.coalesce("c_host_only", F.lit(False)) & F.endswith(h, F.concat(F.lit("."), domain)))
    under = (_path(F.col("url")) == path) | (F.startswith(_path(F.col("url")), path) & (path.endswith("/") | (F.substring(_path(F.col("url")), F.length(path) + 1, F.lit(1)) == "/")))
    partition = F.col("c_partition_key").isNull() | (F.col("c_partition_key") == F.col("page_site"))
    same = ~F.lower(F.coalesce("c_same_site", F.lit(""))).isin("strict", "lax") | (F.col("site") == F.col("page_site"))
    return both.where(named & alive & secure & where & under & partition & same).select("resource_id", F.col("c_name").alias("name"), F.col("c_value").alias("value"), path.alias("path"))


def cookie_header(matched: DataFrame) -> DataFrame:
    """resource_id and header: n=v; n=v, longest path first, then name. A request carries a browser's few hundred cookies at most."""
    order = F.array_sort(F.collect_list(F.struct((-F.length("path")).alias("k"), "name", "value")))
    return matched.groupBy("resource_id").agg(F.array_join(F.transform(order, lambda c: F.concat(c["name"], F.lit("="), F.coalesce(c["value"], F.lit("")))), "; ").alias("header"))


def _number(ip: Column) -> Column:
    return sum((F.get(F.split(ip, r"\."), F.lit(k)).try_cast("bigint") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0).cast("bigint"))


def plain_address(ip: Column) -> Column:
    """An address in lower case without zone; an IPv4 address that is written as an IPv6 one (::ffff:a.b.c.d or ::ffff:hhhh:hhhh) as the former."""
    low = F.regexp_replace(F.lower(ip), "%.*$", "")
    dotted = F.regexp_extract(low, r"^(?:::|0:0:0:0:0:)ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    part = lambda k: F.conv(F.regexp_extract(low, r"^(?:::|0:0:0:0:0:)ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 16, 10).try_cast("int")
    high, rest = part(1), part(2)
    hexed = F.concat_ws(".", *[F.shiftright(x, n).bitwiseAND(F.lit(255)).cast("string") for x in (high, rest) for n in (8, 0)])
    return F.when(dotted != "", dotted).when(high.isNotNull() & rest.isNotNull(), hexed).otherwise(low)


def _blocked(ip: Column) -> Column:
    number = _number(ip)
    whole = lambda text: sum(int(p) << (24 - 8 * k) for k, p in enumerate(text.split(".")))
    inside = F.lit(False)
    for first, last in BLOCKED:
        inside = inside | number.between(whole(first), whole(last))
    low = F.lower(ip)
    return F.when(ip.contains(":"), (low == "::1") | (low == "::") | low.rlike(r"^(f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]|ff[0-9a-f]{2}):")).otherwise(F.coalesce(inside, F.lit(False)))


def classify_fetch_url(url: Column, ips: Column) -> Column:
    """bad_scheme, no_host, metadata, private or ok; a name is judged by each of the addresses it was resolved to."""
    h = host(url)
    literal = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | h.contains(":")
    every = F.transform(F.when(literal, F.array(h)).otherwise(F.coalesce(ips, F.array().cast("array<string>"))), plain_address)
    return F.when(~F.lower(F.coalesce(url, F.lit(""))).rlike(r"^https?:"), "bad_scheme").when(h == "", "no_host").when(F.arrays_overlap(every, F.array(*map(F.lit, METADATA))), "metadata").when((h == "localhost") | F.exists(every, _blocked), "private").otherwise("ok")


def safe_path(path: Column) -> Column:
    """Is it relative, and does it stay below its base at every step? Walks the parts with the depth so far."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part.isin("", "."), 0).when(part == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    return ~path.startswith("/") & ~path.contains("\0") & F.aggregate(parts, zero, step, lambda acc: acc["ok"])
