"""URL rules by host suffix and path prefix: expressions, an equi-join on short hash prefixes, full digests, precedence. Native only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a table, made in the JVM."""
    text = json.dumps([dict(zip(("host", "path", "verdict"), r, strict=True)) for r in rules])
    return spark.sql("SELECT inline(from_json(:rules, 'array<struct<host string, path string, verdict string>>'))", args={"rules": text})


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (host then path, null if none fits) and verdict.

    Host is what stands between the first :// and the next / ? # or the end, A-Z lower-cased; path what
    follows up to ? or #. A null url or one without :// has both empty and gets the default. A rule fits
    its host and all subdomains where the path starts with the rule's. The longest rule (host and path
    together) wins, then the longer host, then block; equal rules count once. Lookups are made once for
    each distinct (host, path). Rules with a null field are left out; none at all gives the default.
    Other columns of pages are not read.
    """
    known = rules.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    # one number per length of a rule's path: as many as the longest path has characters, at most
    lengths = sorted(r[0] for r in known.select(F.length("r_path")).distinct().collect()) or [0]
    full = _digest(F.col("r_host"), F.col("r_path"))
    known = known.distinct().select(full.alias("r_digest"), F.substring(full, 1, 8).alias("short"), "r_host", "r_path", "r_verdict")
    if known.count() <= BROADCAST_ROWS // 10:
        known = F.broadcast(known)

    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    sites = pages.select("page_id", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    each = sites.where("host != ''").select("host", "path").distinct()
    each = each.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    each = each.withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, 8))
    found = each.join(known, "short").where("digest = r_digest")
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), (F.col("r_verdict") == "block").alias("block"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
    )
    best = found.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = sites.where("host != ''").join(best, ["host", "path"], "left")
    out = out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    # rows without a host may be very many, and no rule fits them
    return out.unionByName(sites.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
