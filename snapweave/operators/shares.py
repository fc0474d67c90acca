"""Shares: frozen copies of a page row and its resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FROZEN = ["url", "title", "html_path", "content_hash", "captured_at"]


def share_token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def create_shares(requests: DataFrame, pages: DataFrame, links: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Shares and their pinned resources for requests (id, page_id, token, allow_markdown, expires_at); only of ready pages and future expiry."""
    good = requests.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    ready = pages.where("snapshot_state = 'ready'").select(F.col("id").alias("page_id"), *FROZEN)
    shares = good.join(ready, "page_id").select("id", "page_id", share_token_hash(F.col("token")).alias("token_hash"), *FROZEN, F.coalesce("allow_markdown", F.lit(True)).alias("allow_markdown"), now.alias("created_at"), "expires_at", F.lit(None).cast("timestamp_ntz").alias("revoked_at"))
    pins = shares.select(F.col("id").alias("share_id"), "page_id").join(links, "page_id").select("share_id", "resource_id").distinct()
    return shares, pins


def active(as_of: Column) -> Column:
    return F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def active_shares(shares: DataFrame, as_of: Column, token: str | None = None) -> DataFrame:
    rows = shares.where(active(as_of))
    return rows if token is None else rows.where(F.col("token_hash") == share_token_hash(F.lit(token)))


def list_shares(shares: DataFrame, page_id: int) -> DataFrame:
    return shares.where(F.col("page_id") == page_id).orderBy(F.desc("created_at"), F.desc("id"))


def revoke_shares(shares: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Shares with revoked_at where their id is in `gone`; the first revocation stays."""
    marked = shares.join(gone.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left")
    return marked.withColumn("revoked_at", F.coalesce("revoked_at", F.when(F.col("_gone"), now))).select(shares.columns)


def protected_html(shares: DataFrame, as_of: Column) -> DataFrame:
    return shares.where(active(as_of)).select("html_path").distinct()


def shared_resource_lookup(refs: DataFrame, pins: DataFrame, resources: DataFrame) -> DataFrame:
    """For refs (share_id, ref) the pinned resource that the ladder of resolve_page_resource finds; nothing outside the pinned set."""
    from .resources import resolve_page_resource

    own = resolve_page_resource(refs.withColumnRenamed("share_id", "page_id"), pins.withColumnRenamed("share_id", "page_id"), resources)
    return own.withColumnRenamed("page_id", "share_id")


def rewrite_for_share(html: Column, token: Column) -> Column:
    """Archive paths of a page and of resources under the share's own root."""
    root = F.concat(F.lit("/share/"), F.url_encode(token))
    html = F.regexp_replace(html, F.lit(r"/archive/\d+/(\d+(?:[a-z]+_)?)/"), F.concat(root, F.lit("/archive/$1/")))
    return F.replace(html, F.lit("/archive/resources/"), F.concat(root, F.lit("/resources/")))


def shared_content(shares: DataFrame, html: DataFrame, as_of: Column, clean, markdown) -> DataFrame:
    """Active shares with their frozen html cleaned and re-rooted; Markdown only where allowed. html: html_path, html."""
    rows = active_shares(shares, as_of).join(html, "html_path")
    return rows.select("id", rewrite_for_share(clean(F.col("html")), F.col("token_hash")).alias("html"), F.when(F.col("allow_markdown"), markdown(F.col("html"))).alias("markdown"))
