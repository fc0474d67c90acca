"""Schemas of sources and catalog tables; never inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType, TimestampNTZType


def _struct(text: str) -> StructType:
    """Fields as "name type" parted by commas; type is s, l, b, d, t or x (string, long, boolean, double, time, bytes)."""
    kinds = {"s": StringType(), "l": LongType(), "b": BooleanType(), "d": DoubleType(), "t": TimestampNTZType(), "x": BinaryType()}
    return StructType([StructField(n, kinds[k]) for n, k in (f.split() for f in text.split(","))])


FRAME = _struct("key s,url s,title s,html s")
COOKIE = _struct("name s,value s,domain s,path s,expires d,secure b,http_only b,same_site s,session b,host_only b,partition_key s")
CAPTURE = StructType([
    StructField("url", StringType()), StructField("title", StringType()), StructField("html", StringType()),
    StructField("frames", ArrayType(FRAME)), StructField("headers", MapType(StringType(), StringType())), StructField("cookies", ArrayType(COOKIE)),
])
PAGES = _struct("id l,url s,title s,html_path s,content_hash s,captured_at t,first_visited t,last_visited t,domain s,snapshot_state s,body_text s")
RESOURCES = _struct("id l,url s,content_hash s,file_path s,resource_type s,file_size l,first_seen t,last_seen t,is_quarantined b,quarantine_reason s")
PAGE_RESOURCES = _struct("page_id l,resource_id l")
PAGE_SHARES = _struct("id l,page_id l,token_hash s,url s,title s,html_path s,content_hash s,captured_at t,allow_markdown b,created_at t,expires_at t,revoked_at t")
PAGE_SHARE_RESOURCES = _struct("share_id l,resource_id l")
FAVORITES = _struct("page_id l,created_at t")
DELETION_QUEUE = _struct("html_path s,timestamp t,page_id l")
CATALOG = {"pages": PAGES, "resources": RESOURCES, "page_resources": PAGE_RESOURCES, "page_shares": PAGE_SHARES, "page_share_resources": PAGE_SHARE_RESOURCES, "favorites": FAVORITES, "deletion_queue": DELETION_QUEUE}
#: Primary keys, and (column, parent) of rows that go with their parent.
KEYS = {"pages": ["id"], "resources": ["id"], "page_resources": ["page_id", "resource_id"], "page_shares": ["id"], "page_share_resources": ["share_id", "resource_id"], "favorites": ["page_id"]}
PARENTS = {"page_resources": ("page_id", "pages"), "page_shares": ("page_id", "pages"), "favorites": ("page_id", "pages"), "page_share_resources": ("share_id", "page_shares")}
