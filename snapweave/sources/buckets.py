"""A catalog table stored in buckets of its key, of which a merge rewrites only those that its changes touch.

path/data/<id>/bucket=<n>/ holds rows, path/manifest/<number> says in which folder each bucket is. Files are never changed: a merge writes new folders and, at the end, the next
manifest. Readers take the newest one, so they see a table before a merge or after it; what a merge that broke off has written is in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _folder(spark: SparkSession, path: str):
    """A path of Hadoop and the file system that it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, system = _folder(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest: schema, key, number of buckets, and the folder of each bucket that has rows."""
    numbers = [int(n) for n in _names(spark, f"{path}/manifest") if n.isdigit()]
    if not numbers:
        raise FileNotFoundError(f"no table in {path}")
    content = spark.read.text(f"{path}/manifest/{max(numbers):012d}", wholetext=True).first()
    return max(numbers), json.loads(content.value)


def _publish(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """The manifest of that number, in its place when it is complete; an error if another writer was first."""
    draft, system = _folder(spark, f"{path}/manifest/.draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    to, fs = _folder(spark, f"{path}/manifest/{number:012d}")[0], spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, to, none)  # never over a file that is there
    except Exception as e:
        system.delete(draft, False)
        raise FileExistsError(f"{path}: another writer has made version {number}") from e


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> dict[str, str]:
    """Rows by bucket in a folder of their own: one file for most buckets, large ones split by Spark's rebalancing; the folder of each."""
    name = f"data/{uuid.uuid4().hex}"
    rows.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")
    return {n.removeprefix("bucket="): f"{name}/{n}" for n in _names(rows.sparkSession, f"{path}/{name}") if n.startswith("bucket=")}


def create_bucketed(rows: DataFrame, path: str, key: str = "url", buckets: int = 1000) -> None:
    """A new table of rows, which may have no column named bucket. Rows of a null key are in a bucket too."""
    if "bucket" in (c.lower() for c in rows.columns):
        raise ValueError("a column is named bucket")
    folders = _write(rows, path, key, buckets)
    _publish(rows.sparkSession, path, 0, {"schema": rows.schema.jsonValue(), "key": key, "buckets": buckets, "folders": folders})


def _read(spark: SparkSession, path: str, manifest: dict, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = [f"{path}/{manifest['folders'][b]}" for b in buckets if b in manifest["folders"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_bucketed(spark: SparkSession, path: str, keys: list | None = None) -> DataFrame:
    """All rows of the newest version, or those of some keys, for which only their buckets are read."""
    _, manifest = _manifest(spark, path)
    if keys is None:
        return _read(spark, path, manifest, list(manifest["folders"]))
    column = StructType.fromJson(manifest["schema"])[manifest["key"]]
    wanted = spark.createDataFrame([(k,) for k in keys], StructType([column]))
    found = wanted.select(_bucket(manifest["key"], manifest["buckets"]).cast("string").alias("b")).distinct()
    rows = _read(spark, path, manifest, [r.b for r in found.collect()])
    return rows.where(F.col(manifest["key"]).isin([k for k in keys if k is not None]) | (F.col(manifest["key"]).isNull() if None in keys else F.lit(False)))


def merge_bucketed(changes: DataFrame, path: str, merge: Merge) -> list[int]:
    """The next version of a table: merge(rows, changes) in place of the rows of all buckets that changes have keys of; the numbers of these.

    `merge` must leave rows of keys without changes as they are, and give no rows of other keys. No changes make no version. Two writers at once: the second to end fails, and may try again.
    Changes are computed twice, for their buckets (at most the table's number of them reach the driver) and for the merge.
    """
    spark = changes.sparkSession
    number, manifest = _manifest(spark, path)
    key, buckets = manifest["key"], manifest["buckets"]
    touched = sorted(r.b for r in changes.select(_bucket(key, buckets).alias("b")).distinct().collect())
    if not touched:
        return []
    names = [str(b) for b in touched]
    columns = StructType.fromJson(manifest["schema"]).names
    written = _write(merge(_read(spark, path, manifest, names), changes).select(columns), path, key, buckets)
    if strange := set(written) - set(names):
        raise ValueError(f"merge gave rows of other keys, in buckets {sorted(strange)[:5]}")
    folders = {b: f for b, f in manifest["folders"].items() if b not in set(names)} | written
    _publish(spark, path, number + 1, manifest | {"folders": folders})
    return touched


def clean_bucketed(spark: SparkSession, path: str) -> int:
    """Remove manifests before the newest and folders that it doesn't name, while nobody writes or reads an older version; how many folders of buckets went."""
    number, manifest = _manifest(spark, path)
    held, gone = set(manifest["folders"].values()), 0
    for n in _names(spark, f"{path}/manifest"):
        if n != f"{number:012d}" and n.strip(".").startswith(("0", "draft")):
            at, system = _folder(spark, f"{path}/manifest/{n}")
            system.delete(at, False)
    for name in _names(spark, f"{path}/data"):
        inside = [n for n in _names(spark, f"{path}/data/{name}") if n.startswith("bucket=")]
        left = [n for n in inside if f"data/{name}/{n}" in held]
        for n in [f"{name}/{n}" for n in inside if n not in left] if left else [name]:
            at, system = _folder(spark, f"{path}/data/{n}")
            system.delete(at, True)
        gone += len(inside) - len(left)
    return gone
