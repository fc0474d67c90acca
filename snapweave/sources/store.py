"""Sources and sinks: capture requests, html and resource stores, the deletion queue, logs, and catalog tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import files, logfiles

MAX_BODY = 32 << 20
# Endings of stored resources by their type.
ENDINGS = {"image": ".img", "css": ".css", "js": ".js", "font": ".font", "html": ".html"}


def captures_from_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Capture requests of lines (value), and the lines that are rejected: over 32 MiB, unreadable, or without url or html."""
    rows = lines.select("value", F.from_json("value", schemas.CAPTURE, {"mode": "PERMISSIVE"}).alias("c"))
    good = (F.octet_length("value") <= MAX_BODY) & F.col("c.url").isNotNull() & F.col("c.html").isNotNull() & F.coalesce(F.forall("c.frames", lambda f: f["key"].isNotNull() & f["html"].isNotNull()), F.lit(True))
    marked = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    return marked.where("_good").select("c.*"), marked.where("not _good").select("value")


def read_captures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return captures_from_json(spark.read.text(path))


def stream_captures(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return captures_from_json(spark.readStream.option("maxFilesPerTrigger", files).text(path))[0]


def html_path(url: Column, captured_at: Column) -> Column:
    """html/YYYY/MM/DD/<unix>_<16 hex of the hash of url and time>.html"""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', captured_at)") if captured_at is None else F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), captured_at)
    key = F.substring(F.sha2(F.concat(url, F.date_format(captured_at, "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256), 1, 16)
    return F.concat(F.lit("html/"), F.date_format(captured_at, "yyyy/MM/dd/"), seconds.cast("string"), F.lit("_"), key, F.lit(".html"))


def write_html_snapshots(snapshots: DataFrame, path: str) -> None:
    """The html store as parquet by day of capture, so that a range of days reads its folders alone."""
    rows = snapshots.withColumn("html_path", html_path(F.col("url"), F.col("captured_at"))).withColumn("capture_date", F.to_date("captured_at"))
    rows.write.mode("append").partitionBy("capture_date").parquet(path)


def read_html_snapshots(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if start:
        rows = rows.where(F.col("capture_date") >= F.lit(start).cast("date"))
    return rows.where(F.col("capture_date") <= F.lit(end).cast("date")) if end else rows


def resource_path(content_hash: Column, kind: Column) -> Column:
    """resources/ab/cd/<hash><ending>"""
    ending = F.lit(".bin")
    for name, e in ENDINGS.items():
        ending = F.when(kind == name, e).otherwise(ending)
    return F.concat(F.lit("resources/"), F.substring(content_hash, 1, 2), F.lit("/"), F.substring(content_hash, 3, 2), F.lit("/"), content_hash, ending)


def read_resources(spark: SparkSession, path: str, most: int = 200 << 20) -> DataFrame:
    """file_path, length and hash of stored files, read in blocks; those over `most` bytes aren't opened."""
    return files.hash_files(spark, path, most)


def write_resource_files(contents: DataFrame, path: str) -> None:
    """Contents (content and kind) as files named by their hashes, `resources/ab/cd/<hash><ending>`; what is stored already is left as it is."""
    rows = contents.where("content is not null").select(resource_path(F.sha2(F.col("content").cast("binary"), 256), F.col("kind")).alias("path"), "content")
    files.write_files(rows.dropDuplicates(["path"]), path, named_by_hash=True)


def write_html_files(snapshots: DataFrame, path: str) -> None:
    """Snapshots (url, captured_at, html) as files `html/YYYY/MM/DD/<unix>_<hash>.html`; one that is stored already is left as it is."""
    rows = snapshots.select(html_path(F.col("url"), F.col("captured_at")).alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    files.write_files(rows.dropDuplicates(["path"]), path)


def read_html_files(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """html_path, html and capture_date of the html store; of a range of days only their folders are listed, by tasks. Names and contents of files don't pass through the driver."""
    low, high = (f"{pd.Timestamp(d):%Y/%m/%d}" if d else None for d in (start, end))
    found = files.read_days(spark, f"{path}/html", ".html", low, high)
    own = F.regexp_extract("file_path", r"(html/\d{4}/\d{2}/\d{2}/[^/]+)$", 1)
    return found.select(own.alias("html_path"), F.col("content").cast("string").alias("html"), F.to_date(F.substring(own, 6, 10), "yyyy/MM/dd").alias("capture_date"))


def write_resources(new: DataFrame, stored: DataFrame, path: str) -> None:
    """Append contents (content_hash, ...) that the store doesn't hold; the same content twice is written once."""
    new.dropDuplicates(["content_hash"]).join(stored.select("content_hash"), "content_hash", "left_anti").write.mode("append").parquet(path)


def read_deletion_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queue records; lines that aren't JSON of one are left out."""
    return spark.read.schema(schemas.DELETION_QUEUE).option("mode", "DROPMALFORMED").json(path).where("html_path is not null")


def append_deletion_queue(records: DataFrame, path: str) -> None:
    records.select(schemas.DELETION_QUEUE.names).write.mode("append").json(path)


def rewrite_deletion_queue(remaining: DataFrame, new_path: str) -> None:
    """What is left after a run, in a new folder that takes the old one's place."""
    remaining.select(schemas.DELETION_QUEUE.names).write.mode("errorifexists").json(new_path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """file, size, day, line_no, start, end and line of log files, read in byte ranges."""
    return logfiles.numbered(logfiles.read_log_lines(spark, path)).withColumn("day", logfiles.day_of(F.col("file")))


def list_logs(logs: DataFrame) -> DataFrame:
    return logs.groupBy("file").agg(F.max("size").alias("size"), F.max("day").alias("day"), F.count("*").alias("lines")).orderBy(F.desc("file"))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Rows in a catalog table's schema, one per primary key; missing columns are null."""
    schema, held = schemas.CATALOG[table], set(df.columns)
    rows = df.select([(F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    return rows.dropDuplicates(schemas.KEYS[table]) if table in schemas.KEYS else rows


def write_catalog(tables: dict[str, DataFrame], path: str) -> None:
    """Catalog tables as parquet; rows of children whose parent is missing are left out."""
    made = {n: conform(df, n) for n, df in tables.items()}
    for name, df in made.items():
        column, parent = schemas.PARENTS.get(name, (None, None))
        if parent in made:
            df = df.join(made[parent].select(F.col("id").alias(column)), column, "left_semi").select(schemas.CATALOG[name].names)
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_catalog(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG[table]).parquet(f"{path}/{table}")


def read_jdbc_catalog(spark: SparkSession, url: str, table: str, low: int, high: int, parts: int = 64) -> DataFrame:
    """A catalog table in a relational store, read in ranges of id; needs its driver on the class path."""
    return spark.read.jdbc(url, table, column="id" if "id" in schemas.CATALOG[table].names else "page_id", lowerBound=low, upperBound=high, numPartitions=parts)
