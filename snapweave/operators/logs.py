"""Server logs: tails, filters, byte ranges, levels, retention and slow work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAME = r"^[a-z]+-(\d{4}-\d{2}-\d{2})\.\d+\.log$"


def log_tail(lines: DataFrame, n: int = 2000) -> DataFrame:
    """The last n lines of each file (file, line_no, line); at most 10000. Only the counts of files are shuffled."""
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("_n"))
    return lines.join(sizes, "file").where(F.col("line_no") > F.col("_n") - min(n, 10_000)).select(lines.columns)


def log_grep(lines: DataFrame, keyword: str) -> DataFrame:
    return lines.where(F.contains(F.lower("line"), F.lower(F.lit(keyword))))


def with_offsets(lines: DataFrame, block: int = 100_000) -> DataFrame:
    """Lines with the bytes at which they start and end (line feed included): sums within blocks of lines, after those of the blocks before. Lines read from files have them."""
    if {"start", "end"} <= set(lines.columns):
        return lines
    rows = lines.withColumn("_block", F.floor((F.col("line_no") - 1) / block))
    blocks = rows.groupBy("file", "_block").agg(F.sum(F.octet_length("line") + 1).alias("_bytes"))
    before = F.sum("_bytes").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("file", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.octet_length("line") + 1).over(order) + F.col("_before")
    rows = rows.join(blocks, ["file", "_block"]).withColumn("end", end)
    return rows.withColumn("start", F.col("end") - F.octet_length("line") - 1).drop("_block", "_before")


def log_range(lines: DataFrame, offset: int, size: int = 128 << 10, before: bool = False) -> DataFrame:
    """Whole lines of each file in `size` bytes from `offset` on (or before it); has_more_before and has_more_after say what is left."""
    size = min(size, 1 << 20)
    rows = with_offsets(lines)
    low, high = (offset - size, offset) if before else (offset, offset + size)
    inside = (F.col("start") >= low) & (F.col("end") <= high)
    own = rows.groupBy("file").agg(F.max("end").alias("_end"), F.min(F.when(inside, F.col("start"))).alias("_first"), F.max(F.when(inside, F.col("end"))).alias("_last"))
    got = rows.where(inside).join(own, "file")
    return got.withColumn("has_more_before", F.col("_first") > 0).withColumn("has_more_after", F.col("_last") < F.col("_end")).drop("_end", "_first", "_last")


def log_level(line: Column) -> Column:
    low = F.lower(line)
    has = lambda *words: F.expr("false") if not words else sum((low.contains(w).cast("int") for w in words), F.lit(0)) > 0
    return (
        F.when(has("failed", "error", "pq:", "panic"), "error").when(has("fallback", "not found", "skip", "warn"), "warn").when(has("[update]"), "update").when(has("[proxy]"), "proxy")
        .when(has("[cache]"), "cache").when(has("[http]"), "http").when(has("success"), "success").otherwise("none")
    )


def level_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file", log_level(F.col("line")).alias("level")).agg(F.count("*").alias("lines"))


def log_retention(files: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Files whose name's day is more than `days` before; names without a day stay."""
    day = F.try_to_date(F.regexp_extract("file", NAME, 1), "yyyy-MM-dd")
    return files.where(day < F.date_sub(as_of.cast("date"), days))


def size_label(size: Column) -> Column:
    return F.when(size.isNull() | (size < 0), "unknown").when(size >= 1 << 20, F.format_string("%.2f MB", size / (1 << 20))).when(size >= 1024, F.format_string("%.2f KB", size / 1024)).otherwise(F.format_string("%d B", size))


def slow_resources(work: DataFrame, least_ms: float = 500) -> DataFrame:
    """Work (url, total_ms, size) of at least `least_ms` with its size in words."""
    return work.where(F.col("total_ms") >= least_ms).withColumn("size_label", size_label(F.col("size")))
