"""Merges of tables in buckets: what is rewritten, what readers see of one that breaks off, two writers, skew and odd keys."""

import pytest
from pyspark.sql import functions as F

from snapweave.sources import buckets

KIND = "url string, n long"


def take_newest(rows, changes):
    """Changes in place of rows of their keys."""
    return rows.join(changes.select(F.col("url").alias("_u")), F.expr("url <=> _u"), "left_anti").unionByName(changes)


def files(root):
    return {p for p in (root / "data").rglob("*.parquet")}


def test_an_update_rewrites_its_bucket_only(spark, tmp_path):
    root = tmp_path / "t"
    buckets.create_bucketed(spark.range(3000).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id").alias("n")), str(root), buckets=200)
    before = files(root)
    assert len(before) == 200
    assert len(buckets.merge_bucketed(spark.createDataFrame([("u7", -7)], KIND), str(root), take_newest)) == 1
    assert len(files(root) - before) == 1
    got = {r.url: r.n for r in buckets.read_bucketed(spark, str(root)).collect()}
    assert len(got) == 3000 and got.pop("u7") == -7 and all(u == f"u{n}" for u, n in got.items())
    some = buckets.read_bucketed(spark, str(root), ["u7", "u8", "none"])
    assert sorted(map(tuple, some.collect())) == [("u7", -7), ("u8", 8)]
    assert len(some.inputFiles()) <= 3
    assert buckets.clean_bucketed(spark, str(root)) == 1
    assert len(files(root)) == 200 and buckets.read_bucketed(spark, str(root)).agg(F.sum("n")).first()[0] == sum(range(3000)) - 14


def test_a_merge_that_breaks_off_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), [(f"u{k}", k) for k in range(40)]
    buckets.create_bucketed(spark.createDataFrame(rows, KIND), path, buckets=8)
    with monkeypatch.context() as m:
        m.setattr(buckets, "_publish", lambda *a: 1 / 0)  # all is written but the manifest
        with pytest.raises(ZeroDivisionError):
            buckets.merge_bucketed(spark.createDataFrame([("u1", -1)], KIND), path, take_newest)
    assert sorted(map(tuple, buckets.read_bucketed(spark, path).collect())) == sorted(rows)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        buckets.merge_bucketed(spark.createDataFrame([("u1", 0)], KIND), path, lambda old, new: new.select("url", F.expr("CAST(1 / n AS LONG)").alias("n")))
    assert sorted(map(tuple, buckets.read_bucketed(spark, path).collect())) == sorted(rows)
    buckets.clean_bucketed(spark, path)
    assert sorted(map(tuple, buckets.read_bucketed(spark, path).collect())) == sorted(rows)


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create_bucketed(spark.createDataFrame([("a", 1), ("b", 2)], KIND), path, buckets=4)

    def slow(rows, changes):
        buckets.merge_bucketed(spark.createDataFrame([("b", 20)], KIND), path, take_newest)
        return take_newest(rows, changes)

    with pytest.raises(FileExistsError):
        buckets.merge_bucketed(spark.createDataFrame([("a", 10)], KIND), path, slow)
    assert sorted(map(tuple, buckets.read_bucketed(spark, path).collect())) == [("a", 1), ("b", 20)]
    assert not [n for n in buckets._names(spark, f"{path}/manifest") if "draft" in n]


def test_null_keys_hot_keys_emptied_buckets_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(None, 1), ("a", 2), ("a", 2)] + [("hot", k) for k in range(500)]
    buckets.create_bucketed(spark.createDataFrame(rows, KIND), path, buckets=16)
    assert buckets.merge_bucketed(spark.createDataFrame([], KIND), path, take_newest) == []
    buckets.merge_bucketed(spark.createDataFrame([(None, 5)], KIND), path, take_newest)
    assert [tuple(r) for r in buckets.read_bucketed(spark, path, [None]).collect()] == [(None, 5)]
    buckets.merge_bucketed(spark.createDataFrame([("hot", 0), ("a", 0)], KIND), path, lambda old, new: old.join(new.select("url"), "url", "left_anti"))
    assert [tuple(r) for r in buckets.read_bucketed(spark, path).collect()] == [(None, 5)]
    with pytest.raises(ValueError, match="other keys"):
        buckets.merge_bucketed(spark.createDataFrame([("a", 0)], KIND), path, lambda old, new: spark.range(300).select(F.col("id").cast("string").alias("url"), F.col("id").alias("n")))
    with pytest.raises(ValueError, match="named bucket"):
        buckets.create_bucketed(spark.range(2).select(F.col("id").alias("Bucket")), str(tmp_path / "x"))
    buckets.create_bucketed(spark.createDataFrame([], KIND), str(tmp_path / "e"))
    assert buckets.read_bucketed(spark, str(tmp_path / "e")).columns == ["url", "n"] and buckets.read_bucketed(spark, str(tmp_path / "e")).count() == 0
    buckets.merge_bucketed(spark.createDataFrame([("z", 1)], KIND), str(tmp_path / "e"), take_newest)
    assert buckets.read_bucketed(spark, str(tmp_path / "e"), ["z"]).count() == 1
    with pytest.raises(FileNotFoundError):
        buckets.read_bucketed(spark, str(tmp_path / "none"))
