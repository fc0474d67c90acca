"""Written tables that cut lineage, and joins that broadcast only what has been counted."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two or three numbers that may be broadcast; beyond it Spark shuffles. At most some 30 MB.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only on one machine (as in tests) may it be unset, and a folder of our own is set for the context."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="snapweave-")
        sc.setCheckpointDir(found)
    return found


_opened: list[Scratch] = []


class Scratch:
    """Tables of one run, in a folder of the shared storage that every executor reads, so a lost executor costs only its tasks."""

    #: Spark's settings while a table is written: shuffle files are deleted as soon as it is, as it is all that later plans read; and rows that go to
    #: Python are few at a time, as they may be long texts, held by the JVM and by Python.
    SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _opened.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a reader of it: the plan below starts anew from files."""
        path, was = f"{self.root}/{name}", {k: self.spark.conf.get(k) for k in self.SETTINGS}
        for k, value in self.SETTINGS.items():
            self.spark.conf.set(k, value)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, value in was.items():
                self.spark.conf.set(k, value)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Free the space of tables that no later plan reads; without names, of all."""
        jvm = self.spark._jvm
        for at in [f"{self.root}/{name}" for name in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released() -> Iterator[None]:
    """Tables of operators that are called within go at its end: what was made of them must be written by then."""
    since = len(_opened)
    yield
    for scratch in _opened[since:]:
        scratch.drop()
    del _opened[since:]


def join_counted(big: DataFrame, small: DataFrame, on, how: str = "inner", values=None) -> DataFrame:
    """Join with `small`, a written table of narrow columns: broadcast if it is small, else shuffled.

    Small is up to BROADCAST_ROWS rows; with `values`, an expression for how many numbers the lists of a row hold, these count as a row for every three.
    """
    n = small.count() if values is None else small.agg(F.coalesce(F.sum(1 + values / 3), F.lit(0))).first()[0]
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df is called so (Spark reads names without case)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def same_row(docs: DataFrame, keys: DataFrame, key: str, own: str, how: str) -> DataFrame:
    """docs joined with a written table on its columns `own` (a doc_id) and `key` (an xxhash64(doc_id, text)); both stay with an inner or left join."""
    here, mine = fresh(docs, "row_here"), F.col("doc_id").cast("long")
    left = docs.withColumn(here, F.xxhash64("doc_id", "text"))
    lists = [F.size(f.name) for f in keys.schema if f.dataType.typeName() == "array"]
    return join_counted(left, keys, (F.col(here) == F.col(key)) & mine.eqNullSafe(F.col(own)), how, sum(lists, F.lit(0))).drop(here)


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and xxhash64(doc_id, text) are in `keys`, a written table of these two columns; columns as they are."""
    own, key = fresh(docs, "row_id"), fresh(docs, "row_key")
    return same_row(docs, keys.toDF(own, key), key, own, "left_anti").select(docs.columns)
