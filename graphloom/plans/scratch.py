"""Tables in the shared scratch folder: they end a plan's lineage and outlive the executors that wrote them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, found[7:], True)
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes ``df`` to a table in the scratch folder and reads it back: computed once, however often it is read."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return _table(df, path)


def cut_observed(df: DataFrame, label: str, *measures: Column, path: str | None = None) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates of the rows by their names, from the same job."""
    seen = Observation()
    path = path or new_path(df.sparkSession, label)
    df.observe(seen, *measures).write.option("compression", "zstd").parquet(path)
    return _table(df, path), seen.get


def cut_counted(df: DataFrame, label: str = "cut", path: str | None = None) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows, from the same job."""
    table, seen = cut_observed(df, label, F.count(F.lit(1)).alias("n"), path=path)
    return table, seen["n"]


#: Rows of a table that a round broadcasts at most.
FEW = 4096


def met(table: DataFrame, n: int | None = None) -> DataFrame:
    """``table`` as the right side of a join in a loop: broadcast if it is known to have few rows, else sorted and merged. What Spark would
    broadcast, some MB a table, passes through the driver in every round, and adds up."""
    return F.broadcast(table) if n is not None and n <= FEW else table.hint("merge")


@contextmanager
def plain(spark: SparkSession) -> Iterator[None]:
    """Jobs without adaptive execution: for those of many rounds whose one exchange has its number of partitions and whose joins have hints, so that it
    could change nothing, but would run each stage as a job and plan anew after it."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of rows that a table's exchange has counted at most for it to be broadcast in a run of many joins.
SMALL = 256 << 10


@contextmanager
def measured(spark: SparkSession) -> Iterator[None]:
    """Jobs that broadcast only what hints name and what an exchange has measured as ``SMALL``. Otherwise a table in the scratch folder counts by the
    bytes of its compressed files: one of some MB has millions of rows, which the driver would collect and hash."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {key: spark.conf.get(key, None) for key in (static, adaptive)}
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if before[adaptive] is None:  # else it is the caller's, or ours
        spark.conf.set(adaptive, str(min(most, SMALL)))
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _table(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def bucketed(df: DataFrame, label: str, buckets: int, columns: list[str], name: str | None = None, by: str | None = None) -> tuple[str, int]:
    """(name, rows): writes ``df`` to a table of the session's catalog, in the scratch folder, in ``buckets`` by the hash of the columns; with a
    ``name`` adds it to that table. Joins of such tables by those columns need no exchange."""
    seen, fresh = Observation(), name is None
    name = name or f"graphloom_{label}_{uuid.uuid4().hex}"
    if not fresh:  # saveAsTable would list all partitions once more
        df.observe(seen, F.count(F.lit(1)).alias("n")).select(*df.sparkSession.table(name).columns).write.insertInto(name)
        return name, seen.get["n"]
    w = df.repartition(buckets, *columns).observe(seen, F.count(F.lit(1)).alias("n")).write.format("parquet").option("compression", "zstd").option("path", f"{scratch_dir(df.sparkSession)}/{name}")
    w = w.bucketBy(buckets, *columns) if by is None else w.partitionBy(by).bucketBy(buckets, *columns)
    w.mode("errorifexists").saveAsTable(name)
    return name, seen.get["n"]


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` made and that a later one, already written, takes the place of."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
