"""What the operators of this subpackage share: table reading, scratch tables, Arrow helpers.

Conventions that hold for every operator here:

* a null text is an empty text unless the operator says otherwise;
* ``doc_id`` may be null; where documents are ordered, null comes first;
* rows that are equal in both ``doc_id`` and ``text`` stand for one document, and each of them
  gets that document's result;
* only the named id and text columns are read, so extra columns of any name are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut, cut_counted, discard, scratch_dir
from graphloom.plans.session import ship

__all__ = ["ascii_lower", "cut", "cut_counted", "discard", "documents", "partitions", "prepare", "scratch_dir", "table", "utf8"]

#: Documents an Arrow batch holds at most: Python workers see a few MB at a time.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, doc_key, _0, _1, ...): no null texts; doc_key identifies a document by id and text. _i is the
    i-th of the carried columns, whose names may be any."""
    prepare(docs.sparkSession)
    own = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    d = docs.select(*own, *(F.col(c).alias(f"_{i}") for i, c in enumerate(carried)))
    return d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_key"), *(f"_{i}" for i in range(len(carried))))


def prepare(spark: SparkSession) -> None:
    """Python on the executors finds this package and gets small Arrow batches."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column's values as bytes, without decoding them."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all else unchanged (lower() also changes letters beyond ASCII)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
