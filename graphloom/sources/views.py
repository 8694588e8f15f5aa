"""Graphs over the driver's tables: customers are vertices, urgent orders that are not pending are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph

PARTS = 10


def view(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """Graph ``a``: an order leads to any customer; ``b``: to one of its own block of ten. Parts go round."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    vertices = customers.select((F.col("c_custkey") + 1).cast("long").alias("id"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT' and o_orderstatus <> 'P'")
    if name == "a":
        dst = F.expr(f"(o_orderkey * 7919) % {customers.count()} + 1")
    else:
        dst = F.expr("(o_custkey div 10) * 10 + (o_orderkey * 7919) % 10 + 1")
    edges = orders.select((F.col("o_custkey") + 1).cast("long").alias("src"), dst.cast("long").alias("dst"))
    return Graph(vertices, edges, vertices.select("id", ((F.col("id") - 1) % PARTS).alias("part")))


def block_colors(vertices: DataFrame, size: int = 10) -> DataFrame:
    """(id, color): blocks of neighbouring ids."""
    return vertices.select("id", F.expr(f"(id - 1) div {size}").alias("color"))
