"""Directed multigraphs: vertices (id), edges (src, dst), and optionally parts (id, part); all columns are longs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut


@dataclass
class Graph:
    """Vertices come from their own table, so isolated ones exist. Edges may repeat and may be loops."""

    vertices: DataFrame
    edges: DataFrame
    parts: DataFrame | None = None

    def checked(self) -> Graph:
        """Raises ValueError if an edge's end is no vertex, or if parts do not cover the vertices one to one."""
        ids = self.vertices.select("id")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        if ends.join(ids, "id", "left_anti").head(1):
            raise ValueError("an edge ends at no vertex")
        if self.parts is not None:
            odd = ids.withColumn("v", F.lit(1)).join(self.parts.groupBy("id").count(), "id", "full").where("v is null or count is null or count > 1")
            if odd.head(1):
                raise ValueError("parts and vertices do not match")
        return self


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse; repeats stay."""
    return edges.select("src", "dst").union(transpose(edges))


def adjacency(graph: Graph, edges: DataFrame | None = None) -> DataFrame:
    """(id, neighbours): sorted out-neighbours of every vertex, with repeats; empty for those without."""
    lists = (graph.edges if edges is None else edges).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
    empty = F.array().cast("array<bigint>")
    return graph.vertices.join(lists, "id", "left").select("id", F.coalesce("neighbours", empty).alias("neighbours"))


#: Neighbours in a row of ``adjacency_chunks`` at most.
CHUNK = 1 << 16


def adjacency_chunks(vertices: DataFrame, links: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, chunk, neighbours, last): the neighbours of every vertex over links (id, way, nbr), sorted by way and neighbour, in rows of ``size`` at
    most, numbered from 0; ``last`` marks a vertex's last row. One without links has one empty row.

    Links are sorted by ranges, and their places in the whole order, not a vertex, say which go into a row: a hub is spread over as many
    tasks as its links need."""
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", "way", "nbr"]
    ordered = cut(links.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "nbr", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "links")
    parts_of = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts_of.select("part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))  # a row for each partition
    placed = ordered.join(F.broadcast(offsets), "part").select("id", "nbr", (F.col("at") + F.col("offset")).alias("at"))
    rows = placed.groupBy("id", F.expr(f"at div {size}").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("at", "nbr"))).alias("n"))
    of_vertex = Window.partitionBy("id").orderBy("piece")
    rows = rows.select("id", (F.row_number().over(of_vertex) - 1).alias("chunk"), F.col("n.nbr").alias("neighbours"), F.lead("piece").over(of_vertex).isNull().alias("last"))
    none = F.array().cast("array<bigint>")
    return vertices.select("id").join(rows, "id", "left").select("id", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("neighbours", none).alias("neighbours"), F.coalesce("last", F.lit(True)).alias("last"))


def degrees(graph: Graph) -> DataFrame:
    """(id, out_degree, in_degree, score) of every vertex; repeats count, score is the product."""
    ends = graph.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(graph.edges.select("dst", F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    d = graph.vertices.join(sums, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))
    return d.withColumn("score", F.col("out_degree") * F.col("in_degree"))


def sorted_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def alike(edges: DataFrame, state: DataFrame, *keys: str) -> DataFrame:
    """Edges whose ends are both in ``state`` (id, keys) and have the same keys (a color, a part)."""
    a = state.select(F.col("id").alias("src"), *(F.col(k).alias(f"{k}_a") for k in keys))
    b = state.select(F.col("id").alias("dst"), *(F.col(k).alias(f"{k}_b") for k in keys))
    found = edges.join(a, "src").join(b, "dst")
    for k in keys:
        found = found.where(F.col(f"{k}_a") == F.col(f"{k}_b"))
    return found.select("src", "dst")


def inside_parts(graph: Graph) -> DataFrame:
    return alike(graph.edges, graph.parts, "part")


def cut_edges(graph: Graph) -> DataFrame:
    """(src, dst, src_part, dst_part) of edges between parts."""
    a, b = (graph.parts.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part")) for c in ("src", "dst"))
    return graph.edges.join(a, "src").join(b, "dst").where("src_part <> dst_part").select("src", "dst", "src_part", "dst_part")
