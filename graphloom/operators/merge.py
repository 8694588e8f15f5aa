"""Strong components by parts, merged level by level.

Parts are merged in pairs (part // 2) until one is left. At each level the components found so far are contracted, and
the strong components of the quotient graph inside each new part join them: exact for any number of parts,
however often a cycle crosses between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.tags import buddy
from graphloom.operators.graph import Graph, alike, cut_edges
from graphloom.operators.label import color_components, max_color
from graphloom.operators.trim import peel_survivors, trim1, trim1_survivors
from graphloom.plans.scratch import cut, cut_counted, measured


def nontrivial_components(edges: DataFrame) -> DataFrame:
    """(id, component): strong components of the vertices that lie between cycles, by coloring; every vertex left out is
    one by itself. The component is some member's id."""
    done = None
    edges, _ = trim1(edges.where("src <> dst").distinct())
    while edges.head(1):
        ids = cut(trim1_survivors(edges), "ids")
        found = cut(color_components(cut(max_color(ids, edges), "colors"), edges), "found")
        done = found if done is None else done.union(found)
        rest = ids.join(found, "id", "left_anti")
        a, b = (rest.select(F.col("id").alias(c)) for c in ("src", "dst"))
        edges, _ = trim1(edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst"))
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")) if done is None else done


def components_of(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex, named after the smallest id."""
    found = nontrivial_components(edges)
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    named = found.join(least, "component").select("id", "least")
    return vertices.select("id").join(named, "id", "left").select("id", F.coalesce("least", "id").alias("component"))


def local_components(graph: Graph) -> DataFrame:
    """(id, component): strong components of the edges inside parts."""
    return components_of(graph.vertices, alike(graph.edges, graph.parts, "part"))


def next_parts(parts: DataFrame) -> DataFrame:
    return parts.select("id", F.shiftright("part", 1).alias("part"))


def condensation_edges(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): distinct edges between components, by their names."""
    a = components.select(F.col("id").alias("src"), F.col("component").alias("a"))
    b = components.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    found = edges.join(a, "src").join(b, "dst").where("a <> b")
    return found.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def merge_level(components: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, component): components joined by cycles inside the parts as they are now."""
    named = components.join(parts, "id")
    a = named.select(F.col("id").alias("src"), F.col("component").alias("a"), F.col("part").alias("pa"))
    b = named.select(F.col("id").alias("dst"), F.col("component").alias("b"), F.col("part").alias("pb"))
    quotient = edges.join(a, "src").join(b, "dst").where("a <> b and pa = pb").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    joined = nontrivial_components(quotient).select(F.col("id").alias("component"), F.col("component").alias("joined"))
    merged = components.join(joined, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
    least = merged.groupBy("component").agg(F.min("id").alias("least"))
    return merged.join(least, "component").select("id", F.col("least").alias("component"))


def merged_components(graph: Graph, local: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """((id, component), components after each level): local components merged until one part is left."""
    with measured(graph.vertices.sparkSession):
        found, n = cut_counted((local_components(graph) if local is None else local).distinct(), "merged")
        parts = cut(graph.parts, "parts")
        sizes = [found.select("component").distinct().count()] if n else []
        while parts.agg(F.count_distinct("part") > 1).first()[0]:
            parts = cut(next_parts(parts), "parts")
            found = cut(merge_level(found, graph.edges, parts), "merged")
            sizes.append(found.select("component").distinct().count())
    return found, sizes


# Steps of the merge that some callers want by themselves.


def buddy_edges(graph: Graph, own: bool = False) -> DataFrame:
    """Edges between a part and its buddy; with ``own`` also those inside a part."""
    e = cut_edges(graph).where(F.col("src_part") == buddy(F.col("dst_part"))).select("src", "dst")
    return e.union(alike(graph.edges, graph.parts, "part")) if own else e


def peeled_in(graph: Graph) -> DataFrame:
    """(id) left when vertices without an edge in from their own or buddy part are peeled off until none is left."""
    return peel_survivors(buddy_edges(graph, own=True), graph.vertices, within=True)


def peeled_both(graph: Graph) -> DataFrame:
    """(id) left when, after ``peeled_in``, vertices without such an edge out are peeled off too."""
    inner = cut(peeled_in(graph), "peeled")
    e = buddy_edges(graph, own=True)
    a, b = (inner.select(F.col("id").alias(c)) for c in ("src", "dst"))
    return peel_survivors(e.join(a, "src", "left_semi").join(b, "dst", "left_semi"), inner, within=False)


def trans_edges(graph: Graph, left: DataFrame | None = None) -> DataFrame:
    """(u1, u2): edges between buddy parts, among the vertices of ``left`` (id) if given."""
    e = buddy_edges(graph)
    if left is not None:
        a, b = (left.select(F.col("id").alias(c)) for c in ("src", "dst"))
        e = e.join(a, "src", "left_semi").join(b, "dst", "left_semi")
    return e.select(F.col("src").alias("u1"), F.col("dst").alias("u2"))


def partition_max_color(state: DataFrame) -> DataFrame:
    """(part, max_color) of the even parts of ``state`` (id, part, color)."""
    return state.where("part % 2 = 0").groupBy("part").agg(F.max("color").alias("max_color"))


def shift_colors(state: DataFrame) -> DataFrame:
    """(id, part, color): colors of odd parts moved past those of their even buddies, so that no two parts to be
    merged share any."""
    most = partition_max_color(state).select((F.col("part") + 1).alias("part"), "max_color")
    up = F.when(F.col("part") % 2 == 1, F.coalesce("max_color", F.lit(0)) + 1).otherwise(F.lit(0))
    return state.join(most, "part", "left").select("id", "part", (F.col("color") + up).alias("color"))
