"""Label propagation along edges with pointer jumping, and what builds on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import alike
from graphloom.operators.reach import reachable
from graphloom.plans.rounds import Record
from graphloom.plans.scratch import cut, cut_counted, cut_observed, discard, met


def unique_labels(vertices: DataFrame) -> DataFrame:
    """(id, label): every vertex is its own."""
    return vertices.select("id", F.col("id").alias("label"))


def partition_labels(parts: DataFrame) -> DataFrame:
    """(id, label): every vertex has its part's."""
    return parts.select("id", F.col("part").alias("label"))


def propagate(labels: DataFrame, edges: DataFrame, largest: bool = False) -> DataFrame:
    """(id, label): the least (or largest) of a vertex's own label and its out-neighbours'."""
    both, best = (F.greatest, F.max) if largest else (F.least, F.min)
    near = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(best("label").alias("near"))
    return labels.join(near, "id", "left").select("id", both("label", "near").alias("label"))


def jump(labels: DataFrame) -> DataFrame:
    """(id, label): the label of a vertex's label, which is a vertex."""
    ahead = labels.select(F.col("id").alias("label"), F.col("label").alias("ahead"))
    return labels.join(ahead, "label").select("id", F.col("ahead").alias("label"))


def extreme_reachable(vertices: DataFrame, edges: DataFrame, largest: bool = False, record: Record | None = None, within: bool = False) -> tuple[DataFrame, int]:
    """((id, label), rounds): the least (or largest) id that each vertex reaches over edges, itself included.

    A round is one job over the labels of the round before: a vertex takes the best of its own label, of those
    out-neighbours whose labels have just changed, and of its label's label. A label is always reached, and so is all
    that the label reaches: jumping is right for directed edges too. The edges that are looked at shrink to those of
    vertices that still change; it ends with the round in which none did.

    An end of an edge may be none of ``vertices``. It is a vertex like any other then; with ``within`` it only lends its id to the first round, and
    a vertex whose label is no vertex, or has left, has nothing to jump to and leaves in the next round."""
    both, best = (F.greatest, F.max) if largest else (F.least, F.min)
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct(), "label-edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if within:
        own, kept = cut_counted(ends.join(vertices.select("id").distinct(), "id", "left_semi"), "ends")
        within, ends = kept < ends.count(), own  # where all ends are vertices, none ever leaves
    near = edges.groupBy(F.col("src").alias("id")).agg(best("dst").alias("near"))
    labels = ends.join(met(near), "id", "left").select("id", both("id", "near").alias("label"))  # vertices without edges keep their own id
    labels, seen = cut_observed(labels.withColumn("changed", F.col("label") != F.col("id")), "label", F.count_if("changed").alias("n"))
    rounds = 1
    while True:
        if record is not None:
            record.add(round=rounds, changed=seen["n"])
        if not seen["n"]:
            break
        fresh, n = labels.where("changed").select("id", "label"), seen["n"]
        # A label's own label is news only to a vertex whose label has just changed, or if it has changed itself.
        news = edges.join(met(fresh.select(F.col("id").alias("dst"), F.col("label").alias("new")), n), "dst").select(F.col("src").alias("id"), "new")
        news = news.union(_ahead(labels, fresh, n)).groupBy("id").agg(best("new").alias("new"))
        new = labels.select("id", "label").join(met(news), "id", "left").select("id", "label", both("label", "new").alias("new"))
        if within:  # only a label that has just changed can be gone: one that stays is its own
            gone = fresh.select("label").distinct().join(met(labels.select(F.col("id").alias("label"))), "label", "left_anti")
            new = new.join(met(gone, n), "label", "left_anti")
        new = new.select("id", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("changed"))
        old = labels
        labels, seen = cut_observed(new, "label", F.count_if("changed").alias("n"))
        discard(old)
        rounds += 1
    discard(edges)
    out = vertices.select("id").join(labels.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    return out, rounds


def _ahead(labels: DataFrame, fresh: DataFrame, n: int) -> DataFrame:
    """(id, new): labels of labels that are news: those of the ``n`` vertices of ``fresh`` (id, label), and those that are among ``fresh``
    themselves. The label that most vertices have is looked up once, and is news only where it has another."""
    asked = fresh.select(F.col("label").alias("id")).distinct()
    other = labels.select("id", "label").join(met(asked, n), "id", "left_semi").where("label <> id").select(F.col("id").alias("label"), F.col("label").alias("new"))
    moved = fresh.join(met(other, n), "label").select("id", "new")
    told = fresh.select(F.col("id").alias("label"), F.col("label").alias("new"))
    still = labels.where("not changed").select("id", "label").join(met(told, n), "label").select("id", "new")
    return moved.union(still)


def min_reachable_label(vertices: DataFrame, edges: DataFrame, record: Record | None = None) -> DataFrame:
    """(id, label): the least id reachable. Vertices of one strong component agree, but so may others."""
    return extreme_reachable(vertices, edges, record=record)[0]


def max_color(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the largest id reachable."""
    return extreme_reachable(vertices, edges, largest=True)[0]


def color_roots(colors: DataFrame) -> DataFrame:
    """(id) of the vertices that are their own color."""
    return colors.where("label = id").select("id")


def color_components(colors: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): what each root reaches inside its color, which is its strong component."""
    inside = alike(edges, colors.withColumnRenamed("label", "color"), "color")
    found, _ = reachable(color_roots(colors), inside, [])
    return found.select("id").join(colors, "id").select("id", F.col("label").alias("component"))


def weakly_connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id connected over edges either way."""
    return contracted(vertices, edges)[0]


def contracted(vertices: DataFrame, edges: DataFrame, record: Record | None = None) -> tuple[DataFrame, int]:
    """((id, component), rounds): weak components by contraction.

    In each round every vertex that has edges left goes into that of its neighbours and itself which the round's hash puts first. Edges
    follow, and those that become loops or repeats are dropped: what is left shrinks by about half or more a round, whatever the graph's
    diameter, and no vertex is written again once its component has no edges left. In the end the maps of all rounds are
    joined backwards, which tells each vertex where it went."""
    either = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    rest, n = cut_counted(either(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "wcc-edges")
    maps: list[DataFrame] = []
    while n:
        first = F.min(F.struct(F.xxhash64(F.lit(len(maps)), "b").alias("h"), F.col("b").alias("id"))).alias("first")
        near = rest.select("a", "b").union(rest.select("b", "a")).groupBy("a").agg(first)
        own = F.struct(F.xxhash64(F.lit(len(maps)), "a").alias("h"), F.col("a").alias("id"))
        maps.append(cut(near.select(F.col("a").alias("id"), F.least("first", own)["id"].alias("to")), "wcc-map"))
        a, b = (maps[-1].select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = rest.join(a, "a").join(b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        old, before = rest, n
        rest, n = cut_counted(either(moved), "wcc-edges")
        discard(old)
        if record is not None:
            record.add(round=len(maps), changed=before - n, left=n)
    if not maps:
        return vertices.select("id", F.col("id").alias("component")), 0
    ends = maps[-1]
    for m in reversed(maps[:-1]):
        ends = cut(m.join(ends.select(F.col("id").alias("to"), F.col("to").alias("end")), "to", "left").select("id", F.coalesce("end", "to").alias("to")), "wcc-ends")
    least = ends.groupBy("to").agg(F.min("id").alias("component"))
    named = ends.join(least, "to").select("id", "component")
    return vertices.select("id").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component")), len(maps)
