"""Forward-backward search: a color is a union of whole strong components; its pivot's search splits it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.tags import next_color
from graphloom.operators.graph import alike, among
from graphloom.operators.pivot import pivots
from graphloom.operators.reach import reach_both
from graphloom.plans.rounds import Record
from graphloom.plans.scratch import cut, cut_counted, cut_observed, discard


def color_update(state: DataFrame, found: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    """(id, keys, color, finished, component) after a search: what is found both ways is the pivot's component;
    the rest gets a color for each pivot and class.

    state: (id, keys); found: (id, fwd, bwd); chosen: (keys, pivot)."""
    if keys:
        s = state.join(chosen.select(*keys, "pivot"), list(keys))
    else:
        row = chosen.first()  # the only one
        s = state.withColumn("pivot", F.lit(row.pivot if row else None).cast("long"))
    s = s.join(found, "id", "left").select("id", *keys, "pivot", F.coalesce("fwd", F.lit(False)).alias("fwd"), F.coalesce("bwd", F.lit(False)).alias("bwd"))
    done = F.col("fwd") & F.col("bwd")
    rest = [k for k in keys if k != "color"]
    return s.select("id", *rest, next_color(F.col("pivot"), F.col("fwd"), F.col("bwd")).alias("color"), done.alias("finished"), F.when(done, F.col("pivot")).alias("component"))


def split(state: DataFrame, edges: DataFrame, scores: DataFrame, *keys: str, record: Record | None = None) -> tuple[DataFrame, int]:
    """``color_update`` of one pivot's search in every group of ``state`` (id, keys), or in all of it."""
    return split_inside(state, alike(edges, state, *keys) if keys else among(edges, state), scores, *keys, record=record)[:2]


def split_inside(state: DataFrame, inside: DataFrame, scores: DataFrame, *keys: str, record: Record | None = None, n_edges: int | None = None) -> tuple[DataFrame, int, int]:
    """(rows of ``split``, rounds, unfinished vertices), with the edges that are inside groups, and their number, if known."""
    chosen = cut(pivots(state, scores, *keys), "pivots")
    found, rounds = reach_both(chosen.select(F.col("pivot").alias("id")), inside, record, n_edges)
    after, seen = cut_observed(color_update(state, found, chosen, *keys), "split", F.count_if(~F.col("finished")).alias("left"))
    return after, rounds, seen["left"]


def fw_bw(state: DataFrame, edges: DataFrame, scores: DataFrame, *keys: str, record: Record | None = None) -> tuple[DataFrame, list[int]]:
    """((id, component), rounds of each search): splits ``state`` (id, keys) until all of it is finished.

    keys: color, or part and color, within which components are sought. The component is the pivot's id."""
    done, rounds = [], []
    state, n = cut_counted(state.select("id", *keys), "state")
    while n:
        old = edges
        edges, n_edges = cut_counted(alike(edges, state, *keys), "active-edges")
        if rounds:  # the first are the caller's
            discard(old)
        after, r, n = split_inside(state, edges, scores, *keys, record=record, n_edges=n_edges)
        rounds.append(r)
        done.append(after.where("finished").select("id", "component"))
        state = after.where("not finished").select("id", *keys)
    out = state.select("id", F.lit(0).cast("long").alias("component"))  # empty
    for d in done:
        out = out.union(d)
    return out, rounds


def canonical(components: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each component for its name."""
    least = components.groupBy("component").agg(F.min("id").alias("least"))
    return components.join(least, "component").select("id", F.col("least").alias("component"))
