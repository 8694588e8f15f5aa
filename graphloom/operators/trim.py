"""Trimming: vertices that are strongly connected components by themselves, or in pairs, by their degrees.

All operators take edges among active vertices of one color; a survivor has edges both ways, so the
surviving edges say which vertices survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.chains import chain_ends
from graphloom.plans.rounds import Record
from graphloom.plans.scratch import cut, cut_counted, cut_observed, discard, met


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct()


def targets(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("id")).distinct()


def trim1_survivors(edges: DataFrame) -> DataFrame:
    """(id) of vertices with an edge in and an edge out; a loop counts as both."""
    return sources(edges).join(targets(edges), "id", "left_semi")


#: A round that removes less than one in so many vertices is thin: from round PATIENCE on, chains are then followed to their ends. Where that does
#: not remove so many times what the round itself does, the next try is put off for twice as long.
THIN, PATIENCE, WORTH = 32, 16, 8


def _counts(edges: DataFrame) -> DataFrame:
    """(id, n_in, x_in, n_out, x_out): how many distinct edges lead in and out of every vertex on ``edges``, and the exclusive or of the
    vertices at their other ends: where one edge is left, that vertex itself."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), "src", F.lit(0).cast("long").alias("dst"))
    ends = ends.union(edges.select("src", F.lit(0), F.lit(1), F.lit(0).cast("long"), "dst"))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.bit_xor("src").alias("x_in"), F.sum("o").alias("n_out"), F.bit_xor("dst").alias("x_out"))


def _losses(edges: DataFrame, within: bool, without: bool) -> DataFrame:
    """(id, way, other): when ``id`` goes, ``other`` loses an edge in (i) or out (o)."""
    i = edges.select(F.col("src").alias("id"), F.lit("i").alias("way"), F.col("dst").alias("other"))
    o = edges.select(F.col("dst").alias("id"), F.lit("o").alias("way"), F.col("src").alias("other"))
    return i.union(o) if within and without else i if within else o


def _hanging(state: DataFrame, gone: DataFrame, within: bool, without: bool) -> DataFrame:
    """(id) of the vertices that go as well because all they hang on, by one edge after the other, goes."""
    of = lambda way, n, x: state.where(F.col(n) == 1).select(F.lit(way).alias("way"), "id", F.col(x).alias("up"))
    i, o = of("i", "n_in", "x_in"), of("o", "n_out", "x_out")
    ends, _ = chain_ends(i.union(o) if within and without else i if within else o, "way")
    return ends.join(met(gone.select(F.col("id").alias("up"))), "up", "left_semi").select("id")


def peel(edges: DataFrame, within: bool = True, without: bool = True, label: str = "peel", chains: bool = True, record: Record | None = None) -> tuple[DataFrame, int]:
    """(edges, rounds): repeatedly removes vertices with no edge in (``within``) or none out (``without``)
    along with their edges, until none is left.

    The edges stay as they are; what changes is a table of degrees. A round reads the edges of the vertices that the round before
    removed and takes them off the degrees of their other ends. Once most edges are those of removed vertices, the others are
    written anew. Where rounds become thin, whole chains go at once (``chains``): so a path takes a logarithm of its length."""
    edges = cut(edges.select("src", "dst"), label)
    losses, n_losses = cut_counted(_losses(edges.distinct(), within, without), "losses")
    goes = F.lit(False)
    for asked, n in ((within, "n_in"), (without, "n_out")):
        goes = goes | (F.col(n) == 0) if asked else goes
    measures = F.count(F.lit(1)).alias("left"), F.count_if(goes).alias("gone")
    state, seen = cut_observed(_counts(edges.distinct()), "degrees", *measures)
    rounds, lost, next_try, wait, all_ = 0, 0, PATIENCE, PATIENCE, seen["left"]
    while seen["gone"]:
        rounds += 1
        gone, removed, rest = state.where(goes).select("id"), seen["gone"], state.where(~goes)
        if chains and rounds >= next_try and seen["gone"] * THIN < seen["left"]:
            gone, removed = cut_counted(gone.union(_hanging(state, gone, within, without)).distinct(), "hanging")
            rest = state.join(met(gone, removed), "id", "left_anti")
            wait = PATIENCE if removed > WORTH * seen["gone"] else 2 * wait
            next_try = rounds + wait
        if record is not None:
            record.add(round=rounds, changed=removed, left=seen["left"] - removed)
        if removed == seen["left"]:
            return edges.limit(0), rounds
        less = losses.join(met(gone, removed), "id").groupBy(F.col("other").alias("id")).agg(
            *(f.alias(f"d_{n}") for w, end in (("i", "in"), ("o", "out")) for n, f in ((f"n_{end}", F.count_if(F.col("way") == w)), (f"x_{end}", F.bit_xor(F.when(F.col("way") == w, F.col("id")).otherwise(F.lit(0).cast("long"))))))
        )
        rest = rest.join(met(less), "id", "left")
        zero = F.lit(0).cast("long")
        new = [f(F.col(c), F.coalesce(F.col(f"d_{c}"), zero)).alias(c) for c, f in (("n_in", _minus), ("x_in", _xor), ("n_out", _minus), ("x_out", _xor))]
        old = state
        state, seen = cut_observed(rest.select("id", *new, (F.coalesce("d_n_in", zero) + F.coalesce("d_n_out", zero)).alias("lost")), "degrees", *measures, F.sum("lost").alias("lost"))
        discard(old)
        lost += seen["lost"] or 0
        if seen["gone"] and 2 * lost > n_losses:
            old = losses
            losses, n_losses = cut_counted(losses.join(met(state.select("id")), "id", "left_semi").join(met(state.select(F.col("id").alias("other"))), "other", "left_semi").select("id", "way", "other"), "losses")
            discard(old)
            lost = 0
    if record is not None:
        record.add(round=rounds + 1, changed=0, left=seen["left"])
    discard(losses)
    if seen["left"] == all_:
        return edges, rounds
    src, dst = (state.select(F.col("id").alias(c)) for c in ("src", "dst"))
    return cut(edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select("src", "dst"), label), rounds


def _minus(a: Column, b: Column) -> Column:
    return a - b


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def trim1(edges: DataFrame, chains: bool = True, record: Record | None = None) -> tuple[DataFrame, int]:
    """(edges among the survivors, rounds): trimming to the fixpoint, which is what lies between cycles."""
    return peel(edges, label="trim1", chains=chains, record=record)


def peel_survivors(edges: DataFrame, vertices: DataFrame, within: bool) -> DataFrame:
    """(id) of what is left when vertices without an edge in (or out) are peeled off until none is left. Unlike
    in ``trim1`` a survivor may have no edge the other way."""
    kept, _ = peel(edges, within, not within)
    side = targets(kept) if within else sources(kept)
    return vertices.select("id").join(side, "id", "left_semi")


def trim2(edges: DataFrame) -> DataFrame:
    """(a, b), a <= b: pairs each of which has its only edge in, or only edge out, from the other.

    Parallel edges count one by one, so a doubled edge blocks the rule. A vertex whose only edge in or out is
    its loop makes a pair with itself."""

    def mutual(end: str, other: str) -> DataFrame:
        only = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"), F.min(other).alias("k")).where("n = 1").select("id", "k")
        back = only.select(F.col("k").alias("id"), F.col("id").alias("k"))
        return only.join(back, ["id", "k"], "left_semi").select(F.least("id", "k").alias("a"), F.greatest("id", "k").alias("b"))

    return mutual("dst", "src").union(mutual("src", "dst")).distinct()
