"""Connected components of an undirected edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut_observed, discard

#: A round over so many edges at most (under 1 MB) is one task without an exchange; more are shuffled.
ONE_TASK = 50_000


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges (a, b) as a table, and their number and sum, from the same job."""
    return cut_observed(edges, "edges", F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))


def _turned(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(a, b): these pairs of columns of every row, one below the other."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node of ``edges`` (a, b).

    Each round links every node to the least of its neighbours, first on the larger side, then on the
    smaller, until nothing changes; a hub's neighbours are joined, never gathered. Loops and repeated edges do no harm.
    A round is one job: on a driver every job, and every task of it, leaves records behind.
    """
    e, state = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    # Spark forgets at a join that all is in one partition.
    dealt = lambda rows: rows.coalesce(1) if state["n"] <= ONE_TASK else rows
    while True:
        both = _turned(dealt(e), ("a", "b"), ("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # One row for each edge, repeats included.
        large = dealt(both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = dealt(_turned(large.join(least.hint("merge"), "a"), ("b", "m"), ("a", "m")).where("a <> b")).distinct()
        old, before = e, state
        e, state = _written(small)
        discard(old)
        if state == before:
            break
    return _turned(dealt(e), ("a", "b"), ("b", "b")).select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
