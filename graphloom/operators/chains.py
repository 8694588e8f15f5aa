"""Chains of vertices that hang on one other vertex each, followed by pointer doubling.

A vertex with a single edge in is reached if and only if its one in-neighbour is, and loses that edge if and only if the neighbour goes. So
what such vertices have in common with the end of their chain is found in as many rounds as the logarithm of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut_observed, discard, met


def chain_ends(pointers: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """((keys, id, up), rounds): for each of ``pointers`` (keys, id, up), the first vertex on its way up that has no pointer itself.

    A vertex has one pointer at most for the same keys. Those whose way leads into a circle have no end and are left out. After k rounds
    all within 3^k of an end have theirs, and a round that ends no way is the last: what is open then is circles and their trees."""
    columns = [*keys, "id", "up"]
    own = pointers.select(*columns)
    has = own.select(*keys, F.col("id").alias("up"), F.lit(True).alias("open"))
    table, seen = cut_observed(own.join(met(has), [*keys, "up"], "left").select(*columns, F.coalesce("open", F.lit(False)).alias("open")), "chains", F.count_if("open").alias("n"))
    rounds, left = 0, seen["n"]
    while left:
        up = table.select(*keys, F.col("id").alias("up"), F.col("up").alias("far"), F.col("open").alias("still"))
        moved = table.where("open")
        for _ in range(2):  # two jumps of the same length in one job; what has got to an end finds no pointer there
            moved = moved.join(met(up), [*keys, "up"], "left").select(*keys, "id", F.coalesce("far", "up").alias("up"), F.coalesce("still", F.lit(False)).alias("open"))
        old, before = table, left
        table, seen = cut_observed(table.where("not open").union(moved.select(*table.columns)), "chains", F.count_if("open").alias("n"))
        discard(old)
        left, rounds = seen["n"], rounds + 1
        if left == before:
            break
    return table.where("not open").select(*columns), rounds
