"""All-sources reachability: on the condensation, by bits.

Vertices of one strong component reach the same, so the closure is of components. What a component reaches is held in blocks of 64
ids, a row for each block with any bit set; a round hands the bits that are new to the components before, by the edges between
components. Pairs of vertices come into being only where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.merge import components_of, condensation_edges
from graphloom.operators.reach import BUCKET_EDGES
from graphloom.plans.rounds import Record
from graphloom.plans.scratch import bucketed, cut, cut_counted


def closure(nodes: DataFrame, edges: DataFrame, record: Record | None = None) -> DataFrame:
    """(id, block, bits): bit i of block b is set for the id 64 b + i that ``id`` reaches over edges without cycles, itself included.

    Rounds are as many as the longest shortest path. Rows are kept in buckets, with those of each round added; only what a round hands on
    is exchanged."""
    spark = nodes.sparkSession
    near, n_edges = cut_counted(edges.select("src", "dst"), "closure-edges")
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_edges // BUCKET_EDGES + 1))
    own = nodes.select("id", F.shiftright("id", 6).alias("block"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bits"), F.lit(0).alias("round"))
    name, n = bucketed(own, "closure", buckets, ["id", "block"], by="round")
    rounds = 0
    while n:
        rounds += 1
        known = spark.table(name)
        fresh = known.where(F.col("round") == rounds - 1).select(F.col("id").alias("dst"), "block", "bits")
        step = near.join(fresh, "dst").select(F.col("src").alias("id"), "block", "bits").repartition(buckets, "id", "block").groupBy("id", "block").agg(F.bit_or("bits").alias("bits"))
        before = known.groupBy("id", "block").agg(F.bit_or("bits").alias("had"))
        new = F.expr("bits & ~coalesce(had, 0L)")
        grown = step.join(before, ["id", "block"], "left").select("id", "block", new.alias("bits"), F.lit(rounds).alias("round")).where("bits <> 0")
        _, n = bucketed(grown, "closure", buckets, ["id", "block"], name=name, by="round")
        if record is not None:
            record.add(round=rounds, changed=n)
    return spark.table(name).groupBy("id", "block").agg(F.bit_or("bits").alias("bits"))


def expanded(rows: DataFrame) -> DataFrame:
    """(id, to) for the bits of ``closure``."""
    return rows.select("id", "block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)).alias("bit")).select("id", (F.col("block") * 64 + F.col("bit")).alias("to"))


def reach_pairs(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, d): every vertex d that seed s (id) reaches, itself included. The output is quadratic by nature: for small parts only."""
    edges = cut(edges.select("src", "dst").distinct(), "pair-edges")
    seeds = cut(seeds.select("id").distinct(), "pair-seeds")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).union(seeds).distinct()
    found = cut(components_of(ends, edges), "pair-components")
    between = condensation_edges(found, edges)
    reached = expanded(closure(found.select(F.col("component").alias("id")).distinct(), between))
    members = found.select(F.col("component").alias("to"), F.col("id").alias("d"))
    sources = seeds.join(found, "id").select(F.col("id").alias("s"), F.col("component").alias("id"))
    return sources.join(reached, "id").join(members, "to").select("s", "d")


def reach_intersection(pairs: DataFrame) -> DataFrame:
    """(s, d) that reach each other."""
    return pairs.intersect(pairs.select(F.col("d").alias("s"), F.col("s").alias("d")))
