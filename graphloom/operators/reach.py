"""Reachability, by levels: each round extends a frontier over the edges and drops what was visited before.

Edges and visited vertices are tables in buckets of the same hash: a level's frontier finds its edges, and what it reaches finds what was
visited, where they are. Only what a level reaches is exchanged. Levels are partitions of the table of the visited, so the frontier is one of
them, and nothing is written twice.

Where only reachability is asked for, long paths do not take a level for each vertex: after some levels, vertices with
one edge in are contracted into the end of their chain, and take its answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.chains import chain_ends
from graphloom.operators.graph import transpose
from graphloom.plans.rounds import Record
from graphloom.plans.scratch import bucketed, cut, cut_counted, discard, plain

#: Edges for each bucket, at most as many buckets as partitions.
BUCKET_EDGES = 100_000
#: Rows for each bucket up to which a level's joins build hash tables of a bucket instead of sorting both sides.
HASHED = 200_000
#: Levels before chains are contracted; twice as many before they are again.
PATIENCE = 8


def level(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) one step along the edges from ``frontier`` (id)."""
    return edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def _levels(seeds: DataFrame, edges: DataFrame, keys: list[str], patience: int | None, record: Record | None = None, n_edges: int | None = None) -> tuple[DataFrame, DataFrame, int, int, DataFrame]:
    """(visited (keys, id, level), frontier (keys, id), rows of the frontier, rounds, edges as written); with ``patience``, it may stop before the
    frontier is empty. ``n_edges`` says how many edges there are, if that is known; else they are written once more to count them."""
    spark, columns = seeds.sparkSession, [*keys, "id"]
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = edges = edges.select(*keys, "src", "dst")
    if n_edges is None:
        flat, n_edges = cut_counted(edges, "search-edges")
    buckets = max(1, min(most, n_edges // BUCKET_EDGES + 1))
    ways, _ = bucketed(flat, "edges", buckets, [*keys, "src"])
    discard(flat)
    name, n = bucketed(seeds.select(*columns).distinct().withColumn("level", F.lit(0)), "visited", buckets, columns, by="level")
    rounds, seen = 0, n
    near = spark.table(ways).withColumnRenamed("src", "id")
    side = lambda table, rows: table.hint("shuffle_hash" if rows <= buckets * HASHED else "merge")  # noqa: E731  neither side is exchanged
    while n and (patience is None or rounds < patience):
        rounds += 1
        visited = spark.table(name)
        frontier = visited.where(F.col("level") == rounds - 1).select(*columns)
        step = near.join(side(frontier, n), columns).select(*keys, F.col("dst").alias("id")).repartition(buckets, *columns).distinct()
        fresh = step.join(side(visited.select(*columns), seen), columns, "left_anti").select(*columns, F.lit(rounds).alias("level"))
        with plain(spark):
            _, n = bucketed(fresh, "visited", buckets, columns, name=name, by="level")
        seen += n
        if record is not None:
            record.add(round=rounds, changed=n)
    visited = spark.table(name).select(*columns, F.col("level").cast("long").alias("level"))
    return visited, visited.where(F.col("level") == rounds).select(*columns), n, rounds, near.withColumnRenamed("id", "src")


def search(seeds: DataFrame, edges: DataFrame, keys: list[str], record: Record | None = None) -> tuple[DataFrame, int]:
    """((keys, id, level), rounds) of all that ``seeds`` (keys, id) reach over edges (keys, src, dst), seeds included."""
    found, _, _, rounds, _ = _levels(seeds, edges, keys, None, record)
    return found, rounds


def reachable(seeds: DataFrame, edges: DataFrame, keys: list[str], patience: int = PATIENCE, record: Record | None = None, n_edges: int | None = None) -> tuple[DataFrame, int]:
    """((keys, id), rounds): as ``search``, without levels, in rounds that grow with the logarithm of a chain. ``n_edges``: see ``_levels``."""
    columns = [*keys, "id"]
    found, frontier, n, rounds, edges = _levels(seeds, edges, keys, patience, record, n_edges)
    found = found.select(*columns)
    if not n:
        return found, rounds
    # What is not visited can be reached from the frontier only.
    here = [F.col("dst").alias("id") if c == "id" else F.col(c) for c in columns]
    rest = cut(edges.withColumn("id", F.col("dst")).join(found, columns, "left_anti").select(*keys, "src", "dst").distinct(), "search-rest")
    single = rest.groupBy(*here).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("up")).where("n = 1").select(*columns, "up")
    ends, more = chain_ends(cut(single, "single"), *keys)
    to = ends.select(*keys, F.col("id").alias("src"), F.col("up").alias("end"))
    kept = rest.withColumn("id", F.col("dst")).join(single, columns, "left_anti").join(to, [*keys, "src"], "left")
    kept, n_kept = cut_counted(kept.select(*keys, F.coalesce("end", "src").alias("src"), "dst").distinct(), "contracted")
    further, again = reachable(frontier, kept, keys, 2 * patience, record, n_kept)
    further = cut(further, "further")
    hanging = ends.join(further.withColumnRenamed("id", "up"), [*keys, "up"], "left_semi").select(*columns)
    return found.union(further.join(frontier, columns, "left_anti").select(*columns)).union(hanging), rounds + more + again


def reach(seeds: DataFrame, edges: DataFrame, backward: bool = False, record: Record | None = None) -> tuple[DataFrame, int]:
    """((id, level), rounds) of what is reached from ``seeds`` (id), or reaches them."""
    return search(seeds.select("id"), transpose(edges) if backward else edges, [], record)


def reach_all(seeds: DataFrame, edges: DataFrame, backward: bool = False) -> DataFrame:
    """(id) of what is reached from ``seeds`` (id), or reaches them."""
    return reachable(seeds.select("id"), transpose(edges) if backward else edges, [])[0]


def reach_both(seeds: DataFrame, edges: DataFrame, record: Record | None = None, n_edges: int | None = None) -> tuple[DataFrame, int]:
    """((id, fwd, bwd), rounds): both searches at once, one job for a level of each. ``n_edges`` says how many edges there are, if that is known."""
    ends = F.array(F.struct(F.lit("f").alias("way"), "src", "dst"), F.struct(F.lit("b").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = edges.select(F.explode(ends).alias("e")).select("e.*")
    starts = seeds.select("id", F.explode(F.array(F.lit("f"), F.lit("b"))).alias("way"))
    found, rounds = reachable(starts, ways, ["way"], record=record, n_edges=None if n_edges is None else 2 * n_edges)
    return found.groupBy("id").agg(F.max(F.col("way") == "f").alias("fwd"), F.max(F.col("way") == "b").alias("bwd")), rounds
