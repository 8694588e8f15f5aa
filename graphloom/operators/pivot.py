"""Pivots: the vertex of the largest degree product, of all or of each group; ties go to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivots(state: DataFrame, scores: DataFrame, *keys: str) -> DataFrame:
    """(keys, pivot, score) of the vertices in ``state`` (id, keys); scores (id, score) are those of the whole graph.
    A score of 0 may win, so every group has a pivot."""
    best = F.max(F.struct(F.col("score"), (-F.col("id")).alias("neg"))).alias("best")
    scored = state.join(scores.select("id", "score"), "id")
    found = scored.groupBy(*keys).agg(best) if keys else scored.agg(best)
    return found.where("best is not null").select(*keys, (-F.col("best.neg")).alias("pivot"), F.col("best.score").alias("score"))
