"""A vertex's state as named flags, and the packed byte that some tools exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of a packed tag.
TAG_BITS = {"fwd": 1, "bwd": 2, "fwd_done": 4, "bwd_done": 8, "finished": 16, "trim1": 32, "trim2": 64, "pivot": 128}


def packed_tag(**flags: Column) -> Column:
    """One number of the named flags; null counts as not set."""
    unknown = set(flags) - set(TAG_BITS)
    if unknown:
        raise ValueError(f"unknown flags: {sorted(unknown)}")
    tag = F.lit(0).cast("long")
    for name, flag in flags.items():
        tag = tag.bitwiseOR(F.when(flag, F.lit(TAG_BITS[name])).otherwise(F.lit(0)).cast("long"))
    return tag


def has_tag(tag: Column, name: str) -> Column:
    return tag.bitwiseAND(F.lit(TAG_BITS[name])) != 0


def next_color(pivot: Column, fwd: Column, bwd: Column) -> Column:
    """The color of what a pivot's search leaves: distinct for each pivot and class, and at most 3 * pivot + 2."""
    return 3 * pivot + fwd.cast("long") + 2 * bwd.cast("long")


def buddy(part: Column) -> Column:
    """The partition that merges with ``part`` next."""
    return part.bitwiseXOR(F.lit(1))
