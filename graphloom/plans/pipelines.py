"""End-to-end strong components: three ways to the same answer.

Each returns (id, component, kind): component is the smallest id of the component, kind tells which phase found it.
"""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fwbw import canonical, fw_bw, split_inside
from graphloom.operators.graph import Graph, alike, among, degrees
from graphloom.operators.label import color_components, max_color, min_reachable_label
from graphloom.operators.merge import condensation_edges, local_components, merged_components  # noqa: F401  (condensation_edges: callers know it by this module)
from graphloom.operators.trim import trim1, trim1_survivors, trim2
from graphloom.plans.rounds import Record
from graphloom.plans.scratch import cut, discard, measured

log = logging.getLogger(__name__)


@dataclass
class Result:
    components: DataFrame
    phases: list[dict] = field(default_factory=list)  # name, seconds, rounds
    record: Record = field(default_factory=Record)

    def rounds(self) -> DataFrame:
        """(step, phase, round, changed, left): what each round of trimming, searching and labelling did."""
        return self.record.table(self.components.sparkSession)

    def summary(self) -> DataFrame:
        """One row: n_scc, n_trim1, n_trim2, n_pivot. A component is counted at the vertex that it is named after, so that no rows are
        shuffled but the counts."""
        named = F.col("id") == F.col("component")
        of = lambda k: F.count_if(named & (F.col("kind") == k)).alias(f"n_{k}")
        return self.components.agg(F.count_if(named).alias("n_scc"), of("trim1"), of("trim2"), of("pivot"))


class _Run:
    """The active vertices (id, color) and edges of a run, and what is done."""

    def __init__(self, graph: Graph) -> None:
        self.vertices, self.phases, self.record = graph.vertices.select("id"), [], Record()
        self.edges = cut(graph.edges.select("src", "dst"), "edges")
        self.scores = cut(degrees(graph), "degrees")
        self.state = cut(self.vertices.withColumn("color", F.lit(0).cast("long")), "state")
        self.done: list[DataFrame] = []

    def phase(self, name: str, work: Callable[[], int | None]) -> None:
        start = time.time()
        self.record.begin(len(self.phases) + 1, name)
        rounds = work()
        self.phases.append({"phase": name, "seconds": time.time() - start, "rounds": rounds or 1})
        log.info("%s: %.2f s, %s rounds", name, self.phases[-1]["seconds"], rounds or 1)

    def finish(self, found: DataFrame, kind: str) -> None:
        """Takes found (id, component) out of the active vertices and edges."""
        found = cut(found.select("id", "component", F.lit(kind).alias("kind")), kind)
        self.done.append(found)
        state, edges = self.state, self.edges
        self.state = cut(state.join(found, "id", "left_anti"), "state")
        self.edges = cut(among(edges, self.state), "edges")
        discard(state, edges)

    def trim1(self, once: bool = False) -> int:
        inside = alike(self.edges, self.state, "color")
        edges, rounds = (inside, 1) if once else trim1(inside, record=self.record)
        gone = self.state.join(trim1_survivors(edges), "id", "left_anti")
        self.finish(gone.select("id", F.col("id").alias("component")), "trim1")
        return rounds

    def trim2(self) -> None:
        pairs = cut(trim2(cut(alike(self.edges, self.state, "color"), "edges")), "pairs")
        self.finish(pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id"), F.col("a").alias("component")), "trim2")

    def first_pivot(self) -> int:
        after, rounds, _ = split_inside(self.state.select("id"), self.edges, self.scores, record=self.record)
        self.state = after.select("id", "color")
        self.finish(after.where("finished").select("id", "component"), "pivot")
        return rounds

    def labels(self) -> None:
        self.state = cut(min_reachable_label(self.state, self.edges, self.record).withColumnRenamed("label", "color"), "state")

    def split_colors(self) -> int:
        found, rounds = fw_bw(self.state, self.edges, self.scores, "color", record=self.record)
        self.finish(found, "pivot")
        return sum(rounds)

    def coloring(self) -> int:
        """The largest id reachable is a color, and what its root reaches inside it a component, until all is done. What
        does not lie between cycles any more is done by itself."""
        rounds = 0
        while True:
            edges, _ = trim1(self.edges)
            ids = cut(trim1_survivors(edges), "ids")
            alone = self.state.join(ids, "id", "left_anti").select("id", F.col("id").alias("component"))
            found = color_components(cut(max_color(ids, edges), "colors"), edges)
            self.finish(alone.union(found), "pivot")
            rounds += 1
            if not self.state.head(1):
                return rounds

    def result(self) -> Result:
        out = self.done[0]
        for d in self.done[1:]:
            out = out.union(d)
        out = cut(out, "result")
        named = canonical(out.select("id", "component"))
        return Result(cut(named.join(out.select("id", "kind"), "id"), "components"), self.phases, self.record)


def _measured(pipeline: Callable[..., Result]) -> Callable[..., Result]:
    """A pipeline whose jobs, all of them its own, broadcast only what is measured."""

    @functools.wraps(pipeline)
    def run(graph: Graph, *args: bool, **options: bool) -> Result:
        with measured(graph.vertices.sparkSession):
            return pipeline(graph, *args, **options)

    return run


@_measured
def hong(graph: Graph, use_trim1: bool = True, use_trim2: bool = True) -> Result:
    """Trim, take out the component of the vertex of the largest degree product, trim, decompose by reachable labels,
    and split the rest by forward-backward search of all labels at once."""
    run = _Run(graph)
    if use_trim1:
        run.phase("trim1", run.trim1)
    run.phase("first pivot", run.first_pivot)
    if use_trim1:
        run.phase("trim1", run.trim1)
    if use_trim2:
        run.phase("trim2", run.trim2)
        if use_trim1:
            run.phase("trim1", run.trim1)
    run.phase("labels", run.labels)
    run.phase("split", run.split_colors)
    return run.result()


@_measured
def slota(graph: Graph, use_trim1: bool = True) -> Result:
    """One pass of trimming, the component of the first pivot, and coloring for the rest."""
    run = _Run(graph)
    if use_trim1:
        run.phase("trim1", lambda: run.trim1(once=True))
    run.phase("first pivot", run.first_pivot)
    run.phase("coloring", run.coloring)
    return run.result()


@_measured
def partitioned(graph: Graph, use_trim1: bool = True, use_trim2: bool = True) -> Result:
    """Trim, find components inside each part, and merge parts pair by pair."""
    if graph.parts is None:
        raise ValueError("the partitioned pipeline needs parts")
    run = _Run(graph)
    if use_trim1:
        run.phase("trim1", run.trim1)
    if use_trim2:
        run.phase("trim2", run.trim2)
        if use_trim1:
            run.phase("trim1", run.trim1)
    parts = cut(graph.parts.join(run.state.select("id"), "id", "left_semi").select("id", "part"), "parts")
    rest = Graph(run.state.select("id"), run.edges, parts)
    local: list[DataFrame] = []
    run.phase("local components", lambda: local.append(cut(local_components(rest), "local")))
    levels: list[int] = []

    def merge() -> int:
        found, sizes = merged_components(rest, local[0])
        levels.extend(sizes)
        run.finish(found, "pivot")
        return len(sizes)

    run.phase("merge", merge)
    run.phases[-1]["components"] = levels
    return run.result()


#: Names of the pipelines: fixed values. The second of a pair differs only in how threads share work, which Spark decides.
PIPELINES = {"g": hong, "x": hong, "h": slota, "y": slota, "d": partitioned}
WARPS = (1, 2, 4, 8, 16, 32)


def strong_components(graph: Graph, algorithm: str = "g", use_trim1: bool = True, use_trim2: bool = True, warp_size: int = 1) -> Result:
    """Runs a pipeline by name; ``warp_size`` must be one of WARPS and changes nothing."""
    if algorithm not in PIPELINES:
        raise ValueError(f"algorithm must be one of {', '.join(PIPELINES)}")
    if warp_size not in WARPS:
        raise ValueError(f"warp size must be one of {WARPS}")
    run = PIPELINES[algorithm]
    return run(graph, use_trim1) if run is slota else run(graph, use_trim1, use_trim2)


def component_histogram(components: DataFrame) -> DataFrame:
    """(size, n): how many components have so many vertices."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))
