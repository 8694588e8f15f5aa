"""Counts the strong components of a graph file.

python -m graphloom.cli -a g -p 1 -q 1 -w 1 -f graph.gr [--partition graph.part.10]
"""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Row

from graphloom.operators.graph import Graph
from graphloom.plans.pipelines import PIPELINES, WARPS, strong_components
from graphloom.plans.session import local_session, ship
from graphloom.sources.text_graphs import read_gtgraph, read_partition, read_plain


def parser(kind: type[argparse.ArgumentParser] = argparse.ArgumentParser) -> argparse.ArgumentParser:
    p = kind(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-a", choices=list(PIPELINES), required=True, help="g, x: forward-backward search; h, y: coloring; d: by parts")
    p.add_argument("-p", type=int, choices=(0, 1), default=1, help="trim single vertices")
    p.add_argument("-q", type=int, choices=(0, 1), default=1, help="trim pairs (not for h and y)")
    p.add_argument("-w", type=int, choices=WARPS, default=1, help="accepted, without effect")
    p.add_argument("-f", required=True, help="graph file")
    p.add_argument("--plain", action="store_true", help="the file begins with V E")
    p.add_argument("--partition", help="file with the part of each vertex; needed for d")
    p.add_argument("--verbose", action="store_true", help="seconds and rounds by phase")
    return p


class _Message(Exception):
    pass


class _Checking(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise _Message(message)


def checked(args: argparse.Namespace, p: argparse.ArgumentParser) -> argparse.Namespace:
    if args.a == "d" and not args.partition:
        p.error("-a d needs --partition")
    return args


def outcome(line: str, p: argparse.ArgumentParser | None = None) -> tuple[str | None, int | None, int | None, int | None, str]:
    """(algorithm, trim1, trim2, warp, message) of a line of arguments; the message is ``ok``, or what is wrong, without the choices."""
    p = p or parser(_Checking)
    try:
        args = checked(p.parse_args(line.split()), p)
    except _Message as m:
        return None, None, None, None, ":".join(str(m).split(":")[:2])
    return args.a, args.p, args.q, args.w, "ok"


#: Lines whose outcome a task keeps, for their repeats.
KEPT_LINES = 1 << 16


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = parser(_Checking)  # making one takes longer than a line does
    of = lru_cache(KEPT_LINES)(lambda line: outcome(line, p))
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    for b in batches:
        rows = [of(x) for x in b.column("line").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("line"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["line", "algorithm", "trim1", "trim2", "warp", "message"])


def outcomes(lines: DataFrame) -> DataFrame:
    """(line, algorithm, trim1, trim2, warp, message) of each of ``lines`` (line): the arguments of many runs, checked before any begins.

    Lines are dealt out first: a table in one file would be one task's."""
    spark = lines.sparkSession
    ship(spark)
    dealt = lines.select("line").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(_outcomes, "line string, algorithm string, trim1 int, trim2 int, warp int, message string")


def report(row: Row, trimmed: bool) -> list[str]:
    """The lines for a run's summary, but for the time."""
    return [f"numberOf1Sccs: {row.n_trim1}"] * trimmed + [f"Number Of Sccs : {row.n_scc}"]


def main(argv: list[str] | None = None) -> int:
    args = checked(parser().parse_args(argv), parser())
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = local_session("*", 8)
    graph, _ = (read_plain if args.plain else read_gtgraph)(spark, args.f)
    if args.partition:
        graph = Graph(graph.vertices, graph.edges, read_partition(spark, args.partition, graph))
    start = time.time()
    result = strong_components(graph, args.a, bool(args.p), bool(args.q), args.w)
    print(*report(result.summary().first(), bool(args.p)), sep="\n")
    print(f"Time : {(time.time() - start) * 1000:f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
