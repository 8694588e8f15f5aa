"""Graph text formats as Spark data sources: ``spark.read.format("gtgraph").load(path)``, ``df.write.format("metis").save(path)``.

* ``gtgraph`` reads edges (src, dst, weight) from lines ``a u v w``; with the option ``table`` = ``sizes``, the numbers of vertices and edges that
  the file announces, by ``p sp V E`` or a first line ``V E``
* ``metis`` reads (id, pos, nbr): vertex i's neighbours are on line i, after a header ``V E``; ``table`` = ``sizes`` as above. It writes chunks
  (id, chunk, neighbours, last), sorted by id and chunk, all of an id in one task; a line may be of any length
* ``vertex_parts`` reads (id, part) from lines with a part each
* ``line_counts`` reads (file, start, lines): how many lines begin in each split

A path is a file or a folder, whose files are read in the order of their names, in splits of ``splitBytes``. A split takes the lines that begin in it. In
formats where a line's number counts, splits need to know their first line's: from the option ``index``, a file that
``line_index`` makes by a Spark job, or from the one that the writer leaves beside its lines. Without either, one task streams all files.

Files are opened by Arrow's file systems, by their URI; nothing larger than a block of bytes, or a line, is held.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from graphloom.plans.scratch import new_path
from graphloom.plans.session import ship

SPLIT_BYTES, BLOCK_BYTES, BATCH_ROWS = 32 << 20, 1 << 20, 1 << 16
#: Name of the writer's index.
INDEX = "_lines.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files, in the order of their names, without hidden ones."""
    system, at = opened(path)
    own = system.get_file_info(at)
    if own.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if own.type == fs.FileType.File:
        return [(at, own.size)]
    files = [f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return sorted((f.path, f.size) for f in files)


def line_blocks(file: pa.NativeFile, start: int, end: int, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The lines that begin in the bytes from start up to end, some at a time."""
    at, rest = max(0, start - 1), b""
    file.seek(at)
    skip = start > 0
    while at < end:
        more = file.read(block)
        data = rest + more
        if skip:
            where = data.find(b"\n") + 1
            if not where:
                if not more:
                    return
                at += len(data)
                continue
            data, at, skip = data[where:], at + where, False
            if at >= end:
                return
        if not more:
            if data:
                yield [data]
            return
        whole = data.find(b"\n", max(0, end - 1 - at)) + 1 if at + len(data) >= end else 0
        if whole:
            yield data[: whole - 1].split(b"\n")
            return
        whole = data.rfind(b"\n") + 1
        if whole:
            yield data[: whole - 1].split(b"\n")
        elif len(data) > block:
            block *= 2  # a long line is not copied over and over
        rest, at = data[whole:], at + whole


@dataclass
class Split(InputPartition):
    files: list[tuple[str, int, int]]  # path, start, end; more than one only where one task reads all
    line: int = 0  # number of its first line


class _Reader(DataSourceReader):
    """Splits of a path's files, and their lines."""

    numbered = False

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.schema, self.sizes = options["path"], schema, options.get("table") == "sizes"
        self.step, self.index = int(options.get("splitBytes", SPLIT_BYTES)), options.get("index")

    def _ranges(self) -> list[tuple[str, int, int]]:
        return [(p, s, min(s + self.step, n)) for p, n in listed(self.path) for s in range(0, n, self.step)]

    def _counts(self) -> dict[tuple[str, int], int] | None:
        """(file, start) to lines, from an index."""
        system, at = opened(self.index or f"{self.path.rstrip('/')}/{INDEX}")
        if system.get_file_info(at).type != fs.FileType.File:
            return None
        with system.open_input_stream(at) as f:
            return {(name, start): n for name, start, n in json.loads(f.read())}

    def partitions(self) -> list[InputPartition]:
        ranges = self._ranges()
        if self.sizes:
            return [Split(ranges)]
        if not self.numbered:
            return [Split([r]) for r in ranges]
        known = self._counts()
        keys = [(p.rsplit("/", 1)[-1], s) for p, s, _ in ranges]
        if known is None or (not self.index and not set(keys) <= set(known)):
            return [Split(ranges)]
        out, line = [], 0
        for r, key in zip(ranges, keys, strict=True):
            out.append(Split([r], line))
            line += known[key]
        return out

    def lines(self, split: Split) -> Iterator[tuple[int, list[bytes]]]:
        """(number of the first, lines), block by block."""
        system, _ = opened(self.path)
        number = split.line
        for path, start, end in split.files:
            with system.open_input_file(path) as f:
                for found in line_blocks(f, start, end):
                    yield number, found
                    number += len(found)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if self.sizes:
            for number, found in self.lines(partition):
                for k, line in enumerate(found):
                    if size := self.size_of(number + k, line.split()):
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in size], ["vertices", "edges"])
                        return
            raise ValueError(f"{self.path}: no line with the sizes")
        else:
            for number, found in self.lines(partition):
                for columns in self.rows(number, found):
                    for lo in range(0, len(columns[0]), BATCH_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + BATCH_ROWS]) for c in columns], self.schema.names)

    def size_of(self, number: int, tokens: list[bytes]) -> tuple[int, int] | None:
        raise NotImplementedError

    def rows(self, number: int, found: list[bytes]) -> Iterator[list]:
        """Columns of the rows that are on the lines."""
        raise NotImplementedError


class EdgeReader(_Reader):
    def size_of(self, number: int, tokens: list[bytes]) -> tuple[int, int] | None:
        if len(tokens) >= 4 and tokens[0] == b"p":
            return int(tokens[2]), int(tokens[3])
        return (int(tokens[0]), int(tokens[1])) if len(tokens) == 2 and tokens[0].isdigit() else None

    def rows(self, number: int, found: list[bytes]) -> Iterator[list]:
        tokens = [t[1:4] for t in (line.split() for line in found) if t and t[0] == b"a"]
        if any(len(t) < 3 for t in tokens):
            raise ValueError(f"{self.path}: an edge line needs two vertices and a weight")
        yield list(np.array([x for t in tokens for x in t], "S").astype(np.int64).reshape(-1, 3).T) if tokens else [np.zeros(0, np.int64)] * 3


class NeighbourReader(_Reader):
    numbered = True

    def size_of(self, number: int, tokens: list[bytes]) -> tuple[int, int] | None:
        return (int(tokens[0]), int(tokens[1])) if number == 0 else None

    def rows(self, number: int, found: list[bytes]) -> Iterator[list]:
        tokens = [line.split() for line in found]
        if number == 0 and tokens:
            tokens[0] = []  # the header
        sizes = np.array([len(t) for t in tokens])
        if sizes.sum():
            ids = np.repeat(np.arange(number, number + len(tokens)), sizes)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield [ids, place.astype(np.int32), np.array([x for t in tokens for x in t], "S").astype(np.int64)]


class PartReader(_Reader):
    numbered = True

    def rows(self, number: int, found: list[bytes]) -> Iterator[list]:
        some = [(number + k + 1, int(line)) for k, line in enumerate(found) if line.strip()]
        yield [np.array([r[k] for r in some], np.int64) for k in (0, 1)]


class CountReader(_Reader):
    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        n = sum(len(found) for _, found in self.lines(partition))
        path, start, _ = partition.files[0]
        yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]]), pa.array([start], pa.int64()), pa.array([n], pa.int64())], ["file", "start", "lines"])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str
    numbers: int
    lines: list[tuple[int, int]]  # (start of a split, lines that begin in it)


class LineWriter(DataSourceArrowWriter):
    """Each task writes its lines to a folder of this write; only the job's end moves them to their names and adds the header."""

    def __init__(self, path: str, overwrite: bool, step: int) -> None:
        self.path, self.overwrite, self.step = path.rstrip("/"), overwrite, step
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        system, at = opened(self.path)
        self.existed = system.get_file_info(at).type != fs.FileType.NotFound
        if self.existed and not overwrite and listed(self.path):
            raise ValueError(f"{path} is not empty")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = opened(self.temporary)
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        path = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        numbers = at = 0
        lines: dict[int, int] = {}
        with system.open_output_stream(path) as out:
            for b in iterator:
                text = []
                for chunk, near, last in zip(*(b.column(c).to_pylist() for c in ("chunk", "neighbours", "last")), strict=True):
                    text.append((" " if chunk else "") + " ".join(map(str, near)) + ("\n" if last else ""))
                    if not chunk:
                        start = at - at % self.step
                        lines[start] = lines.get(start, 0) + 1
                    at += len(text[-1])
                    numbers += len(near)
                out.write("".join(text).encode())
        return Written(context.partitionId(), path, numbers, sorted(lines.items()))

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        if self.overwrite:
            for old, _ in listed(self.path):
                system.delete_file(old)
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        index = [("part-000000", 0, 1)]
        with system.open_output_stream(f"{folder}/part-000000") as out:
            out.write(f"{sum(n for m in done for _, n in m.lines)} {sum(m.numbers for m in done) // 2}\n".encode())
        for k, m in enumerate(done, 1):
            name = f"part-{k:06d}"
            system.move(m.path, f"{folder}/{name}")
            known, size = dict(m.lines), system.get_file_info(f"{folder}/{name}").size
            index += [(name, s, known.get(s, 0)) for s in range(0, size, self.step)]
        with system.open_output_stream(f"{folder}/{INDEX}") as out:
            out.write(json.dumps(index).encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()
        system, folder = opened(self.path)
        if not self.existed and system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)

    def _clear(self) -> None:
        system, folder = opened(self.temporary)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class _Source(DataSource):
    kind: type[_Reader]
    columns: str

    def schema(self) -> str:
        return "vertices long, edges long" if self.options.get("table") == "sizes" else self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.kind(self.options, schema)


class GtGraph(_Source):
    kind, columns = EdgeReader, "src long, dst long, weight long"

    @classmethod
    def name(cls) -> str:
        return "gtgraph"


class Metis(_Source):
    kind, columns = NeighbourReader, "id long, pos int, nbr long"

    @classmethod
    def name(cls) -> str:
        return "metis"

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"], overwrite, int(self.options.get("splitBytes", SPLIT_BYTES)))


class VertexParts(_Source):
    kind, columns = PartReader, "id long, part long"

    @classmethod
    def name(cls) -> str:
        return "vertex_parts"


class LineCounts(_Source):
    kind, columns = CountReader, "file string, start long, lines long"

    @classmethod
    def name(cls) -> str:
        return "line_counts"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and this package to its executors."""
    if not getattr(spark, "_graphloom_formats", False):
        ship(spark)
        for source in (GtGraph, Metis, VertexParts, LineCounts):
            spark.dataSource.register(source)
        spark._graphloom_formats = True


def line_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Counts the lines of each split in a Spark job, and writes the file that the option ``index`` takes; splitBytes must agree."""
    register(spark)
    rows = spark.read.format("line_counts").option("splitBytes", split_bytes).load(path).collect()  # a row for each split
    out = new_path(spark, "line-index")
    system, at = opened(out)
    with system.open_output_stream(at) as f:
        f.write(json.dumps([tuple(r) for r in rows]).encode())
    return out
