"""Text formats of graphs.

* ``gtgraph``: comment lines (c ...), a size line (p sp V E), edges (a u v w); ids from 1
* ``plain``: a line V E, then edges as above
* ``metis``: a line V E, then for vertex i on line i its neighbours; blank lines count
* ``partition``: on line i the part of vertex i

Lines are read in splits; a line's number comes from its split's place in the file, so no file has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import CHUNK, Graph, adjacency_chunks
from graphloom.plans.scratch import cut
from graphloom.sources.datasource import register


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, line), from 0, over the files of ``path`` in the order of their names."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = cut(spark.read.text(path).select(F.col("value").alias("line"), *place, F.monotonically_increasing_id().alias("at")), "lines")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row for each split
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return lines.withColumn("own", own).join(F.broadcast(offsets), ["file", "block"]).select((F.col("offset") + F.col("own")).alias("number"), "line")


def _tokens(column: str) -> Column:
    return F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")


def _graph(spark: SparkSession, tokens: DataFrame, sizes: DataFrame, path: str) -> tuple[Graph, DataFrame]:
    found = sizes.take(2)
    if len(found) != 1:
        raise ValueError(f"{path}: one line with the sizes is needed")
    v, e = found[0]
    edges = tokens.where("t[0] = 'a'").select(*(F.col("t")[i].cast("long").alias(c) for i, c in ((1, "src"), (2, "dst"), (3, "weight"))))
    edges = cut(edges, "weighted-edges")
    n = edges.count()
    if n != e:
        raise ValueError(f"{path}: {e} edges announced, {n} found")
    return Graph(spark.range(1, v + 1), edges.select("src", "dst")).checked(), edges


def read_gtgraph(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The graph, and its edges with weights (src, dst, weight). Raises ValueError if sizes and edges do not agree."""
    tokens = spark.read.text(path).select(F.filter(_tokens("value"), lambda x: x != "").alias("t")).where("size(t) > 0")
    sizes = tokens.where("t[0] = 'p'").select(F.col("t")[2].cast("long"), F.col("t")[3].cast("long"))
    return _graph(spark, tokens, sizes, path)


def read_plain(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """Like ``read_gtgraph``, for files that begin with V E."""
    tokens = spark.read.text(path).select(_tokens("value").alias("t"))
    sizes = tokens.where(r"size(t) = 2 and t[0] rlike '^\\d+$'").select(F.col("t")[0].cast("long"), F.col("t")[1].cast("long"))
    return _graph(spark, tokens, sizes, path)


def read_partition(spark: SparkSession, path: str, graph: Graph | None = None) -> DataFrame:
    """(id, part); raises ValueError if it does not have a line for each of the graph's vertices."""
    lines = numbered_lines(spark, path)
    parts = cut(lines.where("trim(line) <> ''").select((F.col("number") + 1).alias("id"), F.trim("line").cast("long").alias("part")), "parts")
    if graph is not None:
        Graph(graph.vertices, graph.edges.limit(0), parts).checked()
    return parts


def read_metis(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """((id, pos, nbr), V, E): neighbours as listed, from position 0."""
    lines = cut(numbered_lines(spark, path), "metis")
    header = lines.where("number = 0").select(_tokens("line").alias("t")).first()
    if header is None:
        raise ValueError(f"{path}: empty")
    v, e = (int(x) for x in header.t[:2])
    found = lines.where(F.col("number").between(1, v)).select(F.col("number").alias("id"), F.posexplode(F.filter(_tokens("line"), lambda x: x != "")).alias("pos", "nbr"))
    return found.select("id", "pos", F.col("nbr").cast("long").alias("nbr")), v, e


def metis_lines(graph: Graph) -> DataFrame:
    """(id, line): out-neighbours, then in-neighbours, each sorted; the header is line 0."""
    ways = graph.edges.select(F.lit(0).alias("way"), "src", "dst").union(graph.edges.select(F.lit(1), "dst", "src"))
    lists = ways.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("way", "dst"))).alias("n"))
    lists = lists.select("id", F.array_join(F.transform("n", lambda x: x["dst"].cast("string")), " ").alias("line"))
    body = graph.vertices.join(lists, "id", "left").select("id", F.coalesce("line", F.lit("")).alias("line"))
    each = graph.vertices.select(F.lit(1).alias("v"), F.lit(0).alias("e")).union(graph.edges.select(F.lit(0), F.lit(1)))
    sizes = each.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"))
    return sizes.select(F.lit(0).cast("long").alias("id"), F.concat_ws(" ", "v", "e").alias("line")).union(body)


def write_metis(graph: Graph, path: str, chunk: int = CHUNK) -> None:
    """Text files whose names sort as their lines do, with an index of their lines; a line of any length is put together from chunks."""
    register(graph.edges.sparkSession)
    links = graph.edges.select(F.col("src").alias("id"), F.lit(0).alias("way"), F.col("dst").alias("nbr")).union(graph.edges.select("dst", F.lit(1), "src"))
    chunks = adjacency_chunks(graph.vertices, links, chunk)
    chunks.select("id", "chunk", "neighbours", "last").repartitionByRange("id").sortWithinPartitions("id", "chunk").write.format("metis").mode("append").save(path)


