import glob
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from reference_model import random_graph, strong

from graphloom import cli
from graphloom.operators import graph as g
from graphloom.operators.graph import Graph
from graphloom.operators.merge import components_of
from graphloom.sources import datasource
from graphloom.sources import text_graphs as t


def edges(df):
    return [(r.src, r.dst) for r in df.collect()]


@pytest.fixture
def made(tmp_path):
    """A random graph with isolated vertices, loops and repeats, and its files."""
    r = random.Random(4)
    n, e = 30, random_graph(r, 24, 40)
    e += e[:3]
    body = "".join(f"a {a} {b} {r.randint(1, 9)}\n" for a, b in e)
    comments = "".join(f"c comment {i}\n" for i in range(7))
    (tmp_path / "g.gr").write_text(f"{comments}p sp {n} {len(e)}\n{body}")
    (tmp_path / "plain").write_text(f"{n} {len(e)}\n{body}")
    parts = [r.randint(0, 4) for _ in range(n)]
    (tmp_path / "parts").write_text("".join(f"{x}\n" for x in parts))
    out = [sorted(b for a, b in e if a == i) + sorted(a for a, b in e if b == i) for i in range(1, n + 1)]
    (tmp_path / "metis").write_bytes("\r\n".join([f"{n} {len(e)}", *(" ".join(map(str, x)) for x in out), ""]).encode())
    return tmp_path, n, e, parts, out


def test_gtgraph_and_plain(spark, made):
    path, n, e, _, _ = made
    for read, name in ((t.read_gtgraph, "g.gr"), (t.read_plain, "plain")):
        graph, weighted = read(spark, str(path / name))
        assert graph.vertices.count() == n and sorted(edges(graph.edges)) == sorted(e)
        assert weighted.columns == ["src", "dst", "weight"] and weighted.where("weight is null").count() == 0
    found = components_of(graph.vertices, graph.edges).collect()
    assert {r.id: r.component for r in found} == strong(n, e)


def test_partition_lines_keep_their_order(spark, made):
    path, n, e, parts, _ = made
    long = [random.Random(1).randint(0, 200) for _ in range(2000)]
    (path / "long").write_text("".join(f"{x}\n" for x in long))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("512b", before):  # many splits of one file
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            assert sorted((r.id, r.part) for r in t.read_partition(spark, str(path / "long")).collect()) == list(enumerate(long, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    graph, _ = t.read_gtgraph(spark, str(path / "g.gr"))
    assert sorted((r.id, r.part) for r in t.read_partition(spark, str(path / "parts"), graph).collect()) == list(enumerate(parts, 1))
    with pytest.raises(ValueError, match="parts"):
        t.read_partition(spark, str(path / "long"), graph)


def test_metis_equals_what_the_writer_makes(spark, made):
    path, n, e, _, out = made
    adjacency, v, m = t.read_metis(spark, str(path / "metis"))
    want = [(i, pos, x) for i, row in enumerate(out, 1) for pos, x in enumerate(row)]
    assert (v, m) == (n, len(e)) and sorted((r.id, r.pos, r.nbr) for r in adjacency.collect()) == want
    graph, _ = t.read_gtgraph(spark, str(path / "g.gr"))
    t.write_metis(graph, str(path / "out"))
    again, v, m = t.read_metis(spark, str(path / "out"))
    assert (v, m) == (n, len(e)) and sorted((r.id, r.pos, r.nbr) for r in again.collect()) == want
    lines = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/out/part-*"))).splitlines()
    assert lines[0] == f"{n} {len(e)}" and len(lines) == n + 1


def test_sources_read_in_splits_of_any_size(spark, made):
    path, n, e, parts, out = made
    datasource.register(spark)
    lists = [(i, pos, x) for i, row in enumerate(out, 1) for pos, x in enumerate(row)]
    for step in (1, 13, 1 << 20):
        read = lambda kind, name, **more: spark.read.format(kind).options(splitBytes=step, **more).load(str(path / name))  # noqa: B023, E731
        assert sorted((r.src, r.dst) for r in read("gtgraph", "g.gr").collect()) == sorted(e)
        index = datasource.line_index(spark, str(path / "metis"), step)
        assert sorted(map(tuple, read("metis", "metis", index=index).collect())) == lists
        index = datasource.line_index(spark, str(path / "parts"), step)
        assert sorted(map(tuple, read("vertex_parts", "parts", index=index).collect())) == list(enumerate(parts, 1))
        for kind, name in (("gtgraph", "g.gr"), ("gtgraph", "plain"), ("metis", "metis")):
            assert [tuple(r) for r in read(kind, name, table="sizes").collect()] == [(n, len(e))]
    assert sorted(map(tuple, spark.read.format("metis").load(str(path / "metis")).collect())) == lists  # no index: one task reads all
    (path / "short").write_text("a 1 2\n")
    with pytest.raises(Exception, match="needs two vertices"):
        spark.read.format("gtgraph").load(str(path / "short")).collect()


def test_a_hub_is_written_from_chunks(spark, tmp_path):
    hub = spark.range(20_000).selectExpr("3L as src", "id % 4999 + 1 as dst").union(spark.range(50).selectExpr("id + 1", "id + 2"))
    graph = Graph(spark.range(1, 5_003), hub)
    links = hub.selectExpr("src as id", "0 as way", "dst as nbr")
    rows = g.adjacency_chunks(graph.vertices, links, 1_000).select("id", "chunk", F.size("neighbours").alias("n"), "last").collect()
    of_hub = sorted((r.chunk, r.n, r.last) for r in rows if r.id == 3)
    assert max(r.n for r in rows) <= 1_000 and [x[0] for x in of_hub] == list(range(len(of_hub))) and sum(x[1] for x in of_hub) == 20_001
    assert [x[2] for x in of_hub] == [False] * (len(of_hub) - 1) + [True] and len({r.id for r in rows}) == 5_002
    t.write_metis(graph, str(tmp_path / "out"), 1_000)
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/out/part-*")))
    assert text == "".join(r.line + "\n" for r in t.metis_lines(graph).orderBy("id").collect())
    datasource.register(spark)
    again = spark.read.format("metis").load(str(tmp_path / "out"))  # by the writer's own index
    assert again.count() == 2 * hub.count() and spark.read.format("metis").options(splitBytes=777, index=datasource.line_index(spark, str(tmp_path / "out"), 777)).load(str(tmp_path / "out")).exceptAll(again).count() == 0
    with pytest.raises(Exception, match="not empty"):
        t.write_metis(graph, str(tmp_path / "out"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    datasource.register(spark)
    bad = spark.range(40).select("id", F.lit(0).alias("chunk"), F.when(F.col("id") < 33, F.array("id")).alias("neighbours"), F.lit(True).alias("last"))
    with pytest.raises(Exception, match="not iterable"):
        bad.write.format("metis").mode("append").save(str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_broken_files(spark, tmp_path):
    (tmp_path / "a").write_text("c x\np sp 2 2\na 1 2 1\n")
    with pytest.raises(ValueError, match="announced"):
        t.read_gtgraph(spark, str(tmp_path / "a"))
    (tmp_path / "b").write_text("c x\na 1 2 1\n")
    with pytest.raises(ValueError, match="sizes"):
        t.read_gtgraph(spark, str(tmp_path / "b"))
    (tmp_path / "c").write_text("c x\r\np sp 3 1\r\na 1 9 1\r\n")
    with pytest.raises(ValueError, match="vertex"):
        t.read_gtgraph(spark, str(tmp_path / "c"))
    (tmp_path / "d").write_text("")
    with pytest.raises(ValueError, match="empty"):
        t.read_metis(spark, str(tmp_path / "d"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        t.read_gtgraph(spark, str(tmp_path / "none"))
    (tmp_path / "e").write_text("p sp 3 0\n")
    graph, _ = t.read_gtgraph(spark, str(tmp_path / "e"))
    assert isinstance(graph, Graph) and graph.edges.count() == 0


def test_command_line(spark, made, capsys):
    path, n, e, _, _ = made
    for more in (["-a", "g", "-w", "4"], ["-a", "d", "--partition", str(path / "parts")]):
        assert cli.main([*more, "-p", "1", "-q", "1", "-f", str(path / "g.gr")]) == 0
        out = capsys.readouterr().out
        assert f"Number Of Sccs : {len(set(strong(n, e).values()))}\n" in out and "numberOf1Sccs: " in out and "Time : " in out
    assert cli.outcome("-a g -f x") == ("g", 1, 1, 1, "ok") and cli.outcome("-a z -f x")[-1] == "argument -a: invalid choice"
    with pytest.raises(SystemExit):
        cli.main(["-a", "d", "-f", "x"])
    with pytest.raises(SystemExit):
        cli.main(["-a", "g", "-f", "x", "-w", "5"])


def test_argument_lines_are_dealt_out_and_parsed_by_one_parser_a_task(spark, monkeypatch):
    lines = ["-a g -f x", "-a q -f x", "-a g -f x", "-a d -f x"] * 50
    made, first = [], cli.parser
    monkeypatch.setattr(cli, "parser", lambda *a: made.append(1) or first(*a))
    batches = (pa.RecordBatch.from_pydict({"line": lines[i : i + 40]}) for i in range(0, len(lines), 40))
    got = [r for b in cli._outcomes(batches) for r in b.to_pylist()]
    assert len(made) == 1 and [r["line"] for r in got] == lines
    assert [r["message"] for r in got[:4]] == ["ok", "argument -a: invalid choice", "ok", "-a d needs --partition"]
    monkeypatch.undo()
    one = spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)
    dealt = cli.outcomes(one)
    assert dealt.rdd.getNumPartitions() > 1 and sorted(map(str, dealt.collect())) == sorted(str(r) for r in spark.createDataFrame([tuple(g.values()) for g in got], dealt.schema).collect())
