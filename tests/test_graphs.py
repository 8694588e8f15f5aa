import random

import duckdb
import pytest
from reference_model import random_graph, reachable, strong

from graphloom.functions.tags import TAG_BITS, has_tag, packed_tag
from graphloom.operators import closure, fwbw, label, merge, reach, trim
from graphloom.operators import graph as g
from graphloom.operators.chains import chain_ends
from graphloom.operators.graph import Graph
from graphloom.operators.pivot import pivots
from graphloom.plans import pipelines, scratch
from graphloom.plans.queries import QUERIES, SQL
from graphloom.plans.rounds import Record


def cycle(*ids):
    return list(zip(ids, [*ids[1:], ids[0]]))


#: name: vertices, edges, parts, strong, weak, trimmed, pairs after trimming, least reachable, largest reachable
MICRO = {
    "dag": (4, [(1, 2), (2, 3), (1, 4)], None, 4, 1, 4, [], [1, 2, 3, 4], [4, 3, 3, 4]),
    "loop": (2, [(1, 1), (1, 2)], None, 2, 1, 1, [(1, 1)], [1, 2], [2, 2]),
    "double edge": (3, [(1, 2), (1, 2), (2, 1), (3, 1)], None, 2, 1, 1, [], [1, 1, 1], [2, 2, 3]),
    "one edge": (2, [(1, 2)], None, 2, 1, 2, [], [1, 2], [2, 2]),
    "no edges": (4, [], None, 4, 4, 4, [], [1, 2, 3, 4], [1, 2, 3, 4]),
    "two-cycle": (2, cycle(1, 2), None, 1, 1, 0, [(1, 2)], [1, 1], [2, 2]),
    "two cycles": (6, cycle(1, 2, 3) + cycle(4, 5, 6), [0] * 6, 2, 2, 0, [], [1] * 3 + [4] * 3, [3] * 3 + [6] * 3),
    "3 and 2": (5, cycle(1, 2, 3) + cycle(4, 5), None, 2, 2, 0, [(4, 5)], [1, 1, 1, 4, 4], [3, 3, 3, 5, 5]),
    "chain over parts": (9, cycle(1, 2, 3) + cycle(4, 5, 6) + cycle(7, 8, 9) + [(1, 4), (4, 7)], [0, 0, 0, 1, 1, 1, 0, 0, 0], 3, 1, 0, [], [1] * 3 + [4] * 3 + [7] * 3, [9] * 9),
    "no odd part": (3, cycle(1, 2, 3), [0, 2, 2], 1, 1, 0, [], [1] * 3, [3] * 3),
    "alternating": (6, cycle(1, 2, 3, 4, 5, 6), [0, 1, 0, 1, 0, 1], 1, 1, 0, [], [1] * 6, [6] * 6),
    "one-sided": (12, cycle(1, 2, 3) + cycle(4, 5, 6) + cycle(7, 8, 9) + cycle(10, 11, 12) + [(7, 1), (3, 4), (4, 10), (8, 11)], [0] * 6 + [1] * 6, 4, 1, 0, [], [1] * 3 + [4] * 3 + [1] * 3 + [10] * 3, [12] * 12),
    "doubled two-cycle": (4, cycle(1, 2) * 2 + cycle(3, 4) + [(2, 3)], None, 2, 1, 0, [(3, 4)], [1, 1, 3, 3], [4] * 4),
    "cycle into pair": (6, [*cycle(1, 2, 3, 4), (4, 5), *cycle(5, 6)], None, 2, 1, 0, [(5, 6)], [1] * 4 + [5] * 2, [6] * 6),
}


def made(spark, n, edges, parts=None):
    p = spark.createDataFrame([(i + 1, x) for i, x in enumerate(parts)], "id long, part long") if parts else None
    return Graph(spark.range(1, n + 1), spark.createDataFrame(edges, "src long, dst long"), p)


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_micro_graphs(spark):
    """All of them at once, side by side: the k-th has its ids moved by 100 k."""
    ids = [100 * k + v for k, m in enumerate(MICRO.values()) for v in range(1, m[0] + 1)]
    edges = [(100 * k + a, 100 * k + b) for k, m in enumerate(MICRO.values()) for a, b in m[1]]
    parts = [(100 * k + v, (m[2] or [0] * m[0])[v - 1]) for k, m in enumerate(MICRO.values()) for v in range(1, m[0] + 1)]
    graph = Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(parts, "id long, part long")).checked()

    def own(rows, k):
        return [tuple(x - 100 * k for x in r) for r in rows if r[0] // 100 == k]

    strongly = pairs(merge.components_of(graph.vertices, graph.edges), "id", "component")
    weakly = pairs(label.weakly_connected_components(graph.vertices, graph.edges), "id", "component")
    merged = pairs(merge.merged_components(graph)[0], "id", "component")
    rest, _ = trim.trim1(graph.edges)
    kept, twos = pairs(trim.trim1_survivors(rest), "id"), pairs(trim.trim2(rest), "a", "b")
    least = pairs(label.min_reachable_label(graph.vertices, graph.edges), "id", "label")
    largest = pairs(label.max_color(graph.vertices, graph.edges), "id", "label")
    for k, (name, (n, e, _, n_strong, n_weak, trimmed, twos_here, least_here, largest_here)) in enumerate(MICRO.items()):
        want = sorted(strong(n, e).items())
        assert len({c for _, c in want}) == n_strong, name
        assert own(strongly, k) == own(merged, k) == want, name
        assert len({c for _, c in own(weakly, k)}) == n_weak, name
        assert n - len(own(kept, k)) == trimmed, name
        assert own(twos, k) == twos_here, name
        assert [x for _, x in own(least, k)] == least_here, name
        assert [x for _, x in own(largest, k)] == largest_here, name


def everything():
    r = random.Random(11)
    return [(20, random_graph(r, 20, 34), [r.randint(0, 6) for _ in range(20)]), (12, MICRO["one-sided"][1] + [(10, 3), (5, 5)], MICRO["one-sided"][2])]


@pytest.mark.parametrize("algorithm", ["g", "h", "d"])
@pytest.mark.parametrize("trims", [(True, True), (False, False)])
def test_pipelines_agree_with_the_model(spark, algorithm, trims):
    n, edges, parts = everything()[trims[0]]
    result = pipelines.strong_components(made(spark, n, edges, parts), algorithm, *trims)
    assert pairs(result.components, "id", "component") == sorted(strong(n, edges).items())
    s = result.summary().first()
    assert s.n_scc == s.n_trim1 + s.n_trim2 + s.n_pivot
    assert trims[0] or s.n_trim1 == s.n_trim2 == 0
    assert all(p["rounds"] >= 1 and p["seconds"] >= 0 for p in result.phases)


def test_counts_by_phase_of_a_small_graph(spark):
    """A tail trimmed first, a pivot of degree product 4, a pair, and a vertex that only trimming after the pair finds."""
    edges = [(9, 1), (1, 2), (2, 3), (3, 1), (1, 3), (3, 2), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7), (7, 8), (8, 10), (10, 7)]
    result = pipelines.strong_components(made(spark, 10, edges), "x", warp_size=32)
    s = result.summary().first()
    assert (s.n_scc, s.n_trim1, s.n_trim2, s.n_pivot) == (5, 2, 1, 2)
    rounds = result.rounds().collect()
    assert {r.step for r in rounds} <= set(range(1, 8)) and [r.changed for r in rounds if r.step == 1] == [1, 0]


def peeled(edges, within, without):
    left = set(edges)
    while True:
        into, out = {b for _, b in left}, {a for a, _ in left}
        rest = {(a, b) for a, b in left if (not within or a in into) and (not without or b in out)}
        if rest == left:
            return left
        left = rest


@pytest.mark.parametrize(("within", "without", "chains"), [(True, True, True), (False, True, False)])
def test_peeling_against_the_model(spark, within, without, chains):
    """Random edges, loops, doubled edges, tails into and out of cycles, a ladder whose rounds are many and thin."""
    r = random.Random(8)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(52)] + cycle(100, 101) * 2 + cycle(110, 111, 112) + [(120, 120), (120, 121), (121, 122), (130, 131), (131, 100), (112, 140), (140, 141)]
    edges += [(200 + i, 200 + i + k) for i in range(5) for k in (1, 2)] + [(1000 + i, 1001 + i) for i in range(400)]
    used = edges if chains else edges[:-396]
    kept, rounds = trim.peel(spark.createDataFrame(used, "src long, dst long"), within, without, chains=chains)
    assert pairs(kept, "src", "dst") == sorted(e for e in used if e in peeled(used, within, without))
    assert rounds < 30


def test_rounds_of_a_long_path_grow_with_its_logarithm(spark):
    n = 5_000
    path = spark.range(1, n).selectExpr("id as src", "id + 1 as dst")
    kept, rounds = trim.trim1(path)
    assert kept.count() == 0 and rounds <= trim.PATIENCE
    ends, rounds = chain_ends(path.selectExpr("dst as id", "src as up"))
    assert rounds <= 13 and {r.up for r in ends.select("up").distinct().collect()} == {1} and ends.count() == n - 1
    some = spark.createDataFrame([(5, 6), (6, 5), (7, 5), (8, 7)], "id long, up long")  # a circle, and what hangs on it
    assert chain_ends(some)[0].count() == 0
    tail = path.union(spark.createDataFrame([(n, 9_001), (9_001, 9_002), (9_002, 9_001), (8_000, 8_001), (8_001, 8_000), (300, 700)], "src long, dst long"))
    found, rounds = reach.reachable(spark.createDataFrame([(40,)], "id long"), tail, [])
    assert rounds <= 60 and {r.id for r in found.collect()} == {*range(40, n + 1), 9_001, 9_002}


def test_a_level_exchanges_only_what_it_reaches(spark):
    r = random.Random(3)
    edges = spark.createDataFrame([(r.randrange(90), r.randrange(90)) for _ in range(120)], "src long, dst long")
    seen = []
    old = reach.bucketed
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        reach.bucketed = lambda df, label, *a, **k: (seen.append(df._jdf.queryExecution().executedPlan().toString()) if k.get("name") else None, old(df, label, *a, **k))[1]
        reach.search(spark.createDataFrame([(1,)], "id long"), edges, [])
    finally:
        reach.bucketed = old
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert seen and all(p.count("Exchange") <= 1 for p in seen)  # one bucket needs none


def test_contraction_halves_edges(spark):
    r = random.Random(6)
    edges = [(r.randrange(3_000), r.randrange(3_000)) for _ in range(2_500)] + [(5_000 + i, 5_001 + i) for i in range(500)]
    record = Record()
    found, rounds = label.contracted(spark.range(6_000), spark.createDataFrame(edges, "src long, dst long"), record)
    least = list(range(6_000))

    def root(x):
        while least[x] != x:
            least[x] = least[least[x]]
            x = least[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        least[y] = x
    assert {x.id: x.component for x in found.collect()} == {v: root(v) for v in range(6_000)}
    left = [x[4] for x in record.rows]
    assert rounds <= 14 and left[3] <= len(edges) / 8


def test_closure_of_a_part_with_a_large_component(spark):
    edges = cycle(*range(100, 300)) + [(1, 100), (100, 2), (2, 3), (-5, 1), (3, -70)]
    nodes, quotient = spark.createDataFrame([(i,) for i in (-70, -5, 1, 2, 3, 100)], "id long"), spark.createDataFrame([(1, 100), (100, 2), (2, 3), (-5, 1), (3, -70)], "src long, dst long")
    assert closure.closure(nodes, quotient).count() <= 15  # rows of the condensation, not of 203 times 200 pairs
    got = closure.reach_pairs(spark.createDataFrame([(-5,), (150,), (3,), (77,)], "id long"), spark.createDataFrame(edges, "src long, dst long"))
    after = [2, 3, -70]
    want = [(-5, x) for x in (-5, 1, *range(100, 300), *after)] + [(150, x) for x in (*range(100, 300), *after)] + [(3, 3), (3, -70), (77, 77)]
    assert pairs(got, "s", "d") == sorted(want)


def test_scratch_must_be_shared_off_one_machine(spark, monkeypatch):
    from graphloom.plans import scratch

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        scratch.scratch_dir(Elsewhere())


def test_empty_graph_and_options(spark):
    empty = Graph(spark.range(0), spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "id long, part long"))
    for a in "gd":
        assert pipelines.strong_components(empty, a).summary().first().n_scc == 0
    with pytest.raises(ValueError, match="warp"):
        pipelines.strong_components(empty, "x", warp_size=3)
    with pytest.raises(ValueError, match="algorithm"):
        pipelines.strong_components(empty, "z")
    with pytest.raises(ValueError, match="parts"):
        pipelines.partitioned(Graph(empty.vertices, empty.edges))


def test_searches(spark):
    r = random.Random(3)
    n, edges = 15, random_graph(r, 15, 22)
    graph = made(spark, n, edges)
    seeds = spark.createDataFrame([(1,), (2,)], "id long")
    fwd = {x for s in (1, 2) for x in reachable(n, edges, s)}
    bwd = {x for s in (1, 2) for x in reachable(n, [(b, a) for a, b in edges], s)}
    assert {x.id for x in reach.reach(seeds, graph.edges)[0].collect()} == fwd
    assert {x.id for x in reach.reach(seeds, graph.edges, backward=True)[0].collect()} == bwd
    both = reach.reach_both(seeds, graph.edges)[0].collect()
    assert {x.id for x in both if x.fwd} == fwd and {x.id for x in both if x.bwd} == bwd
    assert pairs(closure.reach_pairs(graph.vertices, graph.edges), "s", "d") == sorted((s, d) for s in range(1, n + 1) for d in reachable(n, edges, s))
    levels = {x.id: x.level for x in reach.reach(seeds.where("id = 1"), spark.createDataFrame([(1, 3), (3, 4), (1, 4)], "src long, dst long"))[0].collect()}
    assert levels == {1: 0, 3: 1, 4: 1}


def test_invariances(spark):
    r = random.Random(9)
    n, edges = 14, random_graph(r, 14, 20)
    graph = made(spark, n, edges)
    want = pairs(merge.components_of(graph.vertices, graph.edges), "id", "component")
    assert pairs(merge.components_of(graph.vertices, g.transpose(graph.edges)), "id", "component") == want
    components = spark.createDataFrame(want, "id long, component long")
    quotient = pairs(pipelines.condensation_edges(components, graph.edges), "src", "dst")
    names = {c: i + 1 for i, c in enumerate(sorted({c for _, c in want}))}
    assert len(set(strong(len(names), [(names[a], names[b]) for a, b in quotient]).values())) == len(names)  # no cycles
    assert sum(x * y for x, y in pairs(pipelines.component_histogram(components), "size", "n")) == n


def test_pivots_degrees_tags_and_checks(spark):
    graph = made(spark, 4, [(1, 2), (2, 1), (2, 3), (3, 2), (3, 3)])
    d = g.degrees(graph)
    assert pairs(d, "id", "out_degree", "in_degree", "score") == [(1, 1, 1, 1), (2, 2, 2, 4), (3, 2, 2, 4), (4, 0, 0, 0)]
    assert pairs(pivots(graph.vertices, d), "pivot", "score") == [(2, 4)]
    odd = graph.vertices.selectExpr("id", "id % 2 as color")
    assert pairs(pivots(odd, d, "color"), "color", "pivot") == [(0, 2), (1, 3)]
    assert pairs(pivots(graph.vertices.where("id = 4"), d), "pivot", "score") == [(4, 0)]
    from pyspark.sql import functions as F

    tag = graph.vertices.select(packed_tag(fwd=F.col("id") > 1, pivot=F.col("id") == 3).alias("t"))
    assert [r.t for r in tag.collect()] == [0, 1, 129, 1]
    assert tag.where(has_tag(F.col("t"), "pivot")).count() == 1 and sum(TAG_BITS.values()) == 255
    with pytest.raises(ValueError, match="vertex"):
        made(spark, 1, [(1, 2)]).checked()
    with pytest.raises(ValueError, match="parts"):
        made(spark, 3, [(1, 2)], [0, 1]).checked()
    with pytest.raises(ValueError, match="unknown"):
        packed_tag(blue=F.lit(True))


def test_shifted_colors_are_apart(spark):
    state = spark.createDataFrame([(1, 0, 5), (2, 1, 0), (3, 1, 5), (4, 3, 2)], "id long, part long, color long")
    assert pairs(merge.shift_colors(state), "id", "color") == [(1, 5), (2, 6), (3, 11), (4, 3)]


def joins_of(monkeypatch, module, work):
    """The joins of the plans that ``module`` writes with ``cut_observed``, as they are before any has run."""
    found, write = [], module.cut_observed
    monkeypatch.setattr(module, "cut_observed", lambda df, *a, **b: found.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a, **b))
    work()
    return " ".join(found)


def test_a_level_is_one_job_and_sorts_only_what_does_not_fit(spark, monkeypatch):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (6, 1)], "src long, dst long")
    plans, write = [], reach.bucketed
    monkeypatch.setattr(reach, "bucketed", lambda df, *a, **b: b.get("name") and plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a, **b))
    for hashed, join in ((reach.HASHED, "ShuffledHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(reach, "HASHED", hashed)
        plans.clear()
        found, rounds = reach.search(spark.createDataFrame([(1,)], "id long"), edges, [])
        assert pairs(found, "id", "level") == [(1, 0), (2, 1), (3, 2), (4, 3)] and rounds == len(plans) == 4
        for p in plans:
            assert p.count(f"{join} ") == 2 and p.count("Exchange") == 1 and "AdaptiveSparkPlan" not in p and "BroadcastHashJoin" not in p
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_a_split_finds_its_edges_once(spark, monkeypatch):
    found, find = [], fwbw.alike
    monkeypatch.setattr(fwbw, "alike", lambda *a: found.append(a) or find(*a))
    graph = made(spark, 7, cycle(1, 2, 3) + cycle(4, 5) + [(3, 4), (5, 6)])
    state = graph.vertices.selectExpr("id", "0L as color")
    done, rounds = fwbw.fw_bw(state, graph.edges, g.degrees(graph), "color")
    assert len(found) == len(rounds) > 1
    assert pairs(fwbw.canonical(done), "id", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]


def test_rounds_of_labels_broadcast_only_what_is_known_to_be_small(spark, monkeypatch):
    monkeypatch.setattr(scratch, "FEW", 0)
    graph = made(spark, 6, cycle(1, 2, 3, 4) + [(5, 1), (4, 6)])
    for largest, want in ((False, [1, 1, 1, 1, 1, 6]), (True, [6, 6, 6, 6, 6, 6])):
        out = []
        plans = joins_of(monkeypatch, label, lambda: out.append(label.extreme_reachable(graph.vertices, graph.edges, largest)[0]))
        assert "SortMergeJoin" in plans and "BroadcastHashJoin" not in plans
        assert [x for _, x in pairs(out[0], "id", "label")] == want


def test_rounds_of_trimming_broadcast_only_what_is_known_to_be_small(spark, monkeypatch):
    monkeypatch.setattr(scratch, "FEW", 0)
    monkeypatch.setattr(trim, "PATIENCE", 1)
    monkeypatch.setattr(trim, "THIN", 1)
    graph = made(spark, 9, cycle(1, 2, 3) + [(i, i + 1) for i in range(3, 9)])
    out = []
    plans = joins_of(monkeypatch, trim, lambda: out.append(trim.trim1(graph.edges)[0]))
    assert "SortMergeJoin" in plans and "BroadcastHashJoin" not in plans
    assert pairs(out[0], "src", "dst") == sorted(cycle(1, 2, 3))


def test_rounds_of_labels_where_edges_end_at_no_vertex(spark, tmp_path):
    """6 -> 5 -> 4 -> 2, and no customer makes the vertex 2."""
    spark.createDataFrame([(c - 1,) for c in (1, 3, 4, 5, 6)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, src - 1, "1-URGENT", "F") for k, src in ((4, 4), (2, 5), (1, 6))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for table in ("customer", "orders"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(SQL["label_rounds"]).fetchall()
    assert sorted(want) == [(1, 3), (2, 2), (3, 0)]
    assert pairs(QUERIES["label_rounds"](spark, str(tmp_path)), "round", "changed") == sorted(want)


@pytest.mark.parametrize("run", [pipelines.hong, pipelines.slota, pipelines.partitioned])
def test_pipelines_broadcast_only_what_is_measured(spark, monkeypatch, run):
    """Tables of a few rows and so few bytes: none is broadcast for its files' size, and the session is left as it was."""
    keys = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(k, None) for k in keys]
    monkeypatch.setattr(scratch, "FEW", 0)
    monkeypatch.setattr(scratch, "SMALL", 0)
    graph = made(spark, 7, cycle(1, 2, 3) + cycle(4, 5) + [(3, 4), (5, 6)], [0, 1, 0, 1, 1, 0, 0])
    plans, write = [], pipelines.cut
    monkeypatch.setattr(pipelines, "cut", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    components = run(graph).components
    assert "SortMergeJoin" in " ".join(plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert pairs(components, "id", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]
    assert [spark.conf.get(k, None) for k in keys] == before
