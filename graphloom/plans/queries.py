"""The queries over graphs, and the SQL each must agree with.

View a is random, with one large component; view b has many small ones. Every query covers its whole graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.cli import outcomes, report
from graphloom.functions.tags import packed_tag
from graphloom.operators import closure as pairs
from graphloom.operators import fwbw, label, merge, pivot, reach, trim
from graphloom.operators import graph as g
from graphloom.operators.graph import Graph
from graphloom.plans import pipelines
from graphloom.plans.rounds import Record
from graphloom.plans.scratch import cut, new_path
from graphloom.sources import datasource, text_graphs
from graphloom.sources.views import block_colors, view

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EDGES = {
    "a": "select (o_custkey + 1)::bigint as src, ((o_orderkey * 7919) % (select count(*) from customer) + 1)::bigint as dst from orders where o_orderpriority = '1-URGENT' and o_orderstatus <> 'P'",
    "b": "select (o_custkey + 1)::bigint as src, ((o_custkey // 10) * 10 + (o_orderkey * 7919) % 10 + 1)::bigint as dst from orders where o_orderpriority = '1-URGENT' and o_orderstatus <> 'P'",
}
#: Common tables: m all edges, v vertices, p parts, b colors by block, dg degrees.
BASE = """v as (select (c_custkey + 1)::bigint as id from customer),
p as (select id, ((id - 1) % 10)::bigint as part from v),
b as (select id, ((id - 1) // 10)::bigint as color from v),
dg as (select id, coalesce(o, 0)::bigint as out_degree, coalesce(i, 0)::bigint as in_degree, (coalesce(o, 0) * coalesce(i, 0))::bigint as score
    from v left join (select src as id, count(*) as o from m group by 1) using (id) left join (select dst as id, count(*) as i from m group by 1) using (id))"""


def closure(edges: str, name: str = "r", reflexive: bool = True) -> str:
    """A closure (s, d) of the table ``edges``."""
    seed = "select id, id from v" if reflexive else f"select distinct src, dst from {edges}"
    return f"{name}(s, d) as ({seed} union select {name}.s, e.dst from {name} join (select distinct src, dst from {edges}) e on e.src = {name}.d)"


def core(edges: str, name: str = "core", cyc: str = "cyc") -> str:
    """The vertices of ``edges`` between cycles."""
    return f"""{closure(edges, f"{name}_r", reflexive=False)},
{cyc} as (select s as id from {name}_r where s = d),
{name} as (select id from v where (id in (select id from {cyc}) or id in (select d from {name}_r where s in (select id from {cyc})))
    and (id in (select id from {cyc}) or id in (select s from {name}_r where d in (select id from {cyc}))))"""


SCC = "select x.s as id, min(x.d) as component from r x join r y on x.s = y.d and x.d = y.s group by x.s"
INSIDE = "inner_e as (select m.* from m join p x on x.id = m.src join p y on y.id = m.dst where x.part = y.part)"
BUDDY = "(case when y.part % 2 = 1 then y.part - 1 else y.part + 1 end)"
NEAR = f"near_e as (select m.* from m join p x on x.id = m.src join p y on y.id = m.dst where x.part = y.part or x.part = {BUDDY})"
TRANS = f"trans as (select m.src as u1, m.dst as u2 from m join p x on x.id = m.src join p y on y.id = m.dst where x.part = {BUDDY})"


def query(which: str, sql: str, *tables: str) -> Callable[[Callable[[Graph], DataFrame]], Callable[[Graph], DataFrame]]:
    """Registers a function of a view's graph under its name, with the SQL for its rows over common tables."""

    def register(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(view(spark, sf_dir, which))
        SQL[f.__name__] = f"with recursive {', '.join([f'm as ({EDGES[which]})', BASE, *tables])} {sql}"
        return f

    return register


# Edges and degrees.


@query("a", "select src, dst from m")
def edge_scan(graph):
    return g.sorted_edges(graph.edges)


@query("a", "select dst as src, src as dst from m")
def transpose(graph):
    return g.transpose(graph.edges)


@query("a", "select src, dst from m union all select dst, src from m")
def symmetrize(graph):
    return g.symmetrize(graph.edges)


@query("b", "select id, coalesce(string_agg(dst::varchar, ',' order by dst), '') as neighbours from v left join m on src = id group by id")
def adjacency_list(graph):
    return g.adjacency(graph).select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(
    "b",
    """select id, coalesce(string_agg(n::varchar, ' ' order by way, n), '') as line from v left join
    (select src as k, 0 as way, dst as n from m union all select dst, 1, src from m) on k = id group by id
    union all select 0, (select count(*) from v)::varchar || ' ' || (select count(*) from m)::varchar""",
)
def metis(graph):
    return text_graphs.metis_lines(graph)


@query("a", "select id, out_degree, in_degree from dg")
def degrees(graph):
    return g.degrees(graph).select("id", F.col("out_degree").cast("long").alias("out_degree"), F.col("in_degree").cast("long").alias("in_degree"))


@query("a", "select id, score from dg")
def degree_product(graph):
    return g.degrees(graph).select("id", F.col("score").cast("long").alias("score"))


@query(
    "b",
    """select id, chunk, string_agg(dst::varchar, ',' order by place) as neighbours, chunk = max(chunk) over (partition by id) as last from
        (select src as id, dst, place, (dense_rank() over (partition by src order by place // 3) - 1)::int as chunk from (select *, row_number() over (order by src, dst) - 1 as place from m)) group by id, chunk
    union all select id, 0, '', true from v where id not in (select src from m)""",
)
def adjacency_chunks(graph):
    """The neighbours of a vertex in rows of three at most."""
    links = graph.edges.select(F.col("src").alias("id"), F.lit(0).alias("way"), F.col("dst").alias("nbr"))
    return g.adjacency_chunks(graph.vertices, links, 3).select("id", "chunk", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"), "last")


# Trimming.


@query("a", "select id from v where id in (select src from m) and id in (select dst from m)")
def trim1_once(graph):
    return trim.trim1_survivors(graph.edges)


@query("a", "select id from core", core("m"))
def trim1_fixpoint(graph):
    return trim.trim1_survivors(trim.trim1(graph.edges)[0])


@query(
    "b",
    """select distinct least(x.id, x.k) as a, greatest(x.id, x.k) as b from i x join i y on x.k = y.id and y.k = x.id where x.n = 1 and y.n = 1
    union select distinct least(x.id, x.k), greatest(x.id, x.k) from o x join o y on x.k = y.id and y.k = x.id where x.n = 1 and y.n = 1""",
    core("m"),
    "am as (select * from m where src in (select id from core) and dst in (select id from core))",
    "i as (select dst as id, count(*) as n, min(src) as k from am group by 1)",
    "o as (select src as id, count(*) as n, min(dst) as k from am group by 1)",
)
def trim2_pairs(graph):
    return trim.trim2(trim.trim1(graph.edges)[0])


@query(
    "a",
    """select id, (case when id in (select src from m) and id in (select dst from m) then 0 else 48 end + case when id = (select id from dg order by score desc, id limit 1) then 131 else 0 end)::bigint as tag from v""",
)
def vertex_tags(graph):
    """Bits of a first pass: trimmed vertices are finished, the first pivot is found both ways."""
    first = pivot.pivots(graph.vertices, g.degrees(graph)).select(F.col("pivot").alias("id"), F.lit(True).alias("pivot"))
    kept = trim.trim1_survivors(graph.edges).withColumn("kept", F.lit(True))
    s = graph.vertices.join(kept, "id", "left").join(first, "id", "left")
    gone = F.col("kept").isNull()
    return s.select("id", packed_tag(trim1=gone, finished=gone, pivot=F.col("pivot"), fwd=F.col("pivot"), bwd=F.col("pivot")).alias("tag"))


# Pivots.


@query("a", "select id as pivot, score from dg where id in (select id from core) order by score desc, id limit 1", core("m"))
def first_pivot(graph):
    left = trim.trim1_survivors(trim.trim1(graph.edges)[0])
    return pivot.pivots(left, g.degrees(graph)).select("pivot", F.col("score").cast("long").alias("score"))


@query("b", "select color, id as pivot, score from dg join b using (id) qualify row_number() over (partition by color order by score desc, id) = 1")
def pivot_per_color(graph):
    return pivot.pivots(block_colors(graph.vertices), g.degrees(graph), "color").select("color", "pivot", F.col("score").cast("long").alias("score"))


@query(
    "a",
    """select part, color, id as pivot, score from dg join p using (id) join (select id, ((id - 1) // 100)::bigint as color from v) using (id)
    qualify row_number() over (partition by part, color order by score desc, id) = 1""",
)
def pivot_per_part_color(graph):
    state = block_colors(graph.vertices, 100).join(graph.parts, "id")
    return pivot.pivots(state, g.degrees(graph), "part", "color").select("part", "color", "pivot", F.col("score").cast("long").alias("score"))


# Reachability.

BLOCK_PIVOTS = "bp as (select color, id as pv from dg join b using (id) qualify row_number() over (partition by color order by score desc, id) = 1)"
PART_PIVOTS = "pp as (select part, id as pv from dg join p using (id) qualify row_number() over (partition by part order by score desc, id) = 1)"
FIRST = "f1 as (select id from dg order by score desc, id limit 1)"


def _block_pivots(graph):
    return pivot.pivots(block_colors(graph.vertices), g.degrees(graph), "color")


def _part_pivots(graph):
    return pivot.pivots(graph.parts, g.degrees(graph), "part").select(F.col("pivot").alias("id"))


@query("b", "select distinct dst as id from m where src in (select pv from bp)", BLOCK_PIVOTS)
def fwd_level(graph):
    return reach.level(_block_pivots(graph).select(F.col("pivot").alias("id")), graph.edges)


@query("b", "select distinct src as id from m where dst in (select pv from bp)", BLOCK_PIVOTS)
def bwd_level(graph):
    return reach.level(_block_pivots(graph).select(F.col("pivot").alias("id")), g.transpose(graph.edges))


@query("b", "select distinct d as id from r where s in (select pv from bp)", BLOCK_PIVOTS, closure("m"))
def fwd_reach(graph):
    return reach.reach_all(_block_pivots(graph).select(F.col("pivot").alias("id")), graph.edges)


@query("b", "select distinct s as id from r where d in (select pv from bp)", BLOCK_PIVOTS, closure("m"))
def bwd_reach(graph):
    return reach.reach_all(_block_pivots(graph).select(F.col("pivot").alias("id")), graph.edges, backward=True)


@query("a", "select x.d as id from r x join r y on x.s = y.d and x.d = y.s where x.s = (select id from f1)", FIRST, closure("m"))
def fw_bw_scc(graph):
    first = pivot.pivots(graph.vertices, g.degrees(graph)).select(F.col("pivot").alias("id"))
    return reach.reach_both(first, graph.edges)[0].where("fwd and bwd").select("id")


@query(
    "b",
    """select id, (3 * pv + f::int + 2 * w::int)::bigint as color, f and w as finished, case when f and w then pv end as component
    from (select b.id, bp.pv, exists (select 1 from r where s = bp.pv and d = b.id) as f, exists (select 1 from r where s = b.id and d = bp.pv) as w
        from b join bp using (color))""",
    BLOCK_PIVOTS,
    closure("m"),
)
def color_update(graph):
    """One split of blocks of ten; on view b no edge leaves a block."""
    return fwbw.split(block_colors(graph.vertices), graph.edges, g.degrees(graph), "color")[0].select("id", "color", "finished", "component")


@query("a", "select distinct d as id from r where s in (select pv from pp)", INSIDE, PART_PIVOTS, closure("inner_e"))
def fwd_reach_local(graph):
    return reach.reach_all(_part_pivots(graph), g.inside_parts(graph))


@query("a", "select distinct s as id from r where d in (select pv from pp)", INSIDE, PART_PIVOTS, closure("inner_e"))
def bwd_reach_local(graph):
    return reach.reach_all(_part_pivots(graph), g.inside_parts(graph), backward=True)


@query("a", "select s, d from r", INSIDE, closure("inner_e"))
def reach_pairs_local(graph):
    return pairs.reach_pairs(graph.vertices, cut(g.inside_parts(graph)))


@query("b", "select s, d from r intersect select d, s from r", closure("m"))
def reach_intersection(graph):
    return pairs.reach_intersection(cut(pairs.reach_pairs(graph.vertices, graph.edges)))


# Labels and colors.


@query("a", "select id, id as label from v")
def assign_unique(graph):
    return label.unique_labels(graph.vertices)


@query("a", "select id, part as label from p")
def assign_partition(graph):
    return label.partition_labels(graph.parts)


ONCE = "once as (select id, least(id, coalesce(min(dst), id)) as label from v left join m on src = id group by id)"


@query("a", "select id, label from once", ONCE)
def propagate_min_once(graph):
    return label.propagate(label.unique_labels(graph.vertices), graph.edges)


@query("a", "select x.id, y.label from once x join once y on y.id = x.label", ONCE)
def pointer_jump_once(graph):
    return label.jump(label.propagate(label.unique_labels(graph.vertices), graph.edges))


@query("a", "select s as id, min(d) as label from r group by s", closure("m"))
def min_reachable_label(graph):
    return label.min_reachable_label(graph.vertices, graph.edges)


@query("a", "select s as id, max(d) as label from r group by s", closure("m"))
def max_color(graph):
    return label.max_color(graph.vertices, graph.edges)


@query("a", "select s as id from r group by s having max(d) = s", closure("m"))
def color_roots(graph):
    return label.color_roots(label.max_color(graph.vertices, graph.edges))


COLORS = "c as (select s as id, max(d) as color from r group by s)"


@query("a", "select r.d as id, r.s as component from r join c x on x.id = r.s and x.color = r.s join c y on y.id = r.d and y.color = r.s", closure("m"), COLORS)
def color_scc(graph):
    return label.color_components(cut(label.max_color(graph.vertices, graph.edges)), graph.edges)


@query("b", "select s as id, min(d) as component from r group by s", "u as (select src, dst from m union all select dst, src from m)", closure("u"))
def wcc(graph):
    return label.weakly_connected_components(graph.vertices, graph.edges)


# Parts.


@query("a", "select src, dst, x.part as src_part, y.part as dst_part from m join p x on x.id = src join p y on y.id = dst where x.part <> y.part")
def partition_cut_edges(graph):
    return g.cut_edges(graph)


@query("b", "select u1, u2 from trans", TRANS)
def trans_edges(graph):
    return merge.trans_edges(graph)


def _near_core(both: bool) -> str:
    reached = "(id in (select id from ncyc) or id in (select d from ncore_r where s in (select id from ncyc)))"
    reaches = "(id in (select id from ncyc) or id in (select s from ncore_r where d in (select id from ncyc)))"
    return f"peeled as (select id from v where {reached}{f' and {reaches}' if both else ''})"


@query("b", "select id from peeled", NEAR, core("near_e", "ncore", "ncyc"), _near_core(False))
def peel_in(graph):
    return merge.peeled_in(graph)


@query("b", "select id from peeled", NEAR, core("near_e", "ncore", "ncyc"), _near_core(True))
def peel_both(graph):
    return merge.peeled_both(graph)


@query("b", "select u1, u2 from trans where u1 in (select id from peeled) and u2 in (select id from peeled)", NEAR, TRANS, core("near_e", "ncore", "ncyc"), _near_core(True))
def trans_edges_peeled(graph):
    return merge.trans_edges(graph, cut(merge.peeled_both(graph)))


def _part_colors(graph):
    return graph.parts.join(block_colors(graph.vertices), "id")


@query("a", "select part, max(color) as max_color from p join b using (id) where part % 2 = 0 group by part")
def partition_max_color(graph):
    return merge.partition_max_color(_part_colors(graph))


@query(
    "a",
    """select id, part, color + case when part % 2 = 1 then coalesce(mx, 0) + 1 else 0 end as color from p join b using (id)
    left join (select part + 1 as part, max(color) as mx from p join b using (id) where part % 2 = 0 group by 1) using (part)""",
)
def shift_color(graph):
    return merge.shift_colors(_part_colors(graph))


@query("a", "select id, part // 2 as part from p")
def update_partition(graph):
    return merge.next_parts(graph.parts)


@query("a", SCC, INSIDE, closure("inner_e"))
def local_scc(graph):
    return merge.local_components(graph)


@query("a", SCC, closure("m"))
def merge_scc(graph):
    return merge.merged_components(graph)[0]


LEVELS = [f"e{k} as (select m.* from m join p x on x.id = m.src join p y on y.id = m.dst where x.part >> {k} = y.part >> {k})" for k in range(5)]
LEVEL_SIZES = " union all ".join(f"select {k}::bigint as level, count(distinct component)::bigint as n from (select x.s as id, min(x.d) as component from r{k} x join r{k} y on x.s = y.d and x.d = y.s group by x.s)" for k in range(5))


@query("b", LEVEL_SIZES, *LEVELS, *(closure(f"e{k}", f"r{k}") for k in range(5)))
def merge_levels(graph):
    """How many components there are after each level."""
    sizes = merge.merged_components(graph)[1]
    return graph.vertices.sparkSession.createDataFrame(list(enumerate(sizes)), "level long, n long")


# Pipelines.


@query("a", SCC, closure("m"))
def scc_hong(graph):
    return pipelines.hong(graph).components.select("id", "component")


@query("a", SCC, closure("m"))
def scc_slota(graph):
    return pipelines.slota(graph).components.select("id", "component")


@query("a", SCC, closure("m"))
def scc_partitioned(graph):
    return pipelines.partitioned(graph).components.select("id", "component")


@query("a", SCC, closure("m"))
def scc_small_rest(graph):
    """As scc_hong, by the pipeline's other name; a rest stays distributed however small."""
    return pipelines.strong_components(graph, "x").components.select("id", "component")


@query("b", f"select count(distinct component)::bigint as n_scc, count(distinct component)::bigint as n_by_kind from ({SCC})", closure("m"))
def scc_summary(graph):
    return pipelines.hong(graph).summary().selectExpr("n_scc", "n_trim1 + n_trim2 + n_pivot as n_by_kind")


@query("a", f"select size, count(*)::bigint as n from (select component, count(*)::bigint as size from ({SCC}) group by 1) group by 1", closure("m"))
def component_histogram(graph):
    return pipelines.component_histogram(merge.components_of(graph.vertices, graph.edges))


@query("b", "select distinct x.component as src, y.component as dst from m join c x on x.id = m.src join c y on y.id = m.dst where x.component <> y.component", closure("m"), f"c as ({SCC})")
def condensation_edges(graph):
    return merge.condensation_edges(cut(merge.components_of(graph.vertices, graph.edges)), graph.edges)


#: Counts by phase of scc_hong: what trimming leaves (core), the first pivot's component (ps), pairs (tw) and their vertices (tv).
PHASES = (
    closure("m"),
    core("m"),
    "f2 as (select id from dg where id in (select id from core) order by score desc, id limit 1)",
    "ps as (select x.d as id from r x join r y on x.s = y.d and x.d = y.s where x.s = (select id from f2))",
    "m2 as (select * from m where src in (select id from core) and dst in (select id from core) and src not in (select id from ps) and dst not in (select id from ps))",
    core("m2", "core2", "cyc2"),
    "m3 as (select * from m2 where src in (select id from core2) and dst in (select id from core2))",
    "i as (select dst as id, count(*) as n, min(src) as k from m3 group by 1)",
    "o as (select src as id, count(*) as n, min(dst) as k from m3 group by 1)",
    """tw as (select least(x.id, x.k) as a, greatest(x.id, x.k) as b from i x join i y on x.k = y.id and y.k = x.id where x.n = 1 and y.n = 1
    union select least(x.id, x.k), greatest(x.id, x.k) from o x join o y on x.k = y.id and y.k = x.id where x.n = 1 and y.n = 1)""",
    "tv as (select a as id from tw union select b from tw)",
    "m4 as (select * from m3 where src not in (select id from tv) and dst not in (select id from tv))",
    core("m4", "core4", "cyc4"),
    f"c as ({SCC})",
    """counts as (select (select count(distinct component) from c)::bigint as n_scc, (select count(distinct a) from tw)::bigint as n_trim2,
    ((select count(*) from v) - (select count(*) from ps) - (select count(*) from tv) - (select count(*) from core4))::bigint as n_trim1)""",
)


@query("a", "select n_scc, n_trim1, n_trim2, n_scc - n_trim1 - n_trim2 as n_pivot from counts", *PHASES)
def scc_counts(graph):
    """What each phase finds."""
    return pipelines.strong_components(graph).summary()


@query("a", "select 1::bigint as row, 'numberOf1Sccs: ' || n_trim1 as line from counts union all select 2, 'Number Of Sccs : ' || n_scc from counts", *PHASES)
def cli_report(graph):
    """What the command line prints, but for the time."""
    lines = report(pipelines.strong_components(graph).summary().first(), True)
    return graph.vertices.sparkSession.createDataFrame(list(enumerate(lines, 1)), "row long, line string")


# Rounds, as the jobs of the rounds themselves counted them.

#: The round that trims a vertex is the length of the longest way into it, or out of it, over vertices off and not between cycles.
TRIM_ROUNDS = (
    core("m"),
    "after_cycle as (select id from cyc union select d from core_r where s in (select id from cyc))",
    "before_cycle as (select id from cyc union select s from core_r where d in (select id from cyc))",
    "ways_in(id, n) as (select id, 1 from v where id not in (select dst from m) union select e.dst, n + 1 from ways_in join m e on e.src = ways_in.id where e.dst not in (select id from after_cycle))",
    "ways_out(id, n) as (select id, 1 from v where id not in (select src from m) union select e.src, n + 1 from ways_out join m e on e.dst = ways_out.id where e.src not in (select id from before_cycle))",
    "ends as (select src as id from m union select dst from m)",
    "gone as (select id, min(n) as n from (select id, max(n) as n from ways_in group by 1 union all select id, max(n) from ways_out group by 1) where id in (select id from ends) group by 1)",
)


@query(
    "a",
    """select k::bigint as round, (select count(*) from gone where n = k)::bigint as changed, ((select count(*) from ends) - (select count(*) from gone where n <= k))::bigint as left_over
    from (select unnest(range(1, 2 + (select max(n) from gone))) as k)""",
    *TRIM_ROUNDS,
)
def trim1_rounds(graph):
    """How many vertices each round of trimming removes, one round after the other; the last finds none."""
    record = Record()
    trim.trim1(graph.edges, chains=False, record=record)
    return record.table(graph.vertices.sparkSession).select("round", "changed", F.col("left").alias("left_over"))


@query(
    "b",
    """select k::bigint as round, (select count(*) from levels where n = k)::bigint as changed from (select unnest(range(1, 2 + (select max(n) from levels))) as k)""",
    BLOCK_PIVOTS,
    "steps(id, n) as (select pv, 0 from bp union select e.dst, n + 1 from steps join (select distinct src, dst from m) e on e.src = steps.id where n < 12)",
    "levels as (select id, min(n) as n from steps group by 1)",
)
def search_rounds(graph):
    """How many vertices each level of a search reaches first; components of view b have ten vertices, so levels end before 12."""
    record = Record()
    reach.reach(_block_pivots(graph).select(F.col("pivot").alias("id")), graph.edges, record=record)
    return record.table(graph.vertices.sparkSession).select("round", "changed")


def _label_rounds(most: int) -> tuple[str, ...]:
    """Rounds of least labels with jumps, written out one by one: l1, l2, ... and how many labels each changed."""
    first = "l0 as materialized (select id, id as label from v)", "l1 as materialized (select id, least(id, coalesce(min(dst), id)) as label from v left join m on src = id group by id)"
    near = "(select src as id, min(label) as near from m join l{0} on l{0}.id = dst group by 1)"
    more = [f"l{k + 1} as materialized (select x.id, least(x.label, y.label, coalesce(near, x.label)) as label from l{k} x join l{k} y on y.id = x.label left join {near.format(k)} n on n.id = x.id)" for k in range(1, most)]
    counts = " union all ".join(f"select {k} as round, (select count(*) from l{k} x join l{k - 1} y using (id) where x.label <> y.label) as changed" for k in range(1, most + 1))
    return *first, *more, f"counts as materialized ({counts})"


@query("a", "select round::bigint as round, changed::bigint as changed from counts where round <= (select min(round) from counts where changed = 0)", *_label_rounds(60))
def label_rounds(graph):
    """How many labels each round changes; the last changes none. An order may lead to no customer: whose label that is leaves."""
    record = Record()
    label.extreme_reachable(graph.vertices, graph.edges, record=record, within=True)
    return record.table(graph.vertices.sparkSession).select("round", "changed")


HONG_PHASES = ("trim1", "first pivot", "trim1", "trim2", "trim1", "labels", "split")
#: Vertices on the edges that trimming is given first, and what it leaves.
FIRST_TRIM = "(select count(*) from (select src from m union select dst from m)) - (select count(*) from core where id in (select src from m union select dst from m))"


@query(
    "b",
    f"""select t.step, t.phase, t.step <> 4 as counted, case when t.step = 1 then ({FIRST_TRIM})::bigint end as removed
    from (values {", ".join(f"({i}::bigint, '{p}')" for i, p in enumerate(HONG_PHASES, 1))}) as t(step, phase)""",
    core("m"),
)
def scc_phases(graph):
    """The phases of a run in order, whether its rounds are in the table of rounds (pairs take none), and what the first one removed."""
    spark = graph.vertices.sparkSession
    result = pipelines.hong(graph)
    phases = spark.createDataFrame([(i, p["phase"]) for i, p in enumerate(result.phases, 1)], "step long, phase string")
    sums = result.rounds().groupBy("step").agg(F.sum("changed").alias("removed"))
    joined = phases.join(sums, "step", "left")
    return joined.select("step", "phase", F.col("removed").isNotNull().alias("counted"), F.when(F.col("step") == 1, F.col("removed")).alias("removed"))


# Text formats: files made of a view's graph, in the scratch folder, and what the readers make of them.

WEIGHT = "(src + dst) % 9 + 1"


def _file(graph: Graph, lines: DataFrame, *head: str) -> str:
    spark = graph.vertices.sparkSession
    path = new_path(spark, "text")
    first = spark.createDataFrame([(x,) for x in head], "line string")
    (first.union(lines) if head else lines).write.text(path)
    return path


def _edge_lines(graph: Graph) -> DataFrame:
    return graph.edges.select(F.format_string("a %d %d %d", "src", "dst", F.expr(WEIGHT)).alias("line"))


def _read_gtgraph(graph: Graph) -> tuple[Graph, DataFrame]:
    head = [*(f"c comment {i}" for i in range(7)), f"p sp {graph.vertices.count()} {graph.edges.count()}"]
    return text_graphs.read_gtgraph(graph.vertices.sparkSession, _file(graph, _edge_lines(graph), *head))


@query("a", f"select src, dst, ({WEIGHT})::bigint as weight from m")
def gtgraph_scan(graph):
    return _read_gtgraph(graph)[1]


@query("a", "select (select count(*) from v)::bigint as n_vertices, (select count(*) from m)::bigint as n_edges")
def gtgraph_sizes(graph):
    """As the file's size line has them."""
    read, edges = _read_gtgraph(graph)
    return graph.vertices.sparkSession.createDataFrame([(read.vertices.count(), edges.count())], "n_vertices long, n_edges long")


@query("a", f"select src, dst, ({WEIGHT})::bigint as weight from m")
def plain_scan(graph):
    path = _file(graph, _edge_lines(graph), f"{graph.vertices.count()} {graph.edges.count()}")
    return text_graphs.read_plain(graph.vertices.sparkSession, path)[1]


@query("a", "select id, part from p")
def partition_scan(graph):
    path = _file(graph, graph.parts.orderBy("id").select(F.col("part").cast("string").alias("line")))
    return text_graphs.read_partition(graph.vertices.sparkSession, path, graph)


def _read_metis(graph: Graph) -> DataFrame:
    path = new_path(graph.vertices.sparkSession, "metis")
    text_graphs.write_metis(graph, path)
    return text_graphs.read_metis(graph.vertices.sparkSession, path)[0]


@query("b", "select k as id, (row_number() over (partition by k order by way, n) - 1)::int as pos, n as nbr from (select src as k, 0 as way, dst as n from m union all select dst, 1, src from m)")
def metis_scan(graph):
    return _read_metis(graph)


@query("b", "select src, dst from m union select dst, src from m")
def metis_round_trip(graph):
    """The converter's lines read back are the edges either way."""
    return _read_metis(graph).select(F.col("id").alias("src"), F.col("nbr").alias("dst")).distinct()


# The same formats as data sources, read in small splits.


def _loaded(graph: Graph, kind: str, path: str, **options) -> DataFrame:
    spark = graph.vertices.sparkSession
    datasource.register(spark)
    reader = spark.read.format(kind)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


@query("a", f"select src, dst, ({WEIGHT})::bigint as weight from m")
def gtgraph_source(graph):
    head = [*(f"c comment {i}" for i in range(7)), f"p sp {graph.vertices.count()} {graph.edges.count()}"]
    return _loaded(graph, "gtgraph", _file(graph, _edge_lines(graph), *head), splitBytes=1 << 16)


@query("b", "select (select count(*) from v)::bigint as vertices, (select count(*) from m)::bigint as edges")
def metis_source_sizes(graph):
    """The header that the writer's commit adds."""
    return _loaded(graph, "metis", _written(graph), table="sizes")


def _written(graph: Graph) -> str:
    path = new_path(graph.vertices.sparkSession, "metis")
    text_graphs.write_metis(graph, path, 4)
    return path


@query("b", "select k as id, (row_number() over (partition by k order by way, n) - 1)::int as pos, n as nbr from (select src as k, 0 as way, dst as n from m union all select dst, 1, src from m)")
def metis_source(graph):
    """Written in chunks of four, read in splits by an index made for them."""
    path, step = _written(graph), 1 << 12
    return _loaded(graph, "metis", path, splitBytes=step, index=datasource.line_index(graph.vertices.sparkSession, path, step))


@query("a", "select id, part from p")
def vertex_parts_source(graph):
    path, step = _file(graph, graph.parts.orderBy("id").select(F.col("part").cast("string").alias("line"))), 1 << 10
    return _loaded(graph, "vertex_parts", path, splitBytes=step, index=datasource.line_index(graph.vertices.sparkSession, path, step))


# The command line.


@query(
    "a",
    """select line, case when message = 'ok' then a end as algorithm, case when message = 'ok' then p::int end as trim1, case when message = 'ok' then coalesce(q, 1)::int end as trim2,
        case when message = 'ok' then coalesce(w, 1)::int end as warp, message
    from (select *, case when a not in ('g', 'x', 'h', 'y', 'd') then 'argument -a: invalid choice' when p = 'yes' then 'argument -p: invalid int value' when p not in ('0', '1') then 'argument -p: invalid choice'
        when q not in (0, 1) then 'argument -q: invalid choice' when w not in (1, 2, 4, 8, 16, 32) then 'argument -w: invalid choice' when not f then 'the following arguments are required: -f'
        when a = 'd' and not parts then '-a d needs --partition' else 'ok' end as message,
        '-a ' || a || ' -p ' || p || coalesce(' -q ' || q, '') || coalesce(' -w ' || w, '') || case when f then ' -f graph.gr' else '' end || case when parts then ' --partition graph.parts' else '' end as line
        from (select substring('gxhydz', (id % 6)::int + 1, 1) as a, case id % 7 when 5 then 'yes' when 6 then '2' else (id % 2)::varchar end as p, case when id % 5 < 4 then id % 5 // 2 + id % 5 % 2 end as q,
            case when id % 11 > 0 then id % 11 end as w, id % 13 > 0 as f, id % 3 > 0 as parts from v))""",
)
def cli_outcomes(graph):
    """A line of arguments for each vertex, made of its id, and what the parser says to it."""
    v = graph.vertices
    a = F.substring(F.lit("gxhydz"), (F.col("id") % 6).cast("int") + 1, F.lit(1))
    p = F.when(F.col("id") % 7 == 5, "yes").when(F.col("id") % 7 == 6, "2").otherwise((F.col("id") % 2).cast("string"))
    q = F.expr("if(id % 5 < 4, concat(' -q ', id % 5 div 2 + id % 5 % 2), '')")
    w = F.expr("if(id % 11 > 0, concat(' -w ', id % 11), '')")
    f = F.expr("concat(if(id % 13 > 0, ' -f graph.gr', ''), if(id % 3 > 0, ' --partition graph.parts', ''))")
    return outcomes(v.select(F.concat(F.lit("-a "), a, F.lit(" -p "), p, q, w, f).alias("line")))
