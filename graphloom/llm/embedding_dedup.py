"""Near-duplicate embeddings by a robust-pruned flat graph: overlapping cluster shards, united adjacency lists, range-expanding
greedy search from medoids, a recall audit, exact verification.

Vectors with the same label and components are copies: they are counted before anything is shuffled, and one of them stands for all. The
rest is dealt to cells of a label, whose centres are fitted on a bounded sample: a vector belongs to its nearest centre, and visits those that
are nearly as near, so that two that are similar meet. Centres are kept apart, so a cloud of near-copies does not visit itself in
many cells; a cell that holds more than ``most`` vectors, by the sample's share, is cut into slices that all of the cell's own
vectors search.

In a cell, small clusters overlap (a vector is in its two nearest). Of each cluster's members a robust pruning keeps for every vector those
neighbours to which no kept one leads better; the lists of all clusters are united, and links back are added. A search begins at
the nearest medoids, expands the best of a beam until all in it are expanded, and then, from all that is within the range, goes
on as long as it finds more within it: clouds need no wider beam. Pairs found are verified in double precision. They
do not leave the task: it returns how many a vector has, and a smallest linked id, which joins components across cells.

A sample of vectors is compared with all rows, in blocks. If its links were not found to a share of ``recall``, all is searched
again, with twice the overlap and twice the beam, in the end with all cells visited and all vectors in the beam.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without label, link with nothing.
Vectors of different lengths do not link. A repeated row is one vector. A null vec_id links with nothing; its component and
``kept`` are null. One vec_id with several vectors has the links of all of them. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, discard, prepare, table
from graphloom.llm.components import components

COSINE, RECALL = 0.93, 0.99
#: Vectors that the centres are fitted on, and that recall is audited on, at most; centres of all labels.
SAMPLE, AUDIT, CENTRES = 20_000, 1_000, 4_096
#: Vectors of a cell: on average, and the most before it is sliced.
CELL, MOST = 1_000, 20_000
#: How much less similar a centre may be than the nearest to be visited; centres more alike than this are one.
OVERLAP, APART = 0.12, 0.8
CLUSTER, DEGREE, POOL, ALPHA = 64, 16, 64, 1.2
BEAM, STEP = 24, 4
QUERIES, PAIRS = 256, 1 << 16


@dataclass(frozen=True)
class Search:
    cosine: float
    overlap: float
    beam: int

    def wider(self) -> Search:
        return Search(self.cosine, 2 * self.overlap, 4 * self.beam)

    def exhaustive(self, n: int) -> bool:
        """Whether of n rows all visit all cells, and a beam holds them all."""
        return self.overlap >= 2 and self.beam >= n


# Numbers only: what a task does with the vectors it has.


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; none is zero."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres_of(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """About k spherical means of the unit rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], c)
    return c


def pruned(s: np.ndarray, rows: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours of each of the rows among a cluster with similarities s: the nearest, then the nearest that no chosen one is ``ALPHA`` times
    nearer to; -1 where there are no more."""
    n = len(s)
    pool = min(POOL, n - 1)
    if pool < 1:
        return np.full((len(rows), degree), -1)
    own = s[rows].copy()
    own[np.arange(len(rows)), rows] = -2
    near = np.argpartition(-own, pool - 1, axis=1)[:, :pool] if pool < n - 1 else np.argsort(-own, axis=1)[:, :pool]
    far = 1 - np.take_along_axis(own, near, axis=1)
    open_, out, at = np.ones(near.shape, bool), np.full((len(rows), degree), -1), np.arange(len(rows))
    for k in range(degree):
        best = np.where(open_, far, np.inf).argmin(axis=1)
        some = open_[at, best]
        if not some.any():
            break
        chosen = near[at, best]
        out[some, k] = chosen[some]
        open_ &= ALPHA * (1 - s[chosen[:, None], near]) > far
        open_[at, best] = False
    return out


def graph_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, medoids) of the unit rows: lists of all clusters united, with links back, padded by -1."""
    n = len(x)
    k = math.ceil(n / CLUSTER)
    c = centres_of(x, k, 3)
    s = x @ c.T
    medoids = np.unique(s.argmax(axis=0))
    two = np.argpartition(-s, 1, axis=1)[:, :2] if k > 2 else np.tile(np.arange(k), (n, 1))
    order, bounds = np.argsort(two.ravel(), kind="stable") // two.shape[1], np.cumsum(np.bincount(two.ravel(), minlength=k))[:-1]
    pairs = []
    for own in np.split(order, bounds):
        if len(own) > 1:
            sims = x[own] @ x[own].T
            for lo in range(0, len(own), 4096):
                rows = np.arange(lo, min(lo + 4096, len(own)))
                found = pruned(sims, rows, DEGREE)
                i, j = np.nonzero(found >= 0)
                pairs.append(np.column_stack((own[rows[i]], own[found[i, j]])))
    if not pairs:
        return np.full((n, 1), -1), medoids
    e = np.concatenate(pairs)
    e = np.unique(np.concatenate((e, e[:, ::-1])), axis=0)  # a list is bounded by what its vector was chosen for
    place = np.arange(len(e)) - np.searchsorted(e[:, 0], e[:, 0])
    out = np.full((n, int(place.max()) + 1), -1)
    out[e[:, 0], place] = e[:, 1]
    return out, medoids


def in_range(x: np.ndarray, near: np.ndarray, medoids: np.ndarray, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of similarity ``least`` or more that a search of the graph finds."""
    n, rows = len(q), np.arange(len(q))[:, None]
    if beam >= len(x):
        medoids = np.arange(len(x))
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # -1 is no row
    s = q @ x[medoids].T
    width = min(beam, len(x))
    start = np.argsort(-s, axis=1, kind="stable")[:, : min(width, len(medoids))]
    ids, sims = medoids[start], np.take_along_axis(s, start, axis=1)
    seen[rows, ids] = True
    i, j = np.nonzero(sims >= least)
    found = [(i, ids[i, j])]
    expanded = np.zeros(ids.shape, bool)
    live = np.arange(n)
    while len(live):
        best = np.argsort(np.where(expanded[live], np.inf, -sims[live]), axis=1, kind="stable")[:, :STEP]
        to = live[:, None]
        ready = ~expanded[to, best]
        expanded[to, best] = True
        next_ = np.where(ready[:, :, None], near[ids[to, best]], -1).reshape(len(live), -1)
        i, j = np.nonzero(~seen[to, next_])
        a, b = np.unique(np.column_stack((live[i], next_[i, j])), axis=0).T if len(i) else (i, j)
        seen[a, b] = True
        w = _similar(q, x, a, b)
        found.append((a[w >= least], b[w >= least]))
        place = np.arange(len(a)) - np.searchsorted(a, a)
        more = int(place.max()) + 1 if len(a) else 0
        new_ids, new_sims = np.zeros((n, more), ids.dtype), np.full((n, more), -3.0, sims.dtype)
        new_ids[a, place], new_sims[a, place] = b, w
        ids, sims, expanded = np.concatenate((ids, new_ids), axis=1), np.concatenate((sims, new_sims), axis=1), np.concatenate((expanded, new_sims < -2), axis=1)
        if ids.shape[1] > width:
            top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            ids, sims, expanded = (np.take_along_axis(v, top, axis=1) for v in (ids, sims, expanded))
        live = np.flatnonzero(~expanded.all(axis=1))
    a, b = (np.concatenate(v) for v in zip(*found, strict=True))
    found = [(a, b)]
    while len(a):  # from all within the range, as long as there is more within it
        fresh = []
        for lo in range(0, len(a), PAIRS):
            i, next_ = a[lo : lo + PAIRS], near[b[lo : lo + PAIRS]]
            r, c = np.nonzero(~seen[i[:, None], next_])
            if len(r):
                key = np.unique(i[r] * np.int64(len(x)) + next_[r, c])
                u, v = np.divmod(key, len(x))
                seen[u, v] = True
                w = _similar(q, x, u, v)
                fresh.append((u[w >= least], v[w >= least]))
        a, b = (np.concatenate(v) for v in zip(*fresh, strict=True)) if fresh else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        found.append((a, b))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _similar(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), q.dtype)
    for lo in range(0, len(a), PAIRS):
        out[lo : lo + PAIRS] = np.einsum("ij,ij->i", q[a[lo : lo + PAIRS]], x[b[lo : lo + PAIRS]])
    return out


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each is linked to, after the links a - b are added to ``root``."""
    while len(a):
        r, s = root[a], root[b]
        open_ = r != s
        a, b, r, s = a[open_], b[open_], r[open_], s[open_]
        np.minimum.at(root, np.maximum(r, s), np.minimum(r, s))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def cell_links(ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, role: np.ndarray, how: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, root) of the rows of a cell that have links: links counts copies of other rows, for the rows that search; root is the least id
    that the row is linked to here."""
    order = np.lexsort((role == SEARCHES, ids))  # by id, which makes the least row the least id; targets first
    ids, copies, role = ids[order], copies[order], role[order]
    x = unit(vectors[order])
    small = x.astype(np.float32)
    targets, queries = np.flatnonzero(role != SEARCHES), np.flatnonzero(role != VISITS)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    if len(targets) and len(queries):
        near, medoids = graph_of(small[targets])
        for lo in range(0, len(queries), QUERIES):
            own = queries[lo : lo + QUERIES]
            a, b = in_range(small[targets], near, medoids, small[own], how.cosine - 1e-4, how.beam)
            a, b = own[a], targets[b]
            other = ids[a] != ids[b]
            a, b = a[other], b[other]
            sure = _similar(x, x, a, b) >= how.cosine
            a, b = a[sure], b[sure]
            links += np.bincount(a, copies[b], len(ids)).astype(np.int64)
            root = joined(root, a, b)
    some = (links > 0) | (root != np.arange(len(ids)))
    return ids[some], links[some], ids[root[some]]


# Roles of a row in a cell: it is found and searches, is only found, or only searches.
OWN, VISITS, SEARCHES = 0, 1, 2


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _vectors(rows: DataFrame, vec_col: str) -> tuple[DataFrame, str]:
    """``rows`` with whether a vector can link (good), and its components' numpy type."""
    kind = "<f4" if dict(rows.dtypes)[vec_col] == "array<float>" else "<f8"
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.withColumn("good", F.coalesce(fine & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False))), kind


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """(id, label, copies, vec, dim): components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column("vec")
            flat, ends = vec.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate(([0], np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))))
            packed = pa.array([flat[ends[i] : ends[i + 1]].tobytes() for i in range(len(vec))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("copies"), packed, vec.value_lengths().cast(pa.int32())], ["id", "label", "copies", "vec", "dim"])

    return rows.select("id", "label", "copies", "vec").mapInArrow(run, "id long, label string, copies long, vec binary, dim int")


def fitted_centres(sample: pa.Table, sizes: dict[tuple[str, int], int], kind: str, cell: int = CELL, most: int = MOST) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """(label, dim) to (centres, slices of each cell), from a sample of (id, label, vec, dim) and the sizes of all labels."""
    out, total = {}, max(1, sum(sizes.values()))
    rows: dict[tuple[str, int], list[bytes]] = {}
    for r in sorted(zip(*(sample.column(c).to_pylist() for c in ("id", "label", "dim", "vec")), strict=True)):
        rows.setdefault((r[1], r[2]), []).append(r[3])
    for key, n in sizes.items():
        own = rows.get(key, [])
        k = min(math.ceil(n / cell), max(1, CENTRES * n // total), len(own) // 8)
        if k < 2 and n <= most:
            continue
        if not own:
            out[key] = np.zeros((0, key[1])), np.array([math.ceil(n / most)])
            continue
        x = unit(np.frombuffer(b"".join(own), kind).reshape(-1, key[1]))
        c = centres_of(x, max(k, 1))
        sizes_of = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
        apart: list[int] = []
        for i in np.argsort(-sizes_of, kind="stable"):
            if not apart or (c[apart] @ c[i]).max() < APART:
                apart.append(int(i))
        c = c[apart]
        share = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c)) / len(x)
        out[key] = c, np.maximum(1, np.ceil(share * n / most)).astype(int)
    return out


def dealt(packed: DataFrame, centres: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], kind: str, overlap: float) -> DataFrame:
    """(label, dim, cell, slice, role, id, copies, vec): the rows of each cell."""
    model = packed.sparkSession.sparkContext.broadcast(centres)  # CENTRES at most
    names = ["label", "dim", "cell", "slice", "role", "id", "copies", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, dim, ids = b.column("label").to_pylist(), b.column("dim").to_pylist(), b.column("id").to_numpy()
            at: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(label, dim, strict=True)):
                at.setdefault(key, []).append(i)
            for key, own in at.items():
                c, slices = model.value.get(key, (np.zeros((0, key[1])), np.ones(1, int)))
                rows = b.take(pa.array(own))
                if len(c) > 1:
                    s = unit(_matrix(rows.column("vec"), key[1], kind)) @ c.T
                    first = s.argmax(axis=1)
                    i, cell = np.nonzero(s >= s.max(axis=1, keepdims=True) - overlap)
                    role = np.where(cell == first[i], OWN, VISITS)
                else:
                    i, cell, role = np.arange(len(own)), np.zeros(len(own), int), np.full(len(own), OWN)
                n = slices[cell]
                home = ids[own][i] % n
                for k in range(int(n.max())):
                    here = home == k
                    go = here | ((role == OWN) & (k < n))
                    if go.any():
                        r, found = np.where(here, role, SEARCHES)[go], rows.take(pa.array(i[go]))
                        count = lambda v: pa.array(v, pa.int32())
                        yield pa.RecordBatch.from_arrays([found.column("label"), found.column("dim"), count(cell[go]), count(np.full(len(r), k)), count(r), *(found.column(c) for c in ("id", "copies", "vec"))], names)

    return packed.mapInArrow(run, "label string, dim int, cell int, slice int, role int, id long, copies long, vec binary")


def searched(packed: DataFrame, centres: dict, kind: str, how: Search) -> DataFrame:
    """(id, links, root) by cells and slices."""

    def run(t: pa.Table) -> pa.Table:
        vectors = _matrix(t.column("vec"), t.column("dim")[0].as_py(), kind)
        found = cell_links(*(v if isinstance(v, np.ndarray) else t.column(v).to_numpy() for v in ("id", vectors, "copies", "role")), how)
        return pa.table([pa.array(v, pa.int64()) for v in found], ["id", "links", "root"])

    return dealt(packed, centres, kind, how.overlap).groupBy("label", "dim", "cell", "slice").applyInArrow(run, "id long, links long, root long")


def true_links(packed: DataFrame, queries: pa.Table, kind: str, cosine: float) -> DataFrame:
    """(id, links) of the queries, a bounded set, compared with all rows in blocks."""
    rows: dict[tuple[str, int], tuple[list, list]] = {}
    for i, label, dim, vec in zip(*(queries.column(c).to_pylist() for c in ("id", "label", "dim", "vec")), strict=True):
        own = rows.setdefault((label, dim), ([], []))
        own[0].append(i)
        own[1].append(vec)
    model = packed.sparkSession.sparkContext.broadcast({k: (np.array(i), unit(np.frombuffer(b"".join(v), kind).reshape(-1, k[1]))) for k, (i, v) in rows.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: dict[int, int] = {}
        for b in batches:
            label, dim, ids, copies = b.column("label").to_pylist(), b.column("dim").to_pylist(), b.column("id").to_numpy(), b.column("copies").to_numpy()
            at: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(label, dim, strict=True)):
                if key in model.value:
                    at.setdefault(key, []).append(i)
            for key, own in at.items():
                of, q = model.value[key]
                x = unit(_matrix(b.column("vec").take(pa.array(own)), key[1], kind))
                near = (q @ x.T >= cosine) & (of[:, None] != ids[own][None, :])
                for i, n in zip(of.tolist(), (near @ copies[own]).tolist(), strict=True):
                    links[i] = links.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(links), pa.int64()), pa.array(list(links.values()), pa.int64())], ["id", "links"])

    return packed.mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audited(found: DataFrame, truth: DataFrame) -> float:
    """The share of the links in ``truth`` (id, links) that ``found`` (id, links) has."""
    both = truth.join(found.groupBy("id").agg(F.sum("links").alias("got")), "id", "left")
    r = both.agg(F.sum("links").alias("all"), F.sum(F.least("links", F.coalesce("got", F.lit(0)))).alias("got")).first()
    return r.got / r.all if r.all else 1.0


def near_duplicates(rows: DataFrame, cosine: float = COSINE, recall: float = RECALL, overlap: float = OVERLAP, beam: int = BEAM, cell: int = CELL, most: int = MOST, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: how many other vectors of its label have a cosine of ``cosine`` or more, the smallest
    vec_id that it reaches by such links, and whether that is its own."""
    spark = rows.sparkSession
    prepare(spark)
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    named, kind = _vectors(named, "vec")
    hashes = [F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit("vector"), "vec", "label").alias("h2")]
    good = named.where("good").select("id", "label", "vec", *hashes)
    groups = cut(good.select("id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "copies")
    packed = cut(_packed(good.join(groups, ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"]), kind), "vectors")

    sizes = {(r.label, r.dim): r.n for r in packed.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > 1).collect()}
    n = sum(sizes.values())
    chosen = lambda most, salt: packed.where(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 30)) < min(1 << 30, (most << 30) // max(n, 1) + 1)).limit(2 * most)
    centres = fitted_centres(chosen(SAMPLE, "centres").select("id", "label", "dim", "vec").toArrow(), sizes, kind, cell, most)
    truth = cut(true_links(packed, chosen(AUDIT, "audit").select("id", "label", "dim", "vec").toArrow(), kind, cosine), "audit")
    how = Search(cosine, overlap, beam)
    while True:
        found = cut(searched(packed, centres, kind, how), "links")
        if audited(found, truth) >= recall or how.exhaustive(n):
            break
        discard(found)
        how = how.wider()
    discard(packed)

    named_by = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links")).join(named_by.withColumnRenamed("node", "id"), "id", "left")
    groups = groups.join(links, "id", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    all_ = named.select("id", *(F.when(F.col("good"), h).alias(f"h{i}") for i, h in enumerate(hashes, 1)))
    out = all_.join(groups, ["h1", "h2"], "left").select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive typed as (select vec_id, label, embedding::double[] as e from embeddings),
    sizes as (select *, case when len(e) > 0 and list_count(e) = len(e) then list_dot_product(e, e) end as size from typed),
    good as (select * from sizes where vec_id is not null and label is not null and isfinite(size) and size > 0),
    links as materialized (select a.vec_id as x, b.vec_id as y from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
        where list_dot_product(a.e, b.e) / sqrt(a.size * b.size) >= 0.93),
    reached(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from reached r join links l on l.x = r.y),
    least as (select x as vec_id, min(y) as component_id from reached group by 1),
    counts as (select x as vec_id, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings left join counts using (vec_id) left join least using (vec_id)
"""
