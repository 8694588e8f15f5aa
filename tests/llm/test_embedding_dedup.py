import numpy as np
import pytest
from compare import compare

from graphloom.llm import embedding_dedup as m

KIND = "label int, vec_id long, embedding array<float>, id string, vec string, h1 string, cell string, links string"


def brute(rows, cosine=0.93):
    """rows: (vec_id, label, vector); one row for each vec_id."""
    good = [(i, lab, np.asarray(v, np.float32).astype(float)) for i, lab, v in rows if i is not None and lab is not None and v is not None and len(v) and None not in v and np.isfinite(np.asarray(v, np.float32)).all() and np.any(v)]
    near = {i: set() for i, _, _ in rows}
    for lab, dim in {(g[1], len(g[2])) for g in good}:
        own = [g for g in good if (g[1], len(g[2])) == (lab, dim)]
        x = np.array([g[2] / np.linalg.norm(g[2]) for g in own])
        for a, b in zip(*np.nonzero(x @ x.T >= cosine), strict=True):
            if a != b:
                near[own[a][0]].add(own[b][0])
    least = {i: i for i in near}
    changed = True
    while changed:
        changed = False
        for i, others in near.items():
            new = min([least[i], *(least[o] for o in others)]) if i is not None else None
            changed, least[i] = changed or new != least[i], new
    return sorted(((i, len(near[i]), least[i], i == least[i] if i is not None else None) for i, _, _ in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(lab, i, v, "i", "v", "h", "c", "l") for i, lab, v in rows], KIND)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def cases(seed=3, n=500, dim=24):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    rows = []
    for i, v in enumerate(base):
        rows.append((10 * i, i % 3, v))
    for i in range(0, n, 5):  # near copies and copies, some under another label
        rows.append((10 * i + 1, i % 3, base[i] + r.normal(size=dim) * 0.2 * np.linalg.norm(base[i]) / np.sqrt(dim)))
        rows.append((10 * i + 2, (i + i % 2) % 3, base[i]))
    for j in range(150):  # a cloud, a chain and copies of one
        rows.append((90_000 + j, 0, base[0] + r.normal(size=dim) * 0.3 * np.linalg.norm(base[0]) / np.sqrt(dim)))
        rows.append((91_000 + j, 1, np.cos(j / 5) * base[1] / np.linalg.norm(base[1]) + np.sin(j / 5) * base[2] / np.linalg.norm(base[2])))
        rows.append((92_000 + j, 2, base[3]))
    rows = [(i, lab, [float(x) for x in np.float32(v)]) for i, lab, v in rows]
    nan, inf = float("nan"), float("inf")
    rows += [(-1, 0, None), (-2, 0, []), (-3, 0, [0.0] * dim), (-4, 0, [nan] * dim), (-5, 0, [inf] * dim), (-6, 0, [None, 1.0]), (-7, None, rows[0][2]), (None, 0, rows[0][2]), (-8, 0, [1e30] * 2), (-9, 0, [1e-30, 1e-30])]
    return rows


@pytest.mark.parametrize(("cell", "most"), [(1_000, 20_000), (60, 20_000), (150, 40)])
def test_against_brute_force(spark, cell, most):
    rows = cases()
    found = m.near_duplicates(frame(spark, rows), recall=1.0, cell=cell, most=most)
    want = brute(rows)
    assert got(found) == want
    assert max(x[1] for x in want) >= 150 and (-8, 1, -9, False) in want


def test_a_failed_audit_widens_the_search(spark):
    rows = cases(7, 200)
    seen, old = [], m.searched
    try:
        m.searched = lambda *x: seen.append(x[-1]) or old(*x)
        found = m.near_duplicates(frame(spark, rows), recall=1.0, overlap=0.02, beam=1, cell=30)
    finally:
        m.searched = old
    assert len(seen) > 1 and got(found) == brute(rows)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, 1, [1.0, 0.0])]
    assert got(m.near_duplicates(frame(spark, rows))) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert m.near_duplicates(frame(spark, [])).count() == 0
    doubles = spark.createDataFrame([(1, [1e200, 0.0], 1), (2, [1e200, 1e199], 1)], "vec_id long, embedding array<double>, label int")
    assert got(m.near_duplicates(doubles)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_recall_of_the_graph_alone():
    r = np.random.default_rng(5)
    x = m.unit(np.concatenate((r.normal(size=(4000, 64)), np.zeros((0, 64)))))
    y = m.unit(x[:400] + r.normal(size=(400, 64)) * 0.3 / 8)
    x = np.concatenate((x, y)).astype(np.float32)
    near, medoids = m.graph_of(x)
    assert near.shape[1] < 200 and len(medoids) > 40
    a, b = m.in_range(x, near, medoids, y.astype(np.float32), 0.93, m.BEAM)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    true = list(zip(*np.nonzero(y @ x.astype(float).T >= 0.93), strict=True))
    assert len(true) >= 790 and sum(t in found for t in true) / len(true) > 0.98


def test_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.001", m.query, m.SQL) > 50


def test_given_embeddings(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert got(m.query(spark, "/root/testdata/sf0.01")) == brute(rows)
