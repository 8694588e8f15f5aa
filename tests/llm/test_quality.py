import numpy as np
import pytest
from fixtures import awkward, frame

from graphloom.llm import quality as m

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(data):
    docs, labels = data
    targets = m.fitted(docs, labels, labelled=260, pool=500)
    assert any(sum(r) for r in targets["quality"].rounds)  # the views did teach each other
    known = {r.doc_id: r for r in labels.collect()}
    judged = [(r, known[r.doc_id]) for r in m.judged(docs, targets).collect() if r.doc_id in known]
    assert np.mean([(r.p_quality >= 0.5) == (k.quality > 0) for r, k in judged]) > 0.95
    clean = [r.keep for r, k in judged if k.quality and not k.toxic]
    assert np.mean(clean) > 0.97
    assert np.mean([r.keep for r, k in judged if not k.quality]) < 0.1
    assert np.mean([r.keep for r, k in judged if k.toxic]) < 0.5


def test_fitting_is_deterministic(data):
    docs, labels = data
    a, b = (m.fitted(x, labels, 200, 100)["toxic"] for x in (docs, docs.repartition(7)))
    assert np.allclose(a.both, b.both)


def test_fitting_does_not_depend_on_batches(spark, data):
    docs, labels = data
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for rows, parts in ((500, 1), (97, 3), (13, 5)):
            spark.conf.set(key, str(rows))
            t = m.fitted(docs.repartition(parts), labels, 200, 100)
            found.append([x.tobytes() for n in m.TARGETS for v in t[n].views for x in (v.w, v.names)] + [t[n].both.tobytes() for n in m.TARGETS])
    finally:
        spark.conf.set(key, old)
    assert found[0] == found[1] == found[2]


def test_awkward_rows(spark, data):
    docs, labels = data
    targets = m.fitted(docs, labels, 200, 100)
    rows = awkward()
    got = m.judged(frame(spark, rows), targets, ("key", "doc_id", "text", "h")).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted(rows, key=str)
    assert all(0 <= r.p_quality <= 1 and r.key == "k" and r.keep is not None for r in got)
    bare = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert m.judged(bare, targets).count() == 2
    assert m.judged(frame(spark, []), targets).count() == 0


def test_carried_names_may_be_those_of_results(spark, data):
    docs, labels = data
    targets = m.fitted(docs, labels, 200, 100)
    odd = docs.limit(20)
    for c in ("keep", "p_quality", "meta_toxic", "_0", "key", "size"):
        odd = odd.withColumn(c, m.F.lit("own"))
    got = m.judged(odd, targets, ("keep", "p_quality", "_0", "text"))
    assert {"carried_keep", "carried_p_quality", "_0", "text"} < set(got.columns)
    assert all(r.carried_keep == r._0 == "own" for r in got.collect())
    stay = {r.doc_id for r in got.collect() if r.keep}
    kept = m.kept(odd, targets)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == stay and all(r.keep == "own" for r in kept.collect())


SEEN = ("text", "source", "lang", "size")


def lists(rows):
    return [[r[c] for r in rows] for c in SEEN]


def test_one_round_of_exchange_against_a_plain_one(data):
    """The surest calls of every view, from sorting all documents on the driver."""
    docs, labels = data
    d = docs.select(*m._columns(docs)).withColumn("key", m.F.xxhash64(*SEEN))
    told = {r.doc_id: r for r in labels.collect()}
    rows = sorted((r for r in d.collect() if r.doc_id in told), key=lambda r: r.key)
    y = np.array([float(told[r.doc_id].quality) for r in rows])
    hashed = m.Extractor()(*lists(rows))
    known = m.vocabulary(hashed.words, [y])
    own = m.numbered(hashed, known)
    assert all(np.array_equal(a, b) for a, b in zip(own.words, m.Extractor(known)(*lists(rows)).words, strict=True))
    rest = d.where(~m.F.col("doc_id").isin(list(told)))
    plain = rest.dropDuplicates(["key"]).collect()
    all_rows = m.Extractor(known)(*lists(plain))
    seen = []

    def both(others, targets, most):
        got = m.confident(others, targets, most)
        for name, t in targets.items():
            for k, view in enumerate(t.views):
                p = 1 / (1 + np.exp(-(t.scales[k][0] + t.scales[k][1] * view.margin(all_rows))))
                want = {}
                for label, doubt in ((1.0, 1 - p), (0.0, p)):
                    sure = sorted((d, r.key) for d, r in zip(doubt, plain, strict=True) if d < m.CONFIDENT and r.key not in t.given[1 - k])
                    want.update({key: label for _, key in sure[:most]})
                assert got[name][k] == want
                seen.append(len(want))
        return got

    t = m.Target(0.5)
    t.start(own, y)
    m.exchange(m.cut(m.extracted(rest, known, "key")), {"quality": t}, 15, both)
    assert max(seen) >= 15 and len(t.rounds) == m.ROUNDS


def test_rows_judged_from_the_table_are_judged_alike(data):
    docs, labels = data
    targets = m.fitted(docs, labels, 200, 100)
    of = lambda df: sorted((r.doc_id, r.p_quality, r.text_toxic, r.keep) for r in df.collect())
    assert of(m.judged_here(targets)) == of(m.judged(docs, targets))


def test_views_see_different_things():
    rows = m.Extractor()(["Some words here"], ["web"], [None], [15])
    other = m.Extractor()(["Quite another text, longer"], ["web"], [None], [14])
    assert rows.meta[0].tolist() == other.meta[0].tolist() and rows.words[0].tolist() != other.words[0].tolist()
    assert m.token_features("x" * 50)[0] != m.token_features("x" * 40 + "y" * 10)[0]


def test_few_or_no_labels(spark, data):
    docs, _ = data
    kind = "doc_id long, quality int, toxic int"
    none = m.fitted(docs, spark.createDataFrame([], kind))
    assert {(r.p_quality, r.p_toxic, r.keep) for r in m.judged(docs, none).collect()} == {(0.5, 0.0, True)}
    alike = m.fitted(docs, spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1), (99999, 0, 1), (2, None, 0)], kind))
    assert {(r.p_quality, r.p_toxic) for r in m.judged(docs, alike).collect()} == {(0.75, 0.25)}
    m.fitted(frame(spark, []), spark.createDataFrame([(1, 1, 0)], kind))


def test_logistic():
    r = np.random.default_rng(1)
    x = np.concatenate((np.ones((4000, 1)), r.normal(size=(4000, 2))), axis=1)
    y = (r.random(4000) < 1 / (1 + np.exp(-(x @ [0.5, 1.0, -2.0])))).astype(float)
    assert np.allclose(m.logistic(x, y, 1e-3), [0.5, 1.0, -2.0], atol=0.2)


def test_pseudo_labels_come_from_all_documents(data):
    docs, labels = data
    targets = m.fitted(docs, labels, labelled=260, pool=40)
    # Four pseudo-labels of either class at most from each view and round: a fixed pool of 40 runs dry, all documents do not.
    # The metadata of these tables tells nothing of the labels, so that view is taught and does not teach.
    rounds = targets["quality"].rounds
    assert len(rounds) == m.ROUNDS and all(b[1] > a[1] for a, b in zip(rounds, rounds[1:], strict=False))
    assert max(rounds[-1]) <= 8 * m.ROUNDS


def test_metadata_that_tells_teaches_the_text_view(spark, data):
    docs, labels = data
    told = docs.join(labels, "doc_id", "left").withColumn("source", m.F.when(m.F.col("quality") > 0, "good").when(m.F.col("quality") == 0, "bad"))
    targets = m.fitted(told.drop("quality", "toxic"), labels, labelled=200, pool=40)
    rounds = targets["quality"].rounds
    assert rounds[0][0] > 0 and all(b[0] > a[0] for a, b in zip(rounds, rounds[1:], strict=False))
