import re

import numpy as np
from fixtures import awkward, frame
from pyspark.sql.functions import lit
from test_decontamination import brute as leaks
from test_near_dedup import alike, shingles
from test_simhash import classes

import corpus_pipeline as p
from graphloom.llm import quality

SF = "/root/testdata/sf0.001"


def kept_lines(rows):
    low = lambda s: re.sub("[A-Z]", lambda x: x[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holds = {}
    for d, t in rows:
        for line in t.split("\n"):
            holds.setdefault(low(line), set()).add(d)
    return [(d, "\n".join(x for x in t.split("\n") if len(low(x)) < 20 or len(holds[low(x)]) < 3 or d == max(holds[low(x)]))) for d, t in rows]


def one_of_each(rows):
    """The first of each group of documents whose 5-word shingles have a similarity of 0.8 or more."""
    sets = {d: shingles(t) for d, t in rows}
    group = classes(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    return [(d, t) for d, t in rows if group[d] == d]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    stages = [f for _, f in p.STAGES]
    assert len(stages) == 5

    first = stages[0](spark, docs, SF)
    judged = quality.judged(docs, quality.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    keep = {r.doc_id for r in judged.collect() if r.keep}
    assert rows(first) == [x for x in rows(docs) if x[0] in keep]
    assert 0.5 * docs.count() < first.count() < docs.count()

    second = stages[1](spark, docs, SF)
    want = kept_lines(rows(docs))
    assert rows(second) == want and want != rows(docs)
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third = stages[2](spark, second, SF)
    assert rows(third) == one_of_each(want) and third.count() < second.count()

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, *_ in leaks(items, rows(third))}
    fourth = stages[3](spark, third, SF)
    assert rows(fourth) == [x for x in rows(third) if x[0] not in held] and held
    for df in (first, second, third, fourth):
        assert df.columns == docs.columns

    pieces = stages[4](spark, fourth, SF)
    assert {r.doc_id for r in pieces.collect()} == {d for d, _ in rows(fourth)}


def test_run_keeps_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect())
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in p.run(spark, SF).collect()) == want and want


def test_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = ("keep", "p_quality", "p_toxic", "text_quality", "meta_toxic", "key", "_0", "band", "fp", "component", "lines", "stay", "words", "range", "h1", "n", "start")
    for c in odd:
        docs = docs.withColumn(c, lit("own"))
    names = docs.columns
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
    assert docs.where(" and ".join(f"{c} = 'own'" for c in odd)).count() == docs.count() > 0
    assert p.STAGES[-1][1](spark, docs, SF).count() > 0


def test_awkward_and_empty(spark):
    for rows in (awkward(), []):
        docs = frame(spark, rows)
        for name, stage in p.STAGES:
            docs = stage(spark, docs, SF)
            if name != p.STAGES[-1][0]:
                assert docs.columns == frame(spark, []).columns
        assert (docs.count() > 0) == bool(rows)
    assert np.isfinite(docs.count())
