import random
import re

from fixtures import awkward, frame
from pyspark.sql import functions as F
from test_simhash import classes

import corpus_pipeline
from graphloom.llm import near_dedup as m


def shingles(text):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def changed(words, n, r):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{r.randrange(10**6)}"
    return out


def corpus(r):
    """Pairs near similarity 0.8 on either side, chains, and a group larger than the centres of a band."""
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for n, k in [(60, 1), (60, 2), (200, 1), (200, 4), (200, 6), (1000, 20), (1000, 26)] * 8:
        own = r.choices(vocabulary, k=n)
        rows += [own, changed(own, k, r), changed(own, k, r)]
    base = r.choices(vocabulary, k=150)
    rows += [changed(base, 2, r) for _ in range(60)] + [base]
    # A cloud: alike to each other by two thirds at most, but for a copy of each third one.
    base = r.choices(vocabulary, k=120)
    for i in range(60):
        rows.append(changed(base, 5, r))
        if i % 3 == 0:
            rows.append(changed(rows[-1], 1, r))
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def brute(rows):
    """Component of each row, named by its smallest doc_id."""
    least = -(1 << 63)
    sets = [shingles(t) for _, t in rows]
    by = classes(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    first = {c: min(least if rows[i][0] is None else rows[i][0] for i in by if by[i] == c) for c in by.values()}
    return sorted((least if rows[i][0] is None else rows[i][0], first[by[i]]) for i in by)


def test_components_against_brute_force_similarity(spark):
    for rows in (corpus(random.Random(3)), awkward()):
        got = m.near_duplicates(frame(spark, rows)).collect()
        least = -(1 << 63)
        assert sorted((least if x.doc_id is None else x.doc_id, least if x.component_id is None else x.component_id) for x in got) == brute(rows)
    assert m.near_duplicates(frame(spark, [])).count() == 0


def test_rare_shingles_lose_no_pair_and_leave_none_of_a_cloud(spark):
    """Rows near 0.8 on either side, and a cloud of 0.6: every text has 24 of its 116 shingles to itself, over a ninth."""
    r = random.Random(5)
    rows = corpus(r)
    base = [f"c{i}" for i in range(120)]
    rows += [(len(rows) + i, " ".join(changed(base, 5, r))) for i in range(200)]
    d = m.documents(frame(spark, rows))
    sets = d.select(F.col("doc_id").alias("key"), "doc_key")
    rare = m._rare(d, sets, sets.select("key")).withColumn("component", F.col("key"))
    got = {(x.a, x.b) for x in m._pairs(rare, rare, spark.createDataFrame([], "a long, b long")).collect()}
    own = [shingles(t) for _, t in rows]
    near = {(i, j) for j in range(len(rows)) for i in range(j) if alike(own[i], own[j])}
    apart = {i for i in range(len(rows) - 200, len(rows)) if sum(all(x not in own[j] for j in range(len(rows)) if j != i) for x in own[i]) > len(own[i]) / 9}
    assert near <= got and len(apart) > 150 and not any(i in apart and j in apart for i, j in got)


def test_pipeline_stage_drops_what_is_alike(spark):
    rows = corpus(random.Random(8))
    got = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()}
    assert got == {d for d, c in brute(rows) if d == c}
