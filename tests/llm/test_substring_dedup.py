import hashlib
import random

import duckdb
import pytest
from fixtures import SF, awkward, frame

from graphloom.llm import substring_dedup as m
from graphloom.llm.common import documents


def brute(rows, keys, length):
    """keys: (doc_id, text) -> doc_key, which orders texts of one doc_id."""
    order = lambda d, t: (-(1 << 63) if d is None else d, keys[d, t or ""])
    first = {}
    split = lambda t: (t or "").encode().split()
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - length + 1):
            s = tuple(w[i : i + length])
            first[s] = min(first.get(s, (1 << 63,)), (*order(d, t), i))
    out = []
    for d, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] != (*order(d, t), i):
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize(("length", "k", "hot"), [(20, 6, 10**6), (20, 6, 3), (8, 3, 1), (12, 1, 20), (5, 5, 10**6)])
def test_against_brute_force(spark, length, k, hot):
    rows = awkward()
    docs = frame(spark, rows)
    keys = {(r.doc_id, r.text): r.doc_key for r in documents(docs).collect()}
    want = brute(rows, keys, length)
    assert got(m.without_spans(docs, m.repeated_spans(docs, length, k, hot))) == want
    assert sum(x[2] for x in want) > 800


def test_against_sql(spark):
    want = duckdb.sql(m.SQL.replace("documents", f"'{SF}/documents.parquet'")).fetchall()
    assert got(m.query(spark, SF)) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 1000


def test_reference_shards(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    reference = [text(n) for n in (0, 3, 40, 90, 25)] + [None]
    rows = [(i, text(r.randint(0, 30))) for i in range(20)] + [(30, "x " + reference[3][10:60]), (31, None)]
    known = set()
    for t in reference:
        w = (t or "").split()
        known |= {tuple(w[i : i + 6]) for i in range(len(w) - 5)}
    docs = frame(spark, rows)
    ref = spark.createDataFrame([(t,) for t in reference], "text string")
    for size in (15, 10**6):
        removed = {r.doc_id: r.n_removed for r in m.without_spans(docs, m.spans_in_reference(docs, ref, 6, shard_words=size)).collect()}
        for d, t in rows:
            w = (t or "").split()
            gone = {j for i in range(len(w) - 5) if tuple(w[i : i + 6]) in known for j in range(i, i + 6)}
            assert removed[d] == len(gone)


def test_matching_statistics():
    r = random.Random(1)
    for _ in range(150):
        texts = [[r.choice("ab") for _ in range(r.randint(0, 12))] for _ in range(r.randint(0, 4))]
        a = m.Automaton()
        for t in texts:
            a.add(t)
        held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        q = [r.choice("abc") for _ in range(15)]
        want = [max((j - i for i in range(j) if tuple(q[i:j]) in held), default=0) for j in range(1, 16)]
        assert a.matching(q) == want


def test_empty(spark):
    docs = frame(spark, [])
    assert m.without_spans(docs, m.repeated_spans(docs)).count() == 0
    assert m.spans_in_reference(frame(spark, [(1, "a")]), docs).count() == 0
