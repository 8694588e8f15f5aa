import hashlib
import random

import numpy as np
import pytest
from fixtures import SF, awkward, frame

from graphloom.llm import anchors
from graphloom.llm import suffix_dedup as m


def brute(rows, length):
    distinct = {(d, t or "") for d, t in rows}
    places = {}
    for d, t in distinct:
        b = t.encode()
        for i in range(len(b) - length + 1):
            places.setdefault(b[i : i + length], []).append((d, t, i))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if len(places[b[i : i + length]]) > 1:
                gone[i : i + length] = True
        runs = "".join(" x"[int(g)] for g in gone).split()
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize(("length", "k", "hot"), [(60, 16, 10**6), (60, 16, 3), (33, 9, 1), (100, 24, 12)])
def test_against_brute_force(spark, length, k, hot):
    rows = awkward()
    docs = frame(spark, rows)
    want = brute(rows, length)
    assert got(m.without_spans(docs, m.repeated_spans(docs, length, k, hot))) == want
    assert sum(x[2] for x in want) > 5000


def test_runs_of_one_letter_and_periods(spark):
    rows = [(1, "a" * 90), (2, "ab" * 45), (3, "x" + "abc" * 30), (4, "b" * 59), (5, "a" * 59 + "b"), (6, "ba" * 40)]
    docs = frame(spark, rows)
    for hot in (1, 10**6):
        assert got(m.without_spans(docs, m.repeated_spans(docs, 60, 16, hot))) == brute(rows, 60)


def test_test_data_at_full_length(spark):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = brute(rows, 400)
    assert got(m.query(spark, SF)) == want
    assert sum(x[2] for x in want) > 10_000


def test_empty(spark):
    docs = frame(spark, [])
    assert m.without_spans(docs, m.repeated_spans(docs)).count() == 0


def test_merge_never_reorders():
    r = random.Random(2)
    for _ in range(80):
        runs = [[bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 9))]
        coded = [m.front_coded([(x, b"", 0, i, 0) for x in own]) for i, own in enumerate(runs)]
        out = list(m.merged([m.decoded(c) for c in coded]))
        want = sorted(x for own in runs for x in own)
        assert [x for x, _, _ in out] == want
        assert [n for _, n, _ in out][1:] == [m.common_prefix(x, y) for x, y in zip(want, want[1:])]


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(3)
    units = r.integers(0, 3, 400).astype(np.uint64)
    both = np.concatenate((units, units[100:300], r.integers(0, 3, 50).astype(np.uint64)))
    starts = np.array([0, 400, 650])
    d, a, i, j, h = anchors.segments(both, starts, 40, 12)
    of = {(x, w): (p - w, y) for x, p, s, e, y in zip(d, a, i, j, h) for w in range(s, e + 1)}
    assert len(of) == 361 + 211
    for w in range(161):
        assert of[0, 100 + w] == of[1, w]


def test_long_texts_are_taken_in_pieces():
    r = np.random.default_rng(4)
    units = np.concatenate((r.integers(0, 3, 700), np.zeros(300, np.int64), r.integers(0, 2, 500))).astype(np.uint64)
    whole = anchors.segments(units, np.array([0, 1500]), 40, 12)
    for most in (41, 100, 333, 1461):
        assert all(np.array_equal(x, y) for x, y in zip(whole, anchors.segments(units, np.array([0, 1500]), 40, 12, most), strict=True))


def test_against_sql(spark):
    import duckdb

    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.query(spark, SF).collect())
    want = duckdb.sql(m.SQL.replace("from documents)", f"from '{SF}/documents.parquet')", 1)).fetchall()
    assert got == sorted(want) and sum(x[2] for x in got) > 0
