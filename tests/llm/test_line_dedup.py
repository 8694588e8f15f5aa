import hashlib
import re

import duckdb
import pytest
from fixtures import SF, awkward, frame

from graphloom.llm import line_dedup as m


def brute(rows, min_chars=20, min_docs=3):
    low = lambda s: re.sub("[A-Z]", lambda x: x[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holds = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holds.setdefault(low(line), set()).add(-(1 << 63) if d is None else d)
    out = []
    for d, t in rows:
        n, lines = -(1 << 63) if d is None else d, (t or "").split("\n")
        gone = [len(low(x)) >= min_chars and len(holds[low(x)]) >= min_docs and n < max(holds[low(x)]) for x in lines]
        out.append((d, len(lines), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(lines, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_against_brute_force(spark, hot):
    filler = [f"a line of its own, number {i}" for i in range(300)]
    shared = [f"some line that is shared, {i}" for i in range(100)]
    rows = [*awkward(), (100, "\n".join(filler)), (101, "\n".join(filler)), (102, "\n".join([*filler[:150], "", *shared])), (103, "\n".join(shared + shared)), (None, "\n".join(shared)), (104, "\n".join(shared[50:]).upper())]
    docs = frame(spark, rows)
    kept = m.kept_lines(docs, m.keep_bitmaps(docs, hot_lines=hot)).collect()
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in kept]
    want = brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 300
    assert m.kept_lines(frame(spark, []), m.keep_bitmaps(frame(spark, []))).count() == 0


def test_against_sql(spark):
    got = sorted(map(tuple, m.query(spark, SF).collect()))
    want = duckdb.sql(m.SQL.replace("documents", f"'{SF}/documents.parquet'")).fetchall()
    assert got == sorted(want)
    assert sum(x[2] for x in got) > 0
