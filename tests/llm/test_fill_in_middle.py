import hashlib
import re

import pytest
from compare import compare
from fixtures import SF, awkward, frame

from graphloom.llm import fill_in_middle as m

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(rows, rate=50, spm_rate=80):
    out = []
    for d, t in rows:
        t = t or ""
        x = hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
        h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
        u = UNIT.findall(t)
        n = len(u)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, q, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
            out.append((d, n, "plain", None, None, t))
        elif h[3] % 100 < spm_rate:
            out.append((d, n, "spm", len(p), len(q), f"<S>{s}<P>{p}<M>{q}"))
        else:
            out.append((d, n, "psm", len(p), len(q), f"<P>{p}<S>{s}<M>{q}"))
    return out


ODD = ["<P", "<P>", "a <S> b", "x<M>", "<", ">", "<<", "< P>", "S><", " lead", "trail ", " both \t", "\x0b\x0c\r", "a b c d", "é", "日本 語 ", "𝄞 x𝄞", "<M", "M>", "a<", ">b <S", "\u0000 \u0000x", "<X>", "P>\n<"]


def cases():
    return [*awkward(), *((200 + i, t) for i, t in enumerate(ODD * 6)), *((-5 - i, "neg ids " * i) for i in range(20))]


@pytest.mark.parametrize("chunk", [1, 50, 4 << 20])
@pytest.mark.parametrize("rate", [50, 100])
def test_against_brute_force(chunk, rate):
    rows = cases()
    texts = m.pa.array([t or "" for _, t in rows], m.pa.large_string())
    hashes = [hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest() for d, _ in rows]
    h = [m.np.array([int(x[8 * k : 8 * k + 8], 16) for x in hashes], m.np.int64) for k in range(4)]
    _, where, _ = texts.buffers()
    got = []
    for lo, hi in m._chunks(m.np.frombuffer(where, m.np.int64)[: len(rows) + 1], chunk):
        found = [x.to_pylist() for x in m.kernel(texts[lo:hi], [x[lo:hi] for x in h], rate)]
        got += [(rows[lo + i][0], *(c[i] for c in found[:4]), found[4][i].decode()) for i in range(hi - lo)]
    assert got == brute(rows, rate)


def test_rows_and_restoring(spark):
    rows = cases()
    found = m.transformed(frame(spark, rows), rate=90, spm_rate=50)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: (str(r[0]), str(r))
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute(rows, 90, 50), key=key)
    back = found.select("doc_id", "form", m.restored(m.F.col("output"), m.F.col("form")).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((d, t or "") for d, t in rows), key=key)
    assert {r.form for r in back} == {"plain", "spm", "psm"}
    assert m.transformed(frame(spark, [])).count() == 0


def test_against_sql(spark):
    assert compare(spark, SF, m.query, m.SQL) > 100
