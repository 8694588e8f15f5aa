import random
import re
from collections import Counter

import pytest
from compare import compare
from fixtures import awkward

from graphloom.llm import collocations as m


def brute(rows, least, max_words=5, share=100, top=2000):
    """rows: (text, lang)"""
    sizes, f = Counter(), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            f.update((lang, tuple(w[i : i + n])) for n in range(1, max_words + 1) for i in range(len(w) - n + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        held = any(x[0] == lang and len(x[1]) > len(p) and 100 * b >= share * a and any(x[1][i : i + len(p)] == p for i in range(len(x[1]) - len(p) + 1)) for x, b in cand.items())
        if not held:
            cuts = [(1000 * a * sizes[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], sizes[lang]))
    return sorted((lang, i, p.decode(), -a, x, y, n, -s) for lang, found in out.items() for i, (s, a, p, x, y, n) in enumerate(sorted(found)[:top], 1))


def cases():
    r = random.Random(5)
    rows = [(t, ("en", "de", None, "", "und")[i % 5]) for i, (_, t) in enumerate(awkward())]
    idioms = ["a b c d e f g", "New York City", "x x x x x x", "é 日本 ž", "of the", "tab\tand  two"]
    for i in range(300):
        words = [r.choice(idioms) if r.random() < 0.3 else r.choice(["one", "Two", "three", "é", "of", "the", "x"]) for _ in range(r.randint(0, 12))]
        rows.append((r.choice([" ", ", ", "  \t", " .\n", "\x0b"]).join(words), r.choice(["en", "en", "en", "de", None])))
    return [*rows, (" ".join(["long"] * 700), "en"), (None, None), ("", None), (" , ;", "fr")]


KIND = "lang string, doc_id long, text string, words string, phrase string, slot string, a string, n string"


@pytest.mark.parametrize(("least", "max_words", "share", "top", "part"), [(3, 5, 100, 2000, 10_000), (12, 5, 60, 40, 7), (2, 3, 100, 10, 64), (5, 2, 100, 2000, 1)])
def test_against_brute_force(spark, monkeypatch, least, max_words, share, top, part):
    monkeypatch.setattr(m, "PIECE_WORDS", part)
    monkeypatch.setattr(m, "SLOTS", 64 if part == 7 else 1 << 20)  # full slots prune nothing, and change nothing
    rows = cases()
    docs = spark.createDataFrame([(lang, i, t, "w", "p", "s", "a", "n") for i, (t, lang) in enumerate(rows)], KIND)
    got = sorted(map(tuple, m.collocations(docs, least, max_words, share, top).collect()))
    want = brute(rows, least, max_words, share, top)
    assert got == want and len(want) > 15


def test_tables_of_a_run(spark, monkeypatch):
    """Words are counted at once, and what was frequent is told to both parts of a phrase by one table."""
    written, cut = [], m.cut
    monkeypatch.setattr(m, "cut", lambda df, name: written.append(name) or cut(df, name))
    docs = spark.createDataFrame([("Éa b\t c  d e f, ÉA B ẞ İ A\u0130",)] * 3 + [("ÉA É\u00a0B",), (" , A\t",)], "text string").selectExpr("text", "'en' as lang")
    got = sorted(map(tuple, m.collocations(docs, 2).collect()))
    assert got == brute([(r.text, r.lang) for r in docs.collect()], 2) and len(got) > 3
    assert (written.count("codes"), written.count("slots")) == (2, 8)


def test_large_numbers_and_no_rows(spark):
    assert m.collocations(spark.createDataFrame([], "text string, lang string"), 1).count() == 0
    assert m.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string"), 2).count() == 0
    n, a, b, c = 90_000_000_000_000_007, 8_000_000_000_000_001, 9_000_000_000_000_003, 9_000_000_000_000_011
    one = spark.createDataFrame([("en", "p q", 2, a)], "lang string, phrase string, m int, a long")
    counts = spark.createDataFrame([("en", "p", b), ("en", "q", c)], "lang string, phrase string, f long")
    got = m._cut_scores(one, counts, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert got.score == 1000 * a * n // (b * c)


def test_against_sql(spark):
    assert compare(spark, "/root/testdata/sf0.01", m.query, m.SQL) > 50
