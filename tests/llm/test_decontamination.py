import random

import numpy as np
from fixtures import SF, awkward, frame

from graphloom.llm import decontamination as m


def distance_to_nearest(pattern, text):
    """Sellers' table, row by row."""
    row, best = [0] * (len(text) + 1), len(pattern)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(best, *row)


def test_nearest_against_table():
    r = random.Random(1)
    for _ in range(400):
        p, t = [[r.randint(0, 3) for _ in range(r.randint(1, 12))] for _ in range(2)]
        far, a, b = m.closest(p, t)
        assert far == distance_to_nearest(p, t)
        if far < len(p):
            assert m.nearest(p, t[a:b], anchored=True)[-1] == far


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        kind, at = r.randint(0, 2), r.randrange(len(words))
        if kind == 0:
            words[at] = f"new{r.random()}"
        elif kind == 1:
            words.insert(at, f"more{r.random()}")
        elif len(words) > 2:
            del words[at]
    return words


def cases(r, n_items=40):
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 60)))) for i in range(n_items)]
    docs = []
    for k in range(200):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        if k % 2:
            own = items[r.randrange(n_items)][1].split()
            at = r.randint(0, len(words))
            words[at:at] = edited(r, own, r.randint(0, len(own) // 5 + 1))
        docs.append((1000 + k, ", ".join(words).upper() if k % 3 else " ".join(words)))
    return items, docs


def brute(items, docs):
    out = []
    for d, t in docs:
        w = m.word_hashes(t or "")
        for i, x in items:
            p = m.word_hashes(x or "")
            if p and w and (far := distance_to_nearest(p, w)) <= len(p) // 5:
                out.append((d, i, far))
    return sorted(out, key=str)


def test_documents_against_brute_force(spark):
    items, docs = cases(random.Random(2))
    docs += awkward()
    table = spark.createDataFrame([(*x, 1) for x in [*items, (None, None), (900, items[0][1]), (901, "")]], "item_id long, text string, doc_key int")
    got = m.contaminated(frame(spark, docs), table).collect()
    want = brute([*items, (900, items[0][1])], docs)
    found = sorted([(r.doc_id, r.item_id, r.distance) for r in got], key=str)
    assert set(found) <= set(want)  # what is reported is right
    assert len(found) >= 0.98 * len(want) and len(want) > 50  # and next to nothing is missed
    by = dict(docs)
    assert all(r.start < r.end <= len(by[r.doc_id]) for r in got)
    assert m.contaminated(frame(spark, []), table).count() == 0
    assert m.contaminated(frame(spark, docs), table.limit(0)).count() == 0


def test_short_items_are_found_word_for_word(spark):
    docs = [(1, "See the Golden Gate bridge"), (2, "golden gates"), (3, None), (4, "the golden, gate")]
    items = spark.createDataFrame([(1, "golden gate"), (2, "bridge"), (3, "..."), (4, "a b c d e f")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.n_words, r.start, r.end) for r in m.contaminated(frame(spark, docs), items).collect()}
    assert got == {(1, 1, 0, 2, 8, 19), (1, 2, 0, 1, 20, 26), (4, 1, 0, 2, 4, 16)}
    assert m.clean(frame(spark, docs), items).count() == 4
    assert {r.doc_id for r in m.clean(frame(spark, docs), items, least_words=2).collect()} == {2, 3}


def test_recall_at_the_most_edits():
    r = random.Random(3)
    items, _ = cases(r, 60)
    items = [x for x in items if len(x[1].split()) >= m.MIN_WORDS]
    index = m.Index(items)
    texts, want = [], []
    for i, x in items * 10:
        own = x.split()
        texts.append(" ".join(["before"] * r.randint(0, 9) + edited(r, own, len(own) // 5) + ["after"] * r.randint(0, 9)))
        want.append(next(k for k, y in enumerate(items) if y[0] == i))
    found = {(d, k) for d, k, *_ in index.search(texts)}
    true = [(d, k) for d, k in enumerate(want) if distance_to_nearest(m.word_hashes(items[k][1]), m.word_hashes(texts[d])) <= len(items[k][1].split()) // 5]
    assert np.mean([x in found for x in true]) >= 0.97


def test_blocks(spark):
    table = spark.createDataFrame([(i, "w " * 50) for i in range(10)], "item_id long, text string")
    assert [len(b) for b in m.item_blocks(table, "item_id", "text", 250)] == [2] * 5


def test_query(spark):
    assert m.query(spark, SF).count() > 0
