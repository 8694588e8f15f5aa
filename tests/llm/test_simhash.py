import random

import numpy as np
import pandas as pd
import xxhash
from fixtures import awkward, frame

from graphloom.llm import simhash
from graphloom.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_documents_against_all_pairs(spark):
    rows = awkward()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    least = -(1 << 63)
    fp = [(least if d is None else d, brute_fingerprint(t)) for d, t in rows]
    assert sorted((least if r.doc_id is None else r.doc_id, r.fp & (1 << 64) - 1) for r in got) == sorted(fp)
    # A fingerprint's documents are one class; rows of one doc_id with two texts are two.
    by = classes(range(len(fp)), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i][1] ^ fp[j][1]).bit_count() <= 3])
    first = {c: min(fp[i][0] for i in by if by[i] == c) for c in by.values()}
    want = sorted((fp[i][0], fp[i][1], first[by[i]]) for i in by)
    assert sorted((least if r.doc_id is None else r.doc_id, r.fp & (1 << 64) - 1, least if r.component_id is None else r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_links_reach_what_all_pairs_reach(spark):
    r = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(150):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, 5)):
            for i in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << i
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64)
    made = simhash.links(spark.createDataFrame(pd.DataFrame({"fp": signed})), len(fps))
    pairs = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in made.collect()]
    want = classes(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    assert classes(fps, pairs) == want
    assert len(set(want.values())) < len(fps) - 100


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
