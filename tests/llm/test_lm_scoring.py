import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import SF, awkward, frame

from graphloom.llm import lm_scoring as m


class Tree:
    """Context-tree weighting, one tree of dictionaries, exact products in logarithms."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            for context, u, bit in self.decisions(t):
                for d in range(depth + 1):
                    self.n[u, context[:d]][bit] += 1
        self.longer = defaultdict(list)
        for u, c in self.n:
            if c:
                self.longer[u, c[:-1]].append((u, c))

    def decisions(self, t):
        t = bytes(self.depth) + t + b"\0"
        for i in range(self.depth, len(t)):
            u = 1
            for k in range(7, -1, -1):
                bit = t[i] >> k & 1
                yield t[i - self.depth : i][::-1], u, bit
                u = u << 1 | bit

    def own(self, node):
        a, b = self.n[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node):
        if len(node[1]) == self.depth:
            return self.own(node)
        x, y = self.own(node), sum(self.weighted(c) for c in self.longer[node])
        return max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)

    def p(self, u, context, bit, d=0):
        node = (u, context[:d])
        if node not in self.n:
            return 0.5
        a, b = self.n[node]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        w = math.exp(self.own(node) - math.log(2) - self.weighted(node))
        return w * own + (1 - w) * self.p(u, context, bit, d + 1)

    def score(self, t):
        return sum(math.log10(self.p(u, c, bit)) for c, u, bit in self.decisions(t))


def built(texts, depth):
    c = np.concatenate([x for x, _, _ in m.chunks(texts, depth, 37)])
    nodes, top = m.subtrees(*np.unique(c, return_counts=True), depth)
    return m.Model(top, {d: x[:3] for d, x in nodes.items()}, depth)


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_against_a_tree_of_dictionaries(depth):
    r = random.Random(depth)
    texts = ["".join(r.choice(["ab", "abc", " ", "é", "ca"]) for _ in range(r.randint(0, 12))).encode() for _ in range(12)]
    tree, model = Tree(texts, depth), built(texts, depth)
    for t in [*texts[:4], b"", b"zzz abca", b"\0ab"]:
        assert m.log10_probabilities(model, [t])[0] == pytest.approx(tree.score(t), rel=1e-5)


def test_probabilities_sum_to_one():
    model = built([b"the cat sat on the mat", b"a cat"], 3)
    for context in (0, 0x746865, 0x7A7A7A):
        codes = np.uint64(context << 8) | np.arange(256, dtype=np.uint64)
        assert (10 ** model.log10(codes)).sum() == pytest.approx(1, rel=1e-5)


def test_long_texts_go_in_parts():
    t = [b"", b"abc" * 50, b"x", b"hello world " * 9]
    model = built([b"abc hello", b"world"], 5)
    whole = m.log10_probabilities(model, t)
    parts = np.zeros(4)
    for codes, starts, docs in m.chunks(t, 5, 17):
        np.add.at(parts, docs, np.add.reduceat(model.score(codes), starts))
    assert np.allclose(whole, parts)


def base(rows):
    low = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) if w] + [None]
    c = Counter(w for d, t in rows if not m.held_out(d) for w in low(t))
    n, v = sum(c.values()), len(c)
    return [(d, m.held_out(d), len(low(t)), sum(c[w] > 0 for w in low(t)), n, round(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in low(t)), 6)) for d, t in rows]


@pytest.mark.parametrize("head", [3, 200_000])
def test_baseline_against_brute_force(spark, head):
    rows = awkward()
    got = m.scores(frame(spark, rows), head_words=head).collect()
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(found, key=str) == sorted(base(rows), key=str)
    texts = [t.lower().encode() if t and t.isascii() else None for _, t in rows]
    model = built([re.sub("[A-Z]", lambda x: x[0].lower(), t or "").encode() for d, t in rows if not m.held_out(d)], m.DEPTH)
    want = {(d, len(t)): s for (d, _), t, s in zip(rows, texts, m.log10_probabilities(model, [t or b"" for t in texts])) if t}
    for r in got:
        if (r.doc_id, round(r.score / -r.bits_per_byte / math.log10(2))) in want:
            assert r.score == pytest.approx(want[r.doc_id, round(r.score / -r.bits_per_byte / math.log10(2))], rel=1e-4)


def test_empty_and_untrained(spark):
    assert m.scores(frame(spark, [])).count() == 0
    out = next(i for i in range(100) if m.held_out(i))
    (r,) = m.scores(frame(spark, [(out, "ab c")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert r.score == pytest.approx(8 * 5 * math.log10(0.5))


@pytest.mark.parametrize("most", [0, 40, 1 << 20])
def test_scores_of_tables_against_a_tree_of_dictionaries(spark, most):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "cat", "cats", "sat", "é", "zq"]) for _ in range(r.randint(0, 25)))) for i in range(40)]
    tree = Tree([t.encode() for d, t in rows if not m.held_out(d)], m.DEPTH)
    got = {x.doc_id: x.score for x in m.scores(frame(spark, rows), max_nodes=most).collect()}
    assert got == pytest.approx({d: tree.score(t.encode()) for d, t in rows}, rel=1e-5)


def test_held_out_code_length(spark):
    got = [r for r in m.query(spark, SF).collect() if r.held_out]
    bits = sum(-r.score for r in got) / math.log10(2) / sum(r.score / -r.bits_per_byte / math.log10(2) for r in got)
    assert bits < 3.2  # 8 untrained


def test_scores_do_not_depend_on_what_is_broadcast(spark):
    rows = [(i, t) for i, (_, t) in enumerate(awkward()) if t and t.isascii()]
    tree = built([t.lower().encode() for d, t in rows if not m.held_out(d)], m.DEPTH)
    want = dict(zip([d for d, _ in rows], m.log10_probabilities(tree, [t.lower().encode() for _, t in rows]), strict=True))
    for most in (0, 500, m.MAX_NODES):
        got = {r.doc_id: r.score for r in m.scores(frame(spark, rows), max_nodes=most).collect()}
        assert got == pytest.approx(want, rel=1e-5)
