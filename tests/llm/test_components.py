import random

import numpy as np
import pytest

from graphloom.llm import components as m
from graphloom.llm import quality


def least(pairs):
    """node: the least node it is connected with."""
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for p in pairs if p[0] != p[1] for x in p}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


@pytest.mark.parametrize("one_task", [m.ONE_TASK, 0])
def test_equal_to_union_find(spark, monkeypatch, one_task):
    monkeypatch.setattr(m, "ONE_TASK", one_task)
    r = random.Random(5)
    pairs = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(350)]  # components of all sizes
    pairs += [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)]  # a hub, a path
    pairs += pairs[:50] + [(b, a) for a, b in pairs[:50]] + [(5000, 5000)]
    found = [tuple(x) for x in m.components(edges(spark, pairs)).collect()]
    assert len(found) == len(dict(found))
    assert dict(found) == least(pairs)
    assert m.components(edges(spark, [])).count() == 0


def test_few_edges_leave_a_job_and_a_task_a_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(m, "discard", rounds.append)
    context = spark.sparkContext
    pairs = [(i, i + 1) for i in range(64)]
    e = edges(spark, pairs).coalesce(1)
    context.setJobGroup("components", "components")
    try:
        m.components(e)
        jobs = context.statusTracker().getJobIdsForGroup("components")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = [context.statusTracker().getStageInfo(s) for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds]
    assert len(rounds) > 2 and len(jobs) <= len(rounds) + 2
    assert sum(s.numTasks for s in stages if s) <= len(rounds) + 2 * 4  # the first edges are shuffled once


def test_vocabulary_holds_a_part_of_the_occurrences_at_once(monkeypatch):
    r = np.random.default_rng(3)
    words = [np.unique(r.integers(0, 1 << 32, 300, np.uint32) >> 6 << 6) for _ in range(400)]
    words = [np.unique(np.concatenate((w, r.choice(words[0], 40)))) for w in words]
    y = [(r.random(400) < 0.4).astype(float), np.where(r.random(400) < 0.3, np.nan, (r.random(400) < 0.2).astype(float))]
    whole = [np.zeros(0, np.uint32)]
    for t in y:
        told = np.flatnonzero(~np.isnan(t))
        names, n, z, _ = quality._deviations([words[i] for i in told], t[told])
        whole.append(names[(n >= quality._least(len(told))) & (z >= quality.SCREEN_Z)])
    seen, at_once = [], quality._deviations
    monkeypatch.setattr(quality, "_deviations", lambda w, t: seen.append(sum(map(len, w))) or at_once(w, t))
    found = quality.vocabulary(words, y)
    assert len(found) and np.array_equal(found, np.unique(np.concatenate(whole)))
    assert max(seen) < sum(map(len, words)) / 8
