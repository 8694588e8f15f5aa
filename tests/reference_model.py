"""Sequential models of what the graph operators compute."""

from __future__ import annotations

import random


def strong(n: int, edges: list[tuple[int, int]]) -> dict[int, int]:
    """Vertex to the smallest id of its strong component, by two depth-first searches."""
    out, back = {v: [] for v in range(1, n + 1)}, {v: [] for v in range(1, n + 1)}
    for a, b in edges:
        out[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for s in out:
        stack = [(s, iter(out[s]))] if s not in seen else []
        seen.add(s)
        while stack:
            v, following = stack[-1]
            w = next((x for x in following if x not in seen), None)
            if w is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(out[w])))
    comp: dict[int, int] = {}
    for s in reversed(order):
        if s in comp:
            continue
        members, stack = [], [s]
        comp[s] = s
        while stack:
            v = stack.pop()
            members.append(v)
            for w in back[v]:
                if w not in comp:
                    comp[w] = s
                    stack.append(w)
        for v in members:
            comp[v] = min(members)
    return comp


def reachable(n: int, edges: list[tuple[int, int]], s: int) -> set[int]:
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    seen, stack = {s}, [s]
    while stack:
        for w in out.get(stack.pop(), []):
            if w not in seen:
                seen.add(w)
                stack.append(w)
    return seen


def random_graph(r: random.Random, n: int, m: int) -> list[tuple[int, int]]:
    return [(r.randint(1, n), r.randint(1, n)) for _ in range(m)]
