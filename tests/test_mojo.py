"""MoJo against a search over all clusterings, matchings against brute force."""

import random
from collections import deque
from itertools import permutations

from loomwork.operators import mojo


def clusterings(n):
    """All clusterings of n elements, as tuples of cluster numbers in order of appearance."""
    out = [()]
    for _ in range(n):
        out = [(*p, k) for p in out for k in range(max(p, default=-1) + 2)]
    return out


def canon(p):
    seen = {}
    return tuple(seen.setdefault(x, len(seen)) for x in p)


def steps(p):
    for i in range(len(p)):
        for k in range(max(p) + 2):
            yield canon((*p[:i], k, *p[i + 1 :]))
    for x in set(p):
        for y in set(p):
            if x < y:
                yield canon([x if v == y else v for v in p])


def distances(start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        p = queue.popleft()
        for q in steps(p):
            if q not in seen:
                seen[q] = seen[p] + 1
                queue.append(q)
    return seen


def test_mojo_is_the_shortest_way(spark):
    rng, every = random.Random(2), clusterings(5)
    far = {p: distances(p) for p in every}
    picked = [(rng.choice(every), rng.choice(every)) for _ in range(6)] + [((0, 0, 1, 1, 2), (0, 1, 0, 1, 1)), (every[0], every[-1]), (every[-1], every[-1])]
    for a, b in picked:
        r = mojo.mojofm(spark.createDataFrame([(x, f"g{y}") for x, y in zip(a, b, strict=True)] + [(None, "g0")], "x int, y string"), "x", "y").first()
        worst = max(far[p][b] for p in every)
        assert (r.n, r.mojo, r.moves + r.joins) == (5, far[a][b], far[a][b])
        assert abs(r.mojofm - (100.0 if not worst else (1 - far[a][b] / worst) * 100)) < 1e-9


def brute(edges):
    left, best = sorted({a for a, _ in edges}), 0
    right = sorted({b for _, b in edges})
    held = set(edges)
    small, large, ok = (left, right, lambda x, y: (x, y) in held) if len(left) <= len(right) else (right, left, lambda x, y: (y, x) in held)
    for p in permutations(large, len(small)):
        best = max(best, sum(ok(x, y) for x, y in zip(small, p, strict=True)))
    return best


def test_matching(spark):
    rng = random.Random(9)
    for n in (4, 8, 12):
        edges = sorted({(rng.randrange(5), rng.randrange(6)) for _ in range(n)})
        assert mojo.augment(edges) == brute(edges)
        assert mojo.matching_size(spark.createDataFrame(edges, "a long, b long").repartition(3)) == brute(edges)
    ring = [(i, (i + d) % 5) for i in range(5) for d in (0, 1)]  # nothing of degree one
    far = [(i + 10, j + 10) for i, j in ring] + [(99, 99)]
    assert mojo.matching_size(spark.createDataFrame(ring + far, "a long, b long")) == 11
    assert mojo.matching_size(spark.createDataFrame([], "a long, b long")) == 0
