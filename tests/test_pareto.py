"""Fronts, crowding and trimming against brute force."""

import random

import numpy as np
import pytest

from loomwork.operators import pareto

WAY = {"a": "min", "b": "max", "c": "min"}


def peeled(rows):
    """Front by front: {id: front}; a missing value is the worst."""
    inf = float("inf")
    turned = {i: tuple(inf if v is None else v * s for v, s in zip(x, (1, -1, 1), strict=True)) for i, *x in rows}
    beats = lambda p, q: all(u <= v for u, v in zip(p, q, strict=True)) and p != q
    out, k = {}, 0
    while turned:
        k += 1
        front = [i for i, p in turned.items() if not any(beats(q, p) for q in turned.values())]
        for i in front:
            out[i] = k
            del turned[i]
    return out


@pytest.mark.parametrize(("local", "merge"), [(25_000, 50_000), (40, 60), (30, 2)])
def test_fronts_equal_peeling(spark, monkeypatch, local, merge):
    monkeypatch.setattr(pareto, "LOCAL", local)
    monkeypatch.setattr(pareto, "MERGE", merge)
    rng = random.Random(6)
    rows = [(i, float(rng.randint(0, 12)), float(rng.randint(0, 12)), None if i == 3 else rng.random()) for i in range(150 if merge > 2 else 60)]
    rows += [(1000, *rows[0][1:]), (1001, *rows[0][1:])]  # equal points
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    assert {r.id: r.front for r in pareto.fronts(df, WAY).collect()} == peeled(rows)
    assert pareto.fronts(df.limit(0), WAY).count() == 0


def test_ranks_of_many_points():
    x = np.random.default_rng(2).random((3000, 3))
    got = pareto.ranks(x)
    want, left, k = np.zeros(3000, int), np.arange(3000), 0
    while len(left):
        k += 1
        p = x[left]
        free = np.array([not ((p <= q).all(axis=1) & (p < q).any(axis=1)).any() for q in p])
        want[left[free]], left = k, left[~free]
    assert (got == want).all()


def test_trim_fills_by_front_then_room(spark):
    rows = [(1, 0.0, 9.0), (2, 1.0, 8.0), (3, 4.0, 5.0), (4, 9.0, 0.0), (5, 2.0, 9.0), (6, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = [(r.id, r.front, r.crowding) for r in pareto.trim(df, {"a": "min", "b": "min"}, 4).collect()]
    inf = float("inf")
    assert got == [(1, 1, inf), (4, 1, inf), (3, 1, 16.0), (2, 1, 8.0)]
    assert [r.id for r in pareto.trim(df, {"a": "min", "b": "min"}, 3).collect()] == [1, 4, 3]
