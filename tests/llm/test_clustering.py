"""Centroid clustering against a plain full search."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from spellwise.llm import clustering


def plain(rows, k, rounds, dims, scale, seed="3"):
    kept = [
        (i, [math.floor(scale * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            cents[j] = [sum(x) // len(g) for x in zip(*g)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found)


def table(spark, rows):
    extra = [(*r, 1, "x", 2, 0.5, "y") for r in rows]
    schema = "vec_id long, embedding array<double>, cluster int, id string, distance long, v double, inertia string"
    return spark.createDataFrame(extra, schema).repartition(3)


@pytest.mark.parametrize(("k", "dims"), [(4, 3), (8, 6), (1, 2)])
def test_equals_a_full_search(spark, k, dims):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(i % 5, 0.6) for _ in range(dims)]) for i in range(150)]
    rows += [(500 + i, [0.25] * dims) for i in range(60)]  # one vector very often, and ties
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, [0.1] * dims), (None, [9.0] * dims)]
    odd = [None, [], [1.0], [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [None] + [1.0] * (dims - 1)]
    odd = [v for v in odd if v is None or len(v) != dims or any(x is None or not math.isfinite(x) for x in v)]
    rows += [(900 + i, v) for i, v in enumerate(odd)]
    got = clustering.cluster(table(spark, rows), k=k, rounds=5, dims=dims, scale=64)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, k, 5, dims, 64)


def test_large_components_few_rows_and_none(spark):
    rows = [(1, [3e6, -2.5]), (2, [-4e5, 1e6]), (3, [0.0, 0.0])]
    got = clustering.cluster(table(spark, rows), k=8, rounds=3, dims=2, scale=1024)
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, 8, 3, 2, 1024)
    assert clustering.cluster(table(spark, []), dims=2).count() == 0
    assert clustering.cluster(table(spark, [(1, None)]), dims=2).count() == 0
    with pytest.raises(Exception, match="too large for a long"):
        clustering.cluster(table(spark, [(1, [1e300, 0.0])]), dims=2).count()


def test_bounds_spare_distances_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(3)
    x = rng.integers(-1000, 1000, (2000, 16))
    x += rng.integers(-40, 40, (2000, 1)) * 100  # means that differ
    centroids = np.vstack([x[:30], x[5:6]])  # the last equals number 5
    search = clustering.Search(centroids)
    which, d = search.nearest(x)
    full = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (which == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert search.distances < 0.6 * full.size
