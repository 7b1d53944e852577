"""Clusters against plain Lloyd's rounds in Python integers."""

import hashlib
import math
import random

import numpy as np

from ledgerloom.llm import delta_lloyd

SCHEMA = "vec_id long, embedding array<float>, x int, owner string"


def plain(rows, k, rounds, dim, seed=2):
    kept = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v]))
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centres = [x for _, x in starts[:k]]
    if not centres:
        return []

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(i, *reversed(nearest(x))) for i, x in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sum(e for _, b, e in out if b == c), sum(e for *_, e in out), sha[c]) for i, c, d in out), key=str)


def found(spark, rows, **options):
    df = delta_lloyd.described(delta_lloyd.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), **options))
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def odd_rows(dim=4, n=150):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25)) + rng.gauss(0, 0.1) for _ in range(dim)], 1, "q") for i in range(n)]
    rows += [(1000 + i, [0.125] * dim, 1, "q") for i in range(80)]  # a third alike
    rows += [rows[3], rows[3], (7, [0.5] * dim, 1, None), (None, [0.1] * dim, 1, None)]
    rows += [(2000, None, 1, None), (2001, [], 1, None), (2002, [0.1] * (dim + 1), 1, None), (2003, [None] + [0.1] * (dim - 1), 1, None), (2004, [math.nan] * dim, 1, None), (2005, [math.inf] + [0.0] * (dim - 1), 1, None), (2006, [0.0] * dim, 1, None)]
    return rows


def test_equals_plain_rounds(spark):
    for k, rounds in ((7, 5), (3, 0), (500, 2)):
        assert found(spark, odd_rows(), k=k, rounds=rounds, dim=4) == plain(odd_rows(), k, rounds, 4)


def test_large_components(spark):
    rows = [(i, [float(x) * 300_000, 3.0 - i]) for i, x in enumerate(np.linspace(-1, 1, 40))]
    rows = [(*r, 1, "q") for r in rows]
    assert found(spark, rows, k=5, rounds=3, dim=2) == plain(rows, 5, 3, 2)
    assert found(spark, [*rows, (99, [1e30, 0.0], 1, "q"), (98, [600_000.0, 0.0], 1, "q")], k=5, rounds=3, dim=2) == plain(rows, 5, 3, 2)


def test_nothing_to_cluster(spark):
    assert found(spark, [], dim=4) == []
    assert found(spark, [(None, [0.1] * 4, 1, None)], dim=4) == []


def test_a_round_compares_what_changed():
    """Two far groups: once the centroids of one stand still, its vectors meet only those that move."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-50, 50, (100, 3)), rng.integers(9950, 10050, (100, 3))])
    centres = np.array([[0, 0, 0], [10_000, 10_000, 10_000], [10_020, 10_000, 10_000]])
    owner, distance, cost = delta_lloyd.assign(x, np.full(200, -1), np.zeros(200, np.int64), centres, np.ones(3, bool))
    assert cost == 600
    after = centres + [[0, 0, 0], [3, 0, 0], [0, 0, 0]]
    moved = np.array([False, True, False])
    own, dist, cost = delta_lloyd.assign(x, owner, distance, after, moved)
    want, far, _ = delta_lloyd.assign(x, np.full(200, -1), np.zeros(200, np.int64), after, np.ones(3, bool))
    assert (own == want).all() and (dist == far).all()
    lost = int((owner == 1).sum())
    assert cost == 3 * lost + (200 - lost) < 600
