import hashlib
import random

import numpy as np
import pytest

from strandline.llm import centroids


def brute(rows, k=8, rounds=10, dims=64):
    """Plain k-means in Python's whole numbers over (id, vector) rows."""
    import math

    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        members = [[] for _ in c]
        for _, v in kept:
            members[near(v)[1]].append(v)
        c = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else old for m, old in zip(members, c, strict=True)]
    found = [(i, near(v)) for i, v in kept]
    inertia = sum(d for _, (d, _) in found)
    own = {j: sum(d for _, (d, y) in found if y == j) for j in range(len(c))}
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, own[j], inertia, names[j]) for i, (d, j) in found), key=str)


def got(found):
    return sorted(map(tuple, centroids.report(found).collect()), key=str)


def frame(spark, rows):
    """With columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, v, 1, 2.0, "s", True) for i, v in rows], "vec_id long, embedding array<float>, cluster int, upper double, sums string, summary boolean")


def single(v):
    return [float(np.float32(x)) for x in v]


def vectors(n, seed, spread=0.2):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [(i, single([x + rng.gauss(0, spread) for x in rng.choice(heads)])) for i in range(n)]


ODD = [
    (1001, None), (1002, []), (1003, [0.5] * 63), (1004, [0.5] * 65), (1005, [float("nan")] * 64), (1006, [float("inf")] + [0.0] * 63), (1007, [None] + [0.0] * 63),
    (1008, [0.0] * 64), (1009, [0.0] * 64), (1009, [0.0] * 64), (None, [0.25] * 64), (1010, [-0.0001] * 64),
]


@pytest.mark.parametrize("spread", [0.05, 0.8])
def test_by_brute_force(spark, spread):
    rows = vectors(300, 3, spread) + ODD + [(2000 + i, single([0.125] * 64)) for i in range(80)]
    found = centroids.clustered(frame(spark, rows).repartition(5), vec_col="embedding")
    assert got(found) == brute(rows)
    plain = 8 * len(brute(rows))
    assert found.scans[0] == plain and sum(found.scans[1:]) < 0.9 * plain * 10, found.scans


def test_ties_copies_and_few_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    half = [(i, [float(i % 2)] * 64) for i in range(41)]
    for rows in (same, half, same[:3], half[:1]):
        assert got(centroids.clustered(frame(spark, rows), vec_col="embedding")) == brute(rows)
    assert got(centroids.clustered(frame(spark, ODD[:7]), vec_col="embedding")) == []
    assert got(centroids.clustered(frame(spark, same).where("false"), vec_col="embedding")) == []


def test_filters_keep_the_exact_result():
    """next_pass against everything scanned, after moves of any size."""
    rng = np.random.default_rng(1)
    for trial in range(60):
        k = int(rng.integers(1, 14))
        x = rng.integers(-40, 40, (200, 5)) * int(rng.integers(1, 4))
        c = x[rng.choice(200, k)].copy()
        group = centroids.grouped(c)
        at, upper, lower, _ = centroids.first_pass(x, c, group)
        for _ in range(6):
            after = c + rng.integers(-3, 4, c.shape) * (rng.random((k, 1)) < 0.6)
            moved = np.sqrt(((after - c) ** 2).sum(axis=1).astype(float))
            c = after
            at, upper, lower, _ = centroids.next_pass(x, at, upper, lower, c, moved, group)
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            assert (at == d.argmin(axis=1)).all(), trial
            assert (upper >= np.sqrt(d[np.arange(200), at]) - 1e-9).all()
            d = np.sqrt(d.astype(float))
            d[np.arange(200), at] = np.inf
            for g in range(group.max() + 1):
                assert (lower[:, g] <= d[:, group == g].min(axis=1) + 1e-9).all()


def test_large_components(spark):
    rows = [(i, [60000.0 * (-1) ** (i + j) + i for j in range(64)]) for i in range(20)]
    assert got(centroids.clustered(frame(spark, rows), vec_col="embedding")) == brute([(i, single(v)) for i, v in rows])
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(frame(spark, [(1, [1e9] * 64)]), vec_col="embedding")
