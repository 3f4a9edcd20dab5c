"""Lloyd's rounds against plain Python whole numbers."""

import hashlib
import math
import random

import pytest

from tracelake.llm import lloyd


def plain(rows, k=40, rounds=5, dim=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, of) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    of = assign()
    inertia = {}
    for far, j in of:
        inertia[j] = inertia.get(j, 0) + far
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, far, inertia[j], sum(inertia.values()), names[j]) for (i, _), (far, j) in zip(kept, of)), key=repr)


def vectors(seed, n, dim):
    draw = random.Random(seed)
    centers = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    return [(i, [x + draw.gauss(0, 0.3) for x in centers[draw.randrange(7)]]) for i in range(n)]


@pytest.mark.parametrize(("n", "k"), [(300, 40), (60, 9), (5, 40)])
def test_rounds(spark, n, k):
    rows = vectors(n, n, 8)
    rows += [(1000, rows[0][1])] * 40 + [(1001, None), (1002, [1.0] * 7), (1003, [1.0] * 9), (1004, [None] + [1.0] * 7), (1005, [float("nan")] * 8), (1006, [float("-inf")] * 8), (1007, []), (None, rows[1][1]), (2**60 + 1, rows[2][1])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    got = sorted(map(tuple, lloyd.report(df, k=k, dim=8).collect()), key=repr)
    assert got == plain(rows, k=k, dim=8)


def test_empty_clusters_and_ties(spark):
    """Equal starts leave later ones empty; they keep their place, and ties go to the lower number."""
    rows = [(i, [float(i % 3)] * 2) for i in range(30)]
    got = sorted(map(tuple, lloyd.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=12, dim=2).collect()), key=repr)
    assert got == plain(rows, k=12, dim=2) and len({r[1] for r in got}) == 3


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lloyd.report(empty).count() == 0
    huge = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="scaled component"):
        lloyd.report(huge, dim=2).collect()
