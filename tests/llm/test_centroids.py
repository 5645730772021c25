import hashlib
import random

import numpy as np
import pytest

from siftwork.llm import centroids
from siftwork.llm.whole import squares

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, seed, dim, scale=1024):
    """vec_id -> (cluster, distance) and centroids, by plain Python."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(float(np.float32(x)) * scale)) for x in v]))

    def place(r):
        return (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])

    z = [list(q) for _, q in sorted(kept, key=place)[:k]]

    def nearest(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in z]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[0], []).append(q)
        for c, qs in groups.items():
            z[c] = [sum(col) // len(qs) for col in zip(*qs)]
    return [(i, *nearest(q)) for i, q in kept], z


def made(rng, n, dim):
    centers = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        rows.append((i, [x + rng.gauss(0, 0.1) for x in c]))
    rows += [(n + i, list(rows[0][1])) for i in range(40)]  # copies
    rows += [(7, list(rows[1][1])), (7, list(rows[1][1])), (None, list(rows[2][1])), (9000, [1e30] * dim)]
    return rows


ODD = [(800, None), (801, [0.1]), (802, []), (803, [float("nan")] * 4), (804, [None, 0.0, 0.0, 0.0]), (805, [float("inf"), 0.0, 0.0, 0.0])]


@pytest.mark.parametrize(("k", "block", "leaf"), [(5, 64, 4), (8, 4096, 16), (3, 7, 1)])
def test_like_brute_force(spark, k, block, leaf):
    rows = made(random.Random(k), 200, 4)[:-1]
    rows += ODD
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = centroids.cluster(frame, k=k, rounds=4, seed="s", dim=4, block=block, leaf=leaf).collect()
    want, z = brute(rows, k, 4, "s", 4)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got) == sorted((i is None, i or 0, c, d) for i, c, d in want)
    inertia = {}
    for _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, z[r.cluster])).encode()).hexdigest()


def test_few_rows_and_other_columns(spark):
    schema = "vec_id long, embedding array<float>, cluster string, n int, q string, ids int"
    rows = [(1, [0.5] * 64, "x", 1, "q", 0), (2, [0.5] * 64, "y", 2, "q", 0)]
    got = centroids.cluster(spark.createDataFrame(rows, schema)).collect()
    # Equal centroids: the smaller number takes all.
    assert {(r.vec_id, r.cluster, r.distance) for r in got} == {(1, 0, 0), (2, 0, 0)}
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None, "x", 1, "q", 0)], schema)).collect() == []


def test_whole_balls_are_taken():
    """Of three distant groups nearly all points come in balls, with the sums that points would give."""
    rng = np.random.default_rng(1)
    q = np.concatenate([rng.integers(-20, 20, (1000, 8)) + 1000 * c for c in range(3)])
    z = np.array([[0] * 8, [1010] * 8, [1990] * 8, [0] * 8])
    order, t = centroids.balls(q)
    assert sorted(order.tolist()) == list(range(3000))
    count, total, own, whole = centroids.assign(t, z)
    near = squares(q[order], z).argmin(axis=1)
    assert (own == near).all()
    assert count.tolist() == [1000, 1000, 1000, 0]
    assert (total[1] == q[1000:2000].sum(axis=0)).all()
    assert whole > 2900
    for i in range(len(t.first)):
        inside = t.q[t.lo[i] : t.hi[i]]
        assert (t.sum[i] == inside.sum(axis=0)).all()
        assert np.sqrt(squares(inside, t.center[i][None])).max() <= t.radius[i]


def test_large_numbers_are_exact():
    a = np.array([[1 << 27] * 64, [-(1 << 27)] * 64])
    assert squares(a, a)[0, 1] == 64 << 56
    assert squares(a[:1], a[:1] - 1)[0, 0] == 64


def test_equal_distances_go_to_the_smaller_number():
    q = np.array([[0, 0], [10, 0], [5, 0], [5, 0]])
    order, t = centroids.balls(q, leaf=1)
    own = centroids.assign(t, np.array([[10, 0], [0, 0]]))[2]
    assert dict(zip(order.tolist(), own.tolist())) == {0: 1, 1: 0, 2: 0, 3: 0}
