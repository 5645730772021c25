import numpy as np
import pytest

from siftwork.llm import embeddings
from siftwork.llm.covertree import Tree, close_leaves


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 0, 1, 2):
        for _ in range(12):
            base = rng.normal(size=8)
            for _ in range(rng.integers(1, 5)):
                rows.append((k, (base + rng.normal(size=8) * rng.choice([0, 0.05, 0.2])).tolist(), label))
                k += 1
    rows += [(k, None, 0), (k + 1, [0.0] * 8, 0), (k + 2, [float("nan")] * 8, 0), (k + 3, [1.0, None] * 4, 0), (k + 4, [float("inf")] * 8, 1), (k + 5, [1e200] * 8, 1), (k + 6, [1e200] * 8, 1), (k + 7, [1.0] * 8, None), (k + 8, [1.0] * 8, None), (k + 9, [1.0, 2.0], 0), (k + 10, [], 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("vec_id", "embedding", "label", "1 as v", "2 as rep")


@pytest.mark.parametrize("block", [2048, 5])
def test_near_duplicates(spark, block):
    rows = vectors()
    good = [(i, np.array(v), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links: dict[int, set] = {i: set() for i, *_ in rows}
    for i, v, y in good:
        for j, w, z in good:
            if i != j and y == z and len(v) == len(w):
                a, b = v / abs(v).max(), w / abs(w).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links[i].add(j)
    root = {i: i for i in links}
    for _ in links:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in links}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame(spark, rows), block=block).collect()}
    assert got == {i: (len(links[i]), root[i], root[i] == i) for i in links}


def clustered(n=400, dim=6, seed=2):
    """Vectors in tight clusters far apart."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(k, (centres[k % 8] * (1 + k % 3) + rng.normal(size=dim) * 0.01).tolist(), 0) for k in range(n)]


def brute_links(rows):
    unit = [(i, np.array(v) / np.linalg.norm(v)) for i, v, _ in rows]
    return {i: sum(j != i and float(a @ b) >= 0.93 for j, b in unit) for i, a in unit}


def test_cells_spare_pairs(spark):
    rows = clustered()
    table = frame(spark, rows)
    good = embeddings.usable(table, True).selectExpr("label", "size(v) as n_dim", "vec_id", "v")
    cells = embeddings.Cells(good, ["label", "n_dim"], "vec_id", 50, embeddings._unit, lambda x, p, cell, far: np.eye(len(p), dtype=bool))
    sized = cells.dealt().groupBy("label", "n_dim", "cell").agg(embeddings.F.count("*").alias("n"), embeddings.F.max("far").alias("radius"))
    kept = embeddings.close_cells(sized, cells, 0.37, 50)
    met = sum(units * sum(u for _, u in others) for *_, units, others in kept)
    assert 0 < met < 30  # 64 and more without cells
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table, block=50).collect()}
    assert got == brute_links(rows)


def test_cells_of_searches(spark, monkeypatch):
    rows = [(k, ((np.arange(6) == k % 6) * 3.0 + 0.01 * np.sin(k * np.arange(1, 7))).tolist(), 0) for k in range(600)]
    used = []
    inner = embeddings._search_cells
    monkeypatch.setattr(embeddings, "_search_cells", lambda *a: used.append(1) or inner(*a))
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in embeddings.top_k(frame(spark, rows), data_block=100).collect()}
    assert got == brute_top(rows) and used


def test_tiny_and_huge_vectors(spark):
    rows = [(0, [1e-200, 1e-200], 0), (1, [1e-200, 1.01e-200], 0), (2, [1e200, 1e200], 0), (3, [1e200, 1.01e200], 0), (4, [1e300, -1e300], 0), (5, [5e-324, 0.0], 1), (6, [1.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(frame(spark, rows)).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def brute_top(rows, k=20):
    def whole(v):
        return [int(x) * 64 if abs(x) > 2**53 else int(np.floor(64 * x)) for x in v]

    good = [(i, whole(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    want, clip = set(), (1 << 63) - 1
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-max(-clip, min(clip, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in good if i != q and len(w) == len(v))[:k]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return want


def large(seed, size):
    rng = np.random.default_rng(seed)
    return [(k, (rng.normal(size=64) * size).tolist(), 0) for k in range(60)]


@pytest.mark.parametrize(
    "rows",
    [
        [*vectors(), (2000, [0.5] * 8, 1), (2020, [0.5] * 8, 1), (2040, [4e7] * 8, 1), (2041, [-4e7] * 8, 1)],
        clustered(),
        large(1, 2e6),
        large(2, 1e9),
        large(3, 1e200),
        [(k, (np.array(v) * 10.0 ** (7 * (k % 40))).tolist(), y) for k, v, y in large(4, 1)],
        [(k, [(-1.0) ** k * 1e160, 1.0 + k], 0) for k in range(50)],
    ],
)
@pytest.mark.parametrize("block", [8192, 40])
def test_top_k(spark, rows, block):
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in embeddings.top_k(frame(spark, rows), data_block=block).collect()}
    assert got == brute_top(rows)


def test_repeated_ids(spark):
    rows = [(k % 30, [float(k % 7), float(k // 30)], 0) for k in range(120)]
    want = set()
    for q in (0, 20):
        scored = sorted({(-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w, strict=True)), i) for p, v, _ in rows if p == q for i, w, _ in rows if i != q})[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in embeddings.top_k(frame(spark, rows), data_block=25).collect()]
    assert set(got) == want and len(got) == 40


def test_empty(spark):
    none = frame(spark, [])
    assert embeddings.near_duplicates(none).count() == 0 == embeddings.top_k(none).count()
    odd = frame(spark, [(None, [1.0] * 8, 1), (3, [1.0] * 8, 1), (3, [1.0] * 8, 1)])
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in embeddings.near_duplicates(odd).collect()) == [(-1, 0, None), (3, 1, 3), (3, 1, 3)]


def test_pruning_loses_no_pair():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(40, 3)) * s + rng.normal(size=3) for s in (0.01, 0.1, 0.5, 1, 2)])
    tree = Tree(x, leaf=3)
    met = set()
    for a, b in close_leaves(tree, tree, 0.3):
        met |= {frozenset((i, j)) for i in a.tolist() for j in b.tolist()}
    near = {frozenset((i, j)) for i in range(len(x)) for j in range(i) if np.linalg.norm(x[i] - x[j]) <= 0.3}
    assert near <= met and len(met) < len(x) ** 2 / 3
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for k in range(len(tree.center)):
        d = np.linalg.norm(x[tree.points(k)] - x[tree.center[k]], axis=1)
        assert tree.center[k] in tree.points(k) and d.max() <= tree.radius[k] + 1e-9
