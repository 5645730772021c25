import hashlib
import random

import numpy as np

from siftwork.llm import codes
from siftwork.llm.whole import whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, dim, parts, entries, rounds, scale=1024):
    kept = []
    for vec_id, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(float(np.float32(x)) * scale)) for x in v], label))
    w = dim // parts
    fit = [r for r in kept if len(r[1]) == dim]
    first = sorted(fit, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]

    def nearest(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, q, _ in fit:
                groups.setdefault(nearest(p, q[p * w : p * w + w])[0], []).append(q[p * w : p * w + w])
            new = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
            books[p] = new
    out, by_label = [], {}
    for vec_id, q, label in kept:
        found = [nearest(p, q[p * w : p * w + w]) for p in range(parts)] if len(q) == dim else None
        error = sum(d for _, d in found) if found else None
        by_label[label] = by_label.get(label, 0) + (error or 0)
        out.append((vec_id, "".join(f"{c:02x}" for c, _ in found) if found else None, error, label))
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(repr((i, c, e, by_label[label], digest)) for i, c, e, label in out)


def rows_of(frame, **options):
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in codes.compress(frame, **options).collect())


def test_like_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([0, 1, None])) for i in range(150)]
    rows += [(200 + i, list(rows[0][1]), 1) for i in range(40)]  # copies
    rows += [(3, list(rows[9][1]), 0), (3, list(rows[3][1]), 0), (None, [0.5] * 8, 2)]
    rows += [(300, None, 0), (301, [0.1], 0), (302, [], None), (303, [float("nan")] * 8, 0), (304, [None] * 8, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for parts, entries, rounds in ((4, 16, 4), (2, 256, 3), (1, 5, 0)):
        assert rows_of(frame, dim=8, parts=parts, entries=entries, rounds=rounds) == brute(rows, 8, parts, entries, rounds)


def test_only_changed_parts_are_shuffled(spark):
    """After the first round changes name just the parts that moved, plus and minus."""
    rng = random.Random(2)
    frame = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(60)], SCHEMA)
    state = whole_vectors(frame).selectExpr("*", "cast(null as array<int>) code")
    books = np.array([r.q for r in state.orderBy("vec_id").limit(8).collect()]).reshape(8, 2, 2).transpose(1, 0, 2)
    one = codes.assign(state, books).checkpoint()
    assert sum(r.n for r in codes.changes(one, 2, 2).collect()) == 2 * 60
    assert codes.changes(codes.assign(one, books), 2, 2).collect() == []
    moved = books.copy()
    moved[1, 0] += 300
    two = codes.assign(one, moved).checkpoint()
    pairs = [(r.was[p], r.code[p]) for r in two.collect() for p in range(2) if r.was[p] != r.code[p]]
    assert pairs
    got = {(r.part, r.entry): r.n for r in codes.changes(two, 2, 2).collect() if r.n}
    want = {}
    for a, b in pairs:
        want[1, a], want[1, b] = want.get((1, a), 0) - 1, want.get((1, b), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_empty_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, error int, was int, q string, entry int, part int"
    assert codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 1, "c", 1, 1, "q", 1, 1)], schema)).collect() == []
    (r,) = codes.compress(spark.createDataFrame([(1, [0.25] * 64, 1, "c", 1, 1, "q", 1, 1)], schema)).collect()
    assert (r.vec_id, r.code, r.error, r.label_error) == (1, "00000000", 0, 0)
    (r,) = codes.compress(spark.createDataFrame([(1, [0.25] * 64)], "vec_id long, embedding array<double>")).collect()
    assert (r.code, r.label_error) == ("00000000", 0)


def test_labels_too_many_to_send(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 7 or None) for i in range(50)]
    monkeypatch.setattr(codes, "BROADCAST", 2)
    assert rows_of(spark.createDataFrame(rows, SCHEMA), dim=4, parts=2, entries=8, rounds=2) == brute(rows, 4, 2, 8, 2)
