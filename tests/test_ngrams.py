"""Kneser-Ney losses against plain Python over dictionaries."""

import math
import random
from collections import Counter

from siftwork.operators import ngrams

SCHEMA = "doc_id long, tokens array<int>"


def triples(tokens, length=None):
    tokens = tokens or []
    for k, at in enumerate(range(0, max(0, len(tokens) - 1), length or max(1, len(tokens)))):
        t = tokens[at : at + length + 1] if length else tokens
        for i in range(1, len(t)):
            yield k, (t[i - 2] if i >= 2 else ngrams.BOS, t[i - 1], t[i])


def plain(train, docs, length):
    c3 = Counter(g for t in train for _, g in triples(t))
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter(w for _, w in c2)

    def discount(c):
        one, two = (sum(n == k for n in c.values()) for k in (1, 2))
        return one / (one + 2 * two) if one else 0.5

    d3, d2, d1 = map(discount, (c3, c2, c1))
    total = sum(c1.values())

    def losses(u, v, w):
        p1 = (max(c1[w] - d1, 0) + d1 * len(c1) / ngrams.VOCABULARY) / total if total else 1 / ngrams.VOCABULARY
        after = [n for (a, _), n in c2.items() if a == v]
        p2 = (max(c2[v, w] - d2, 0) + d2 * len(after) * p1) / sum(after) if after else p1
        after = [n for (a, b, _), n in c3.items() if (a, b) == (u, v)]
        p3 = (max(c3[u, v, w] - d3, 0) + d3 * len(after) * p2) / sum(after) if after else p2
        return [-1e6 * math.log(p) for p in (p3, p2, p1)]

    out = {}
    for doc_id, tokens in docs:
        for k, g in triples(tokens, length):
            row = out.setdefault((doc_id, k), [0, 0.0, 0.0, 0.0])
            row[0] += 1
            for i, x in enumerate(losses(*g)):
                row[i + 1] += x
    return out


def docs(seed, n=12):
    rng = random.Random(seed)
    return [(i, [rng.choice([3, 4, 5, 6, 7, 8, 9, 40]) for _ in range(rng.choice([0, 1, 2, 5, 30]))] + [2]) for i in range(n)] + [(100, None), (101, []), (102, [7] * 80), (103, [7] * 80)]


def same(rows, want):
    assert {(r.doc_id, r.chunk) for r in rows} == want.keys()
    for r in rows:
        n, *sums = want[r.doc_id, r.chunk]
        assert r.n_targets == n
        for got, x in zip((r.l_trigram, r.l_bigram, r.l_unigram), sums):
            assert abs(got - x) <= 0.5 * n + 1e-3


def test_like_plain_python(spark):
    known = docs(1)
    frame = spark.createDataFrame(known, SCHEMA)
    for frequent in (1, 10, 10_000):
        same(ngrams.chunk_losses(frame, ngrams.fit(frame), 7, frequent).collect(), plain([t for _, t in known], known, 7))


def test_a_model_of_other_documents(spark):
    known, other = docs(1), [*docs(2), (7, [50_000, 3, 50_000, 4])]
    got = ngrams.chunk_losses(spark.createDataFrame(other, SCHEMA), ngrams.fit(spark.createDataFrame(known, SCHEMA)), 4).collect()
    unseen = {k: v for k, v in plain([t for _, t in known], [(i, t) for i, t in other if i != 7], 4).items() if k[0] != 7}
    same([r for r in got if r.doc_id != 7], unseen)
    assert all(math.isfinite(r.l_unigram) and r.l_unigram > 0 for r in got)
    empty = ngrams.chunk_losses(spark.createDataFrame(other, SCHEMA), ngrams.fit(spark.createDataFrame([], SCHEMA)), 4).collect()
    even = math.floor(1e6 * math.log(ngrams.VOCABULARY) + 0.5)
    assert all(r.l_trigram == r.l_unigram == even * r.n_targets for r in empty)


def test_probabilities_add_up_to_one(spark):
    """Over all ids that can follow a context, seen or not."""
    known = [(i, [3, 4, 5, 3, 4, 6, 3, 4, 5, 7][: 4 + i] + [2]) for i in range(7)]
    model = ngrams.fit(spark.createDataFrame(known, SCHEMA))
    ids = spark.range(ngrams.VOCABULARY).selectExpr("cast(id as int) w")
    for u, v in ((3, 4), (9, 4), (9, 9)):
        rows = ngrams.losses(ids.selectExpr(f"{u} u", f"{v} v", "w"), model)
        for c in ngrams.LOSSES:
            total = rows.selectExpr(f"sum(exp(-{c} / 1e6))").first()[0]
            assert abs(total - 1) < 1e-4


def test_documents(spark):
    known = docs(4)
    frame = spark.createDataFrame([(i, t, "x") for i, t in known], "doc_id long, tokens array<int>, c string")
    got = {r.doc_id: r for r in ngrams.document_losses(frame, ngrams.fit(frame), 7, "c").collect()}
    assert len(got) == len(known) and got[100].l_base == got[101].l_ref == 0
    # Repetition is what context foretells.
    assert got[102].l_base < 0.2 * got[102].l_ref
    empty = spark.createDataFrame([], SCHEMA)
    assert ngrams.document_losses(empty, ngrams.fit(empty), 7).collect() == []


def test_slices_hold_little_and_leave_nothing(spark, tmp_path, monkeypatch):
    """Slice by slice gives the same; no step shuffles the targets of all slices, and its tables are deleted."""
    known = docs(1)
    frame = spark.createDataFrame(known, SCHEMA)
    monkeypatch.setattr(ngrams, "SLICE", 40)
    made = []
    monkeypatch.setattr(ngrams, "scratch", lambda spark, name: made.append(tmp_path / f"{len(made)}{name}") or str(made[-1]))
    model = ngrams.fit(frame)
    assert 3 < model.slices <= ngrams.SLICES
    assert model.trigrams.groupBy("v").agg({"part": "min"}).count() == model.trigrams.select("v", "part").distinct().count()
    same(ngrams.chunk_losses(frame, model, 7, 10).collect(), plain([t for _, t in known], known, 7))
    model.clear()
    assert made and not any(p.exists() for p in made)
