import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import jaccard, rtree


def texts(seed: int = 5) -> dict[int, str | None]:
    rng = random.Random(seed)
    stock = [f"w{k}" for k in range(500)]
    out: dict[int, str | None] = {0: None, 1: "", 2: " \t\n", 3: "one two", 4: "One  TWO", 5: "one two three four five", 6: "a" * 5000}
    for base in range(12):
        words = rng.choices(stock, k=rng.choice([8, 60, 200, 700]))
        passage = ["the", "same", "words", "are", "in", "many", "of", "these", "texts", "today"]
        for copy in range(rng.randint(1, 6)):
            w = list(words)
            for _ in range(rng.randint(0, len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(stock)
            out[len(out)] = " ".join([*passage, *w] if copy % 2 else w) + ("é" if copy == 3 else "")
    return out


def many_near(seed: int = 9) -> dict[int, str]:
    """A large group of near copies: all like their source, many of them not like each other."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(240)]
    out = {}
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.choice([1, 2, 3, 5, 7])):
            w[at] = f"x{i}y{at}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize(("made", "counted", "verified"), [("texts", 1 << 20, 1 << 19), ("texts", 800, 400), ("many_near", 1 << 20, 1 << 19), ("many_near", 9000, 5000)])
def test_like_brute_force(spark, made, counted, verified):
    t = globals()[made]()
    docs = spark.createDataFrame(list(t.items()), "doc_id long, text string").selectExpr("doc_id", "text", "text as n", "doc_id as id", "1 as component").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs, counted=counted, verified=verified).collect()}
    assert got == jaccard.reference(t)


def test_edges(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e f"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.similar(docs).collect())
    assert got == [(-1, 2, None), (7, 2, 7), (7, 2, 7), (8, 0, 8), (9, 2, 7)]
    assert sorted(r.doc_id or -1 for r in jaccard.one_of_each(docs).collect()) == [-1, 7, 7, 8]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar(empty).count() == 0


def test_structured_words():
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    for n in (1, 7, 8, 9, 255, 256, 257, 1024, 2048):
        x, y, z = jaccard.shingles([t[:n], other[:n], t[:n] + "b"])
        assert len({int(s[0]) for s in (x, y, z)}) == 3


def test_several_texts_of_one_id(spark):
    long, other = " ".join(f"p{k}" for k in range(60)), " ".join(f"q{k}" for k in range(60))
    rows = [(3, long), (3, other), (5, long + " end"), (6, other + " end"), (3, None)]
    got = {(r.doc_id, r.component_id) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3), (5, 3), (6, 3)}


def test_few_rows_for_many_pairs(spark, tmp_path):
    t = many_near()
    docs = spark.createDataFrame([(i, i, x, len(x.split())) for i, x in t.items()], "id long, grp long, body string, n long")
    scratch = jaccard.Scratch(spark)
    links = jaccard.linked(docs.selectExpr("0L as grp", "id", "cast(n as long) as n"), docs.select("id", "body"), 80, 5000, True, scratch)
    assert links.count() < 3 * len(t)
    scratch.clear()


def test_shingles_of_chunks():
    t = ["x y z"] * 3 + ["", "a b c d e f g"] * 4
    assert [len(s) for s in jaccard.shingles(t)] == [1, 1, 1] + [0, 3] * 4


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_bound_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, rng.integers(1, 1200), dtype=np.uint64) * np.uint64(2)
        for _ in range(2):
            keep = base[rng.random(len(base)) < 0.95]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, len(base) // 20, dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    n, counts = np.array([len(s) for s in sets]), [rtree.count_vector(s) for s in sets]
    index = rtree.Index(counts, n)
    for i, s in enumerate(sets):
        near = {j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))}
        assert near <= set(index.candidates(counts[i], int(n[i]), 80).tolist())
        assert (rtree.decoded(counts[i].tobytes(), int(n[i])) == counts[i]).all()


def test_long_texts(spark):
    rng = random.Random(2)
    long = [f"v{rng.randrange(5000)}" for _ in range(120_000)]
    near = list(long)
    for k in range(0, 2000, 10):
        near[k] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[: len(long) // 2])), (4, "w" * 1_000_000), (5, "w" * 1_000_000), (6, "w" * 999_999)]
    got = {r.doc_id: r.component_id for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_tables_go_once_they_are_read(spark, monkeypatch):
    alive, real = {}, jaccard.Scratch.keep

    def keep(self, rows, name):
        alive.setdefault(name, set()).update(p.rpartition("/")[2].rpartition("-")[0] for p in self.paths)
        return real(self, rows, name)

    monkeypatch.setattr(jaccard.Scratch, "keep", keep)
    texts = {1: "a b c d e f g h i j k l", 2: "a b c d e f g h i j k m", 3: "q r s t u v", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs, 70).collect()} == jaccard.reference(texts, 70)
    assert "shared" not in alive["meets"] and not alive["wide"] & {"alike", "first"} and not alive["links"] & {"shared", "alike"}
