import random
import zlib

import numpy as np

from siftwork.llm import toxicity


def corpus(seed=2, n=600):
    rng = random.Random(seed)
    stock = [f"word{k}" for k in range(400)]
    docs, labels = [], []
    for k in range(n):
        w = rng.choices(stock, k=rng.randint(10, 60))
        toxic, low = rng.random() < 0.2, rng.random() < 0.15
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["grolk", "Vramp", "grolkish"]))
        if low:
            w += ["%%%", "###"]
        docs.append((k, " ".join(w)))
        labels.append((k, int(not low), int(toxic)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as p_toxic", "0 as toxic", "0 as quality", "array(1) as features")
    chain = toxicity.fit(d, spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, chain).collect()}
    held = labels[400:]
    assert np.mean([got[k].is_toxic == bool(t) for k, _, t in held]) > 0.97
    assert np.mean([(got[k].p_low_quality > 0.5) == (q == 0) for k, q, _ in held]) > 0.97
    assert chain.models[2].earlier.shape == (2,) and chain.models[0].earlier.shape == (0,)
    kept = toxicity.score(d, chain, keep=True)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.is_toxic}


def test_edges(spark):
    docs, labels = corpus(n=200)
    d = spark.createDataFrame([*docs, (None, None), (None, "grolk"), (7, ""), (9, "x " * 50_000)], "doc_id long, text string")
    y = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1), (5, 1, None), (5, 1, 1), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(d, toxicity.fit(d, y)).count() == 204
    assert toxicity.fit(d, y.limit(0)) is None
    rows = toxicity.score(d, None).collect()
    assert len(rows) == 204 and not any(r.is_toxic for r in rows) and rows[0].p_toxic is None
    assert toxicity.score(d, None, keep=True).count() == 204
    assert toxicity.score(d.limit(0), toxicity.fit(d, y)).count() == 0


def test_threshold():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2]), np.array([1.0, 1.0, 0.0])) == 0.5
    assert toxicity.best_threshold(np.array([0.9]), np.array([0.0])) > 1


def test_fit_like_plain_python(spark):
    """Grouped counts and chosen features give the chain that all features of all texts give, and no row's inputs come from a model that saw it."""
    docs, labels = corpus(n=250)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.fit(d.repartition(3), y)
    found = [sorted({f for w in toxicity.words_of(t) for f in toxicity.word_features(w)}) for _, t in docs]
    rows, features = np.repeat(np.arange(len(docs)), [len(f) for f in found]), np.concatenate([np.array(f) for f in found])
    fold = np.array([zlib.crc32(str(i).encode()) % toxicity.FOLDS for i, _ in docs])
    low, toxic = np.array([q == 0 for _, q, _ in labels]), np.array([t == 1 for *_, t in labels])
    targets = [low, toxic, low & toxic]
    held = np.zeros((len(docs), 0))
    for k, (target, model) in enumerate(zip(targets, got.models, strict=True)):
        want = toxicity.fit_linear(rows, features, held, target.astype(float))
        assert np.array_equal(want.index, model.index) and np.allclose(want.weight, model.weight) and np.allclose(want.earlier, model.earlier) and np.isclose(want.bias, model.bias)
        column = np.zeros(len(docs))
        for i in range(len(docs)):
            others = np.nonzero(fold != fold[i])[0]
            key = (k, fold[i])
            if key not in MODELS:
                part = np.isin(rows, others)
                MODELS[key] = toxicity.fit_linear(np.searchsorted(others, rows[part]), features[part], held[others], target[others].astype(float))
            own = features[rows == i]
            column[i] = toxicity.predict_linear(MODELS[key], np.zeros(len(own), dtype=int), own, held[i : i + 1], 1)[0]
        assert np.isclose(toxicity.best_threshold(column, target.astype(float)), got.thresholds[k])
        held = np.column_stack([held, column])


MODELS: dict = {}


def test_forms(spark):
    """What is scored are the sample's own words and beginnings: a word that only shares a hashed place has no weight."""
    docs, labels = corpus(n=300)
    chain = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(toxicity.place_of(x) == f for x, f in chain.forms.items())
    assert set(chain.forms.values()) == {int(f) for m in chain.models for f in m.index}
    text = docs[0][1]
    got = toxicity.score(spark.createDataFrame([(1, text), (2, f"{text} {text} grolkling"), (3, f"{text} zzzzzz")], "doc_id long, text string"), chain)
    p = {r.doc_id: r.p_toxic for r in got.collect()}
    assert p[1] == p[3] < p[2]
