"""Sentence ends on a small labelled corpus: abbreviations, initials, decimals, numbers, quotes."""

import random

import pytest

from siftwork.operators import sentences

NAMES = "Smith Jones Miller Brown Davis Clark Lewis Walker Young King".split()
PLAIN = ["the fox saw a hen in the field", "we went to the river with them", "it rained all day and all night", "they sold the house last year", "nobody knew what it was for"]
LABELLED = [
    ["Dr. Smith came home at noon.", "He was tired."],
    ["They met Mr. Jones and Mrs. Brown there.", "The talk was long."],
    ["J. K. Miller wrote it.", "We read it twice."],
    ["It costs 3.50 in the shop, approx. 4.20 elsewhere.", "They sold 12.", "The rest is here."],
    ['He said "it rained."', '"The river rose!"', "Did it?", "It did (really.)", "We saw it."],
    ["See fig. 3 and fig. 4 for it.", "The end."],
    ["They used e.g. wood and stone.", "It was cheap."],
]


@pytest.fixture(scope="module")
def corpus():
    rng, rows = random.Random(2), []
    for i in range(400):
        said = []
        for _ in range(6):
            body = rng.choice(PLAIN).split()
            if rng.random() < 0.5:
                body[rng.randrange(1, len(body)) :] = [rng.choice(["Dr.", "Mr.", "Mrs."]), rng.choice(NAMES), "and", "approx.", str(rng.randint(2, 90)), "men", "e.g.", "wood", "by", "fig.", str(rng.randint(1, 9))]
            if rng.random() < 0.3:
                body += [rng.choice("ABCJK") + ".", rng.choice(NAMES)]
            body[0] = body[0].capitalize()
            said.append(" ".join(body) + rng.choice([".", ".", ".", "!", "?"]))
        rows.append((i, " ".join(said), "en"))
    return [*rows, *((1000 + k, " ".join(s), "en") for k, s in enumerate(LABELLED))]


SCHEMA = "doc_id long, text string, lang string"


def test_labelled_set(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    model = sentences.fit(docs)
    assert {"dr", "mr", "mrs", "fig", "e.g", "approx"} <= {r.base for r in model.abbreviations.collect()}
    assert not {"home", "noon", "hen", "field", "night"} & {r.base for r in model.abbreviations.collect()}
    got = {}
    for r in sentences.split(docs.where("doc_id >= 1000"), model).orderBy("doc_id", "sent_no").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    for k, want in enumerate(LABELLED):
        assert got[1000 + k] == want


def test_nothing_is_lost(spark, corpus):
    odd = [(1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, "No end here", None), (5, "... . ! x.", "fr"), (6, "a.b. c.", None), (7, "1. 2. 3.", "xx")]
    docs = spark.createDataFrame([*corpus[:20], *((i + 5000, t, k) for i, t, k in odd)], SCHEMA)
    got = {}
    for r in sentences.split(docs, sentences.fit(docs)).orderBy("doc_id", "sent_no").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    for i, t, _ in [*corpus[:20], *((i + 5000, t, k) for i, t, k in odd)]:
        assert " ".join(got.get(i, [])) == " ".join((t or "").split(" ")).strip() or i == 5003
    assert sentences.split(docs.limit(0), sentences.fit(docs.limit(0))).collect() == []


def test_abbreviations_read_texts_once(spark):
    docs = spark.createDataFrame([(1, "a b. c.", "en"), (2, "e.g. x", "de")], "doc_id long, text string, lang string")
    plan = sentences.abbreviations(sentences.counted(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp_extract_all" not in plan
