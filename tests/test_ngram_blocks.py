"""Trigrams are exchanged in blocks: many blocks, parts and slices give the same, and no row is a single token."""

import pytest
from test_ngrams import SCHEMA, docs, plain, same

from siftwork.operators import ngrams


@pytest.fixture
def small(monkeypatch):
    for name, value in {"BLOCK": 40, "PART": 16, "LEAST": 8, "SLICE": 100}.items():
        monkeypatch.setattr(ngrams, name, value)


def test_losses_with_the_model_of_the_same_documents(spark, small):
    known = docs(1)
    frame = spark.createDataFrame(known, SCHEMA).repartition(3)
    model = ngrams.fit(frame, 7)
    assert model.slices > 2 and model.parts > 2 and model.chunks.select("block").distinct().count() > 5
    want = plain([t for _, t in known], known, 7)
    same(ngrams.chunk_losses(frame, model, 7).collect(), want)
    # Another length, and the same rows in another table, are asked for anew.
    same(ngrams.chunk_losses(frame, model, 4).collect(), plain([t for _, t in known], known, 4))
    same(ngrams.chunk_losses(spark.createDataFrame(known, SCHEMA), model, 7).collect(), want)


def test_rows_are_blocks_and_not_tokens(spark):
    """A long text takes as many rows as a short one, and a frequent trigram no more than a rare one."""
    frame = spark.createDataFrame([(1, [3, 4, 5, 6] * 5_000), (2, [7] * 20_000)], SCHEMA).coalesce(1)
    model = ngrams.fit(frame, 512)
    assert model.requests.count() <= model.slices * (model.parts + 1)
    rows = ngrams.chunk_losses(frame, model, 512).collect()
    assert sum(r.n_targets for r in rows) == 2 * 19_999 and len(rows) == 80


def test_names_that_come_twice_and_large_ids(spark, small):
    rows = [("a", [3, 4, 5] * 9), ("a", [3, 4, 5] * 5), (None, [5, 4, 3, 2]), ("b", [70_000, 3, 1_000_000, 2]), ("c", None)]
    frame = spark.createDataFrame(rows, "doc_id string, tokens array<int>")
    got = {(r.doc_id, r.chunk): r.n_targets for r in ngrams.chunk_losses(frame, ngrams.fit(frame, 8), 8).collect()}
    assert got == {("a", 0): 16, ("a", 1): 14, ("a", 2): 8, ("a", 3): 2, (None, 0): 3, ("b", 0): 3}
    scores = ngrams.document_losses(frame, ngrams.fit(frame, 8), 8).collect()
    assert len(scores) == 5 and {r.l_base for r in scores if r.doc_id == "c"} == {0}


@pytest.mark.parametrize("bad", [-1, 1 << 21, None])
def test_ids_that_are_none(spark, bad):
    with pytest.raises(Exception, match="a token id"):
        ngrams.fit(spark.createDataFrame([(1, [3, bad, 4])], SCHEMA))
