"""Words that a worker keeps give the ids of the expression."""

import random

from pyspark.sql import functions as F

from siftwork.functions import tokens


def test_ids_of_kept_words(spark):
    rng = random.Random(3)
    odd = [None, "", " ", "a", " a\tb\r\nc ", "a b  c\x0bd\x0ce \x1cf", "\\n \\t n t r", "naïve 日本 \U0001f600 é", "\x00 x\x00y"]
    texts = odd + [" ".join(str(rng.randrange(40)) for _ in range(rng.randrange(60))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = frame.select("doc_id", tokens.tokenize_by_words("text").alias("got"), tokens.tokenize(F.col("text")).alias("want")).collect()
    assert len(got) == len(texts) and all(r.got == r.want for r in got)


def test_a_worker_that_forgets(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KEPT", 2)
    run = tokens.word_ids
    texts = ["a b c d", "a b", None, "c c c a"]
    once = run(pa.array(texts)).to_pylist()
    assert once == run(pa.array(texts)).to_pylist() and [len(x) for x in once] == [5, 3, 1, 5] and once[0][0] == once[1][0] == once[3][3]
    assert len(tokens._KNOWN) <= 6
