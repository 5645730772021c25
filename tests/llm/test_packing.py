import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwork.llm import packing

T = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return [*T.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", " ", "x", "\n", "<|", "|>", "don't", "é"]), max_size=12).map("".join))
def test_same_ids(text):
    assert [*packing.encoder(packing.default_tokenizer())(text), 0] == ids(text)


def test_same_ids_of_odd_texts():
    for t in ("<|endoftext|> x", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n", "<|endoftext| >", " <|endoftext|> ", "a" * 3000, " " * 2000 + "b", "don't WE'LL 12345 \r\n\t x", "é" * 700, "  x​", "🙂👍🏽"):
        assert [*packing.encoder(packing.default_tokenizer())(t), 0] == ids(t)


@pytest.mark.parametrize("bucket", [16_384, 7])
def test_pieces(spark, bucket, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    rows = [(k, " ".join(f"word{j % 17}" for j in range(n))) for k, n in enumerate([0, 1, 3, 10, 500, 900, 2000, 30, 700, 1500, 40, 60] * 2)]
    rows += [(None, "x y z"), (5, None), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as piece", "2 as bin")
    size = 256
    got = packing.pack(packing.pieces(docs, size=size), size, bucket=bucket).collect()
    want = sorted((d if d is not None else -1, k, s, n, zlib.crc32(np.array(ids(t)[s : s + n], dtype="<u4").tobytes())) for d, t in rows for k, (s, n) in enumerate(packing.cuts(len(ids(t)), size)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= size
    assert len(fill) <= 1.2 * sum(n for *_, n, _ in want) / size + 2


def test_long_text(spark):
    text = "the quick fox, 12 hens " * 60_000
    rows = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(r.length for r in rows) == len(ids(text)) and len(rows) == -(-len(ids(text)) // 2048)


def test_rounds_end(spark):
    rng = np.random.default_rng(0)
    lengths = [int(x) for x in rng.integers(1, 100, 3000)]
    got = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long"), 100, slack=2, bucket=50).collect()
    assert len(got) == len(lengths)
    assert len({r.sequence_id for r in got}) <= 1.08 * sum(lengths) / 100


def test_cuts():
    assert packing.cuts(5, 2) == [(0, 1), (1, 2), (3, 2)]
    assert packing.cuts(4, 2) == [(0, 2), (2, 2)]
    assert packing.cuts(1, 2) == [(0, 1)]


def test_empty_and_bad(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0,)], "length long"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_best_fit(lengths):
    n = np.array(lengths, dtype=np.int64)
    bins, offsets, fills = packing.best_fit(n, 50)
    assert (np.bincount(bins, weights=n, minlength=len(fills)) == fills).all() and (fills <= 50).all()
    assert (offsets + n <= fills[bins]).all()
    assert (fills <= 25).sum() <= 1


def test_clashing_names(spark):
    parts = spark.range(40).selectExpr("id % 9 + 1 as length", "id as uid", "id as _uid", "id as bin", "id as shift", "id as fill", "id as offset", "'x' as sequence_id")
    got = packing.pack(parts, 10).collect()
    assert sorted(r.uid for r in got) == list(range(40)) and all(r.uid == r.bin == r._uid for r in got)
    assert {type(r.sequence_id) for r in got} == {int}
