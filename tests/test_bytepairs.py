"""Byte-pair ids against the tokenizers library, and text back from them."""

import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest

from siftwork.functions.vocabulary import load as whole
from siftwork.operators import bytepairs
from siftwork.plans import registry

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = Path("/root/testdata/sf0.001")
ODD = [
    None, "", " ", "\n\n  x", "it's we'll I'D 'tis", "a b c　", "naïve Größe – « où »", "日本語のテキスト123", "🙂👩‍👩‍👧 é �", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "!<|endoftext|>!", "<|endoftext", "\x00\x1c\x85\r\n\t",
    "12345 678,90 ½ ٣٤", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the " * 300, "  leading and trailing   ", "_snake_case__ $x = {a: [1, 2]};",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab \n.é日🙂1<|'s") for _ in range(rng.randint(1, 80))) for _ in range(120)]
    docs = [r.text for r in spark.read.parquet(str(SF / "documents.parquet")).select("text").collect()] if SF.exists() else []
    return list(enumerate([*ODD, *made, "".join(rng.choice("abcdefgh") for _ in range(200_000)), *docs]))


def test_ids_and_text(spark, texts):
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    coded = bytepairs.encode(frame, PATH).checkpoint()
    got = {r.doc_id: r.tokens for r in coded.collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        assert got[i] == whole(PATH).encode(t or "", add_special_tokens=False).ids, t
    back = {r.doc_id: r.text for r in bytepairs.decode(coded, PATH).collect()}
    assert all(back[i] == (t or "") for i, t in texts)
    some = spark.createDataFrame(texts[:30], "doc_id long, text string")
    for frequent in (1, 30):
        assert {r.doc_id: r.tokens[:-1] for r in bytepairs.encode(some, PATH, 7, frequent).collect()} == {i: got[i] for i, _ in texts[:30]}


def test_parts_of_characters(spark):
    ids = whole(PATH).encode("🙂").ids
    assert len(ids) > 1
    rows = spark.createDataFrame([(1, ids), (2, ids[:-1]), (3, [60_000]), (4, []), (5, None), (6, [50256])], "doc_id long, tokens array<int>")
    got = {r.doc_id: r.text for r in bytepairs.decode(rows, PATH).collect()}
    assert (got[1], got[3], got[4], got[5], got[6]) == ("🙂", "<60000>", "", "", "<|endoftext|>")
    assert "�" in got[2]


def test_other_tokenizers(tmp_path):
    (tmp_path / "t.json").write_text('{"model": {"type": "WordPiece", "vocab": {}, "merges": []}, "pre_tokenizer": null}')
    with pytest.raises(ValueError, match="another kind"):
        bytepairs.load(str(tmp_path / "t.json"))


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query_like_the_library(spark):
    """Every document of the smallest tables."""
    got = {r.doc_id: (r.n_tokens, r.tokens_md5) for r in registry.byte_pair_tokens(spark, str(SF)).collect()}
    want = {}
    for r in spark.read.parquet(str(SF / "documents.parquet")).select("doc_id", "text").collect():
        ids = whole(PATH).encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.md5(" ".join(map(str, ids)).encode()).hexdigest())
    assert got == want


def test_nothing_is_shuffled(spark, texts):
    """Neither ids nor texts take an exchange, which would carry a row for each token."""
    docs = spark.createDataFrame(texts[:30], "doc_id long, text string")
    coded = bytepairs.encode(docs, PATH)
    for frame in (coded, bytepairs.decode(coded, PATH)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
