import json
import logging

import numpy as np
import public_tokenizers
import pytest

from siftwork import cli, config
from siftwork.functions import vocabulary
from siftwork.operators import heads
from siftwork.sources import shards, tables
from siftwork.streaming import documents, scores


def test_from_documents_to_selection(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 900)))) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    cli.main(["tokenize", "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "shards"), "--shard-size", "1_000"], spark)
    data = str(tmp_path / "shards/*.bin")
    cli.main(["score", "--data", data, "--out", str(tmp_path / "scores"), "--seq-len", "64", "--order", "number"], spark)
    found = spark.read.parquet(str(tmp_path / "scores/parquet")).orderBy("total_tokens_seen").collect()
    n = [len(t.split()) + 1 for _, t in rows]
    assert [r.total_tokens_seen for r in found] == np.cumsum(n).tolist()
    assert any("—" in r.doc_id for r in found)
    cli.main(["rank", "--scores", str(tmp_path / "scores/tsv"), "--out", str(tmp_path / "top"), "--top-pct", "25"], spark)
    top = spark.read.parquet(str(tmp_path / "top/parquet")).collect()
    assert {r.doc_id for r in top} == {r.doc_id for r in sorted(found, key=lambda r: -r.AI_Score)[:3]}
    cli.main(["inspect", "--data", str(tmp_path / "shards"), "--doc-id", found[3].doc_id, "--seq-len", "64"], spark)
    sizes = [len(shards.decode(p.read_bytes())) for p in sorted((tmp_path / "shards").glob("*train*.bin"))]
    assert set(sizes[:-1]) == {1000}
    with pytest.raises(SystemExit):
        cli.main(["rank"], spark)


def test_stream(spark, tmp_path):
    share = np.full(65_536, 1 / 65_536)
    docs = spark.createDataFrame([(k, f"a b a c {k}") for k in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    want = {(r.doc_id, r.ai_score) for r in scores.scored(docs, share, 64).collect()}

    def run():
        scores.start(scores.scored(scores.read(spark, str(tmp_path / "in"), 2), share, 64), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return [(r.doc_id, r.ai_score) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    assert sorted(run()) == sorted(want)
    spark.createDataFrame([(99, "late text")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    assert len(run()) == 21


def test_shards_are_followed(spark, tmp_path):
    rows = [(k, " ".join(f"w{x}" for x in range(k))) for k in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    cli.main(["tokenize", "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "shards"), "--shard-size", "7"], spark)
    n = len(list((tmp_path / "shards").glob("*.bin")))
    cli.main(["follow", "--data", str(tmp_path / "shards"), "--out", str(tmp_path / "out"), "--state", str(tmp_path / "state"), "--shards", str(n)], spark)
    assert sorted(r.n_tokens for r in documents.read(spark, str(tmp_path / "out")).collect()) == [k + 1 for k, _ in rows]


BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_with_a_tokenizer(spark, tmp_path, capsys):
    texts = ["One fox saw a hen.", "", None, "Où est <|endoftext|> la maison ?", "x " * 700]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    cli.main(["tokenize", "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "shards"), "--shard-size", "333", "--tokenizer", BPE], spark)
    cli.main(["score", "--data", str(tmp_path / "shards/*.bin"), "--out", str(tmp_path / "scores"), "--order", "number", "--tokenizer", BPE], spark)
    found = spark.read.parquet(str(tmp_path / "scores/parquet")).orderBy("total_tokens_seen").collect()
    whole = vocabulary.load(BPE)
    ends = np.cumsum([len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]).tolist()
    # The tokenizer's own end in a text ends a document too.
    assert set(ends) <= {r.total_tokens_seen for r in found}
    last = found[-1].doc_id
    assert "\u2014" in last
    cli.main(["inspect", "--data", str(tmp_path / "shards"), "--doc-id", last, "--tokenizer", BPE], spark)
    assert ("x " * 700 + "<|endoftext|>") in capsys.readouterr().out


def test_failed_documents_are_counted(spark):
    docs = spark.createDataFrame([(1, "good one"), (2, "bad"), (3, None)], "doc_id long, text string")

    def coder(text):
        if text == "bad":
            raise ValueError(text)
        return [5] * len(text.split())

    got = {r.doc_id: (list(r.e.ids), r.e.failed) for r in docs.select("doc_id", vocabulary.encoded(BPE, coder=coder)("text").alias("e")).collect()}
    assert got == {1: ([5, 5], False), 2: ([], True), 3: ([], False)}
    assert vocabulary.end_of_text(BPE) == 50256
    with pytest.raises(ValueError):
        vocabulary.end_of_text(BPE, ("<none>",))


def test_prompt_and_answer(spark):
    probes = spark.createDataFrame([(1, "the fox saw\nanswer:", " the hen")], "id int, prompt string, answer string")
    row = vocabulary.prompt_and_answer(probes, BPE).first()
    whole = vocabulary.load(BPE)
    assert row.tokens == whole.encode("the fox saw\nanswer: the hen").ids and row.n_prompt == len(whole.encode("the fox saw\nanswer:").ids)


def test_heads_from_probes_and_masks(spark, tmp_path):
    probes = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k}", f"b{k} c{k}") for k in range(6)], "id int, prompt string, answer string")
    tables.write_probes(probes, str(tmp_path / "probes"))
    cli.main(["find-heads", "--probes", str(tmp_path / "probes"), "--out", str(tmp_path / "heads"), "--heads", "4", "--heads-per-layer", "2", "--top-pct", "50"], spark)
    assert tables.read_heads(spark, str(tmp_path / "heads")).count() == 2
    # A token's own vector is most like itself in nearly every head's slice.
    made = probes.selectExpr("id", "split(concat(prompt, ' ', answer), ' ') as w").selectExpr("id", "transform(w, x -> abs(hash(x)) % 60000) as tokens", "4 as n_prompt")
    seq = heads.probe_sequences(made, vocabulary.stand_in_vector(heads.F.col("token"), 64))
    recall = heads.copy_recall(seq, heads.attention(seq, None, 1), None).first()
    assert recall.attempts == 12 and recall.recall > 0.9
    weights = spark.createDataFrame([(layer, p, i, [1.0, 2.0]) for layer in range(2) for p in "qkv" for i in range(4)], tables.WEIGHTS)
    tables.write_weights(weights, str(tmp_path / "w"))
    spark.createDataFrame([("1, 0",), ("",)], "value string").write.text(str(tmp_path / "list"))
    cli.main(["mask-heads", "--weights", str(tmp_path / "w"), "--heads", str(tmp_path / "list"), "--out", str(tmp_path / "masked"), "--head-dim", "2", "--n-heads", "2"], spark)
    got = {(r.layer, r.proj, r.row_idx): r.w for r in tables.read_weights(spark, str(tmp_path / "masked")).collect()}
    assert got == {(layer, p, i): [0.0, 0.0] if layer == 1 and i < 2 else [1.0, 2.0] for layer in range(2) for p in "qkv" for i in range(4)}
    with pytest.raises(SystemExit):
        cli.main(["find-heads", "--out", str(tmp_path / "x")], spark)


def test_versions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs/sample/10BT"))
    cli.main(["tokenize", "--documents", str(tmp_path / "docs"), "--version", "10B", "--out", str(tmp_path / "out")], spark)
    assert shards.exists(str(tmp_path / "out/*.bin")) and not shards.exists(str(tmp_path / "none/*.bin"))
    with pytest.raises(SystemExit):
        cli.main(["tokenize", "--documents", "x", "--version", "1B", "--out", "y"], spark)


def test_config(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"generation": {"num_probes": 3}, "budget": {"max_tokens_per_probe": 2000}, "data": {"dir": str(tmp_path / "data")}, "logger_config": {"handlers": {"file": {"class": "logging.FileHandler", "filename": "run.log"}}, "root": {"handlers": ["file"], "level": "INFO"}}}))
    rows = [(k, " ".join(f"Sentence {k} number {j} has a few words." for j in range(20))) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    cli.main(["make-probes", "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "probes"), "--config", str(path)], spark)
    assert tables.read_probes(spark, str(tmp_path / "probes")).count() == 3
    logging.getLogger("siftwork").info("hello")
    assert "hello" in (tmp_path / "data/run.log").read_text()
    assert config.read(None) == {}
    path.write_text("[1]")
    with pytest.raises(ValueError):
        config.read(str(path))


def test_all_steps(spark, tmp_path):
    rows = [(k, " ".join(f"Sentence {k} number {j} has a few words." for j in range(20))) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    cli.main(["run-all", "--documents", str(tmp_path / "docs"), "--folder", str(tmp_path / "out"), "--n", "4", "--shard-size", "700", "--max-tokens", "2000"], spark)
    assert tables.read_selection(spark, str(tmp_path / "out/selection/tsv")).count() >= 1
    assert tables.read_heads(spark, str(tmp_path / "out/heads")).count() == 1


def test_pointer_paths():
    assert shards.paths_of("a.b:3-5", "/d") == [("/d/a.bin", 3, 5)]
    assert shards.paths_of("/x/a:3-5\u2014b:0-2", "/d") == [("/x/a.bin", 3, 5), ("/x/b.bin", 0, 2)]
    assert shards.paths_of("a:3-5\u2014a:EOF") == [("a.bin", 3, 5)]
    assert shards.paths_of("a:3-EOF\u2014b.bin:EOF", "/d") == [("/d/a.bin", 3, None), ("/d/b.bin", 0, None)]
