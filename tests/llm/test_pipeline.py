import random
from pathlib import Path

import corpus_pipeline
import pytest
from siftwork.llm import registry


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(9)
    stock = [f"w{k}" for k in range(900)]

    def prose(n):
        return " ".join(rng.choices(stock, k=n))

    passage = prose(70)
    rows, labels = [], []
    for k in range(240):
        toxic = k % 10 == 3
        text = prose(rng.randint(60, 120)) + (" vramp grolk" if toxic else "")
        if k % 40 == 5:
            text = f"{text}\n{passage}\n{prose(30)}"
        rows.append((k, text, "en", f"src{0 if k % 3 else k % 7}", len(text)))
        labels.append((k, 1, int(toxic)))
    for k in (10, 20, 30):
        rows.append((1000 + k, rows[k][1], "en", "src0", 1))
        w = rows[k][1].split()
        w[-1] = "changed"
        rows.append((2000 + k, " ".join(w), "en", "src1", 1))
    rows += [(5000, None, None, None, None), (5001, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), dict((r[0], r[1]) for r in rows), passage


def test_stages(spark, folder, tmp_path):
    sf_dir, texts, passage = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = docs.collect()
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    first = {r.doc_id for r in seen["toxicity"]}
    assert not {k for k in first if k < 240 and k % 10 == 3} and {k for k in range(240) if k % 10 != 3} <= first
    second = {r.doc_id for r in seen["ngram_jaccard_join"]}
    assert first - second == {i for i in (1010, 1020, 1030, 2010, 2020, 2030)}
    third = {r.doc_id: r for r in seen["suffix_array_dedup"]}
    assert set(third) == second
    assert sum(passage in (r.text or "") for r in third.values()) == 1
    assert all(r.n_chars == len(r.text) for r in third.values() if r.text is not None)
    assert {r.doc_id for r in seen["mixing"]} == second
    assert {r.doc_id for r in seen["packing"]} == second


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() >= 200
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "mixing", "packing"]
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in registry.QUERIES}


def test_edges(spark, folder, tmp_path):
    """Empty tables, columns with names of the operators' own, and very long texts."""
    sf_dir, texts, _ = folder
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = ["uid", "spans", "passes", "mix_key", "component_id", "gone_id", "shingle", "features", "p_toxic", "piece"]
    long = spark.createDataFrame([(9000, "u v w " * 100_000, "en", "src1", 1), (9001, "z" * 500_000, "en", "src1", 1), (None, "no id", "en", None, 5)], docs.schema)
    for name, (rows, y) in {"none": (docs.limit(0), labels), "unlabelled": (docs, labels.limit(0)), "odd": (docs.unionByName(long).selectExpr("*", *(f"'{n}' as {n}" for n in names)), labels)}.items():
        at = str(tmp_path / name)
        rows.write.parquet(f"{at}/documents.parquet")
        y.write.parquet(f"{at}/labels.parquet")
        got = corpus_pipeline.run(spark, at).select("doc_id").distinct().collect()
        if name == "none":
            assert not got
        else:
            assert {0, 1, 5000, 5001} <= {r.doc_id for r in got}
        if name == "odd":
            assert {9000, 9001, None} <= {r.doc_id for r in got}


def test_tables_between_stages_go(spark, monkeypatch, tmp_path):
    """Of what stages have returned, only the table that the next one reads is left."""
    paths, seen = [], []
    monkeypatch.setattr(corpus_pipeline, "table_path", lambda s, name: paths.append(str(tmp_path / name)) or paths[-1])
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: s.range(3))

    def stage(s, docs, sf_dir):
        seen.append([Path(p).exists() for p in paths])
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{k}", stage) for k in range(4)])
    assert corpus_pipeline.run(spark, "").count() == 3
    assert seen == [[False], [True, False], [False, True, False], [False, False, True]]
    assert not any(Path(p).exists() for p in paths)
