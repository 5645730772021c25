import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwork.llm import mixing


def rows():
    out = [(k, f"{'a b ' * (k % 9)}end", "big") for k in range(3000)] + [(10_000 + k, "x " * 7, f"s{k % 5}") for k in range(150)]
    return [*out, (None, None, None), (None, "u v w", None), (4, "a b ", "big"), (4, "a b ", "big"), (20_000, "", "quiet"), (20_001, "one", "single")]


def test_like_sql(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("doc_id", "text", "source", "1 as key", "2 as rank", "3 as n")
    got = mixing.mix(docs).toPandas()
    documents = pd.DataFrame(data, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(mixing.ORACLE).df()

    def listed(x):
        return sorted(tuple(str(v) for v in r) for r in x[["doc_id", "source", "n_tokens", "copies", "budget", "exponent"]].astype(object).where(lambda c: c.notna(), None).map(lambda v: int(v) if isinstance(v, float) else v).itertuples(index=False))

    assert listed(got) == listed(want)
    # Budgets are met to within a document.
    used = got.assign(t=got.n_tokens * got.copies).groupby("source").agg(t=("t", "sum"), b=("budget", "first"), most=("n_tokens", "max"))
    assert ((used.b - used.t).between(0, 2 * used.most + 2)).all()


@pytest.mark.parametrize("span", [2, 3, 1024])
def test_ends_by_levels(spark, monkeypatch, span):
    monkeypatch.setattr(mixing, "SPAN", span)
    data = [(k, f"{k % 3}", k, 0 if k % 5 else k % 7) for k in range(60)]
    blocks = spark.createDataFrame(data, "i long, key string, block long, in_block long").withColumn("block", F.expr("block div 3")).select("key", "block", "in_block")
    sums = {key: [n for _, of, _, n in data if of == key] for key in "012"}
    for rest in (1, 3, 5):
        rests = spark.createDataFrame([(key, rest) for key in sums], "key string, rest long")
        want = {}
        for key, ns in sums.items():
            block = next(b for b in range(len(ns)) if sum(ns[: b + 1]) > rest)
            want[key] = (block, rest - sum(ns[:block]))
        assert {r["key"]: (r["cut_block"], r["room"]) for r in mixing._cut(blocks, rests).collect()} == want


def test_cover(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    found, _, _, times = mixing.copies(docs, mixing.plan(docs, None, 2.0, True))
    found = found.collect()
    assert min(r[times] for r in found) == 1 and max(r[times] for r in found) <= 3
    assert {r[times] for r in found if r.source == "big"} == {1}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and out.count() == sum(r[times] for r in found)


@pytest.mark.parametrize("n", [0, 1])
def test_few_sources(spark, n):
    docs = spark.createDataFrame([(1, "a b", "s")] * n, "doc_id long, text string, source string")
    assert [r.copies for r in mixing.mix(docs).collect()] == [1] * n


def test_entropy_is_met(spark):
    sources = spark.createDataFrame([(f"s{k}", 10**k) for k in range(1, 6)], "key string, tokens long")
    flat, half = mixing.exponent(sources, 1.0, None, False), mixing.exponent(sources, 0.5, None, False)
    assert flat == 0 < half < mixing.STEPS
    assert mixing.exponent(sources, None, 1.0, False) == mixing.STEPS
    assert 0 < mixing.exponent(sources, None, 3.0, True) < mixing.STEPS


def test_clashing_names_and_long_texts(spark):
    names = ["passes", "n_blocks", "cut_block", "cut_rank", "cut_id", "mix_budget", "mix_copies", "mix_copy", "mix_key", "mix_rank", "key", "budget", "exponent", "_key", "Tokens"]
    base = spark.createDataFrame([(k, "a b " * (k % 5) + ("x " * 100_000 if k == 3 else ""), f"s{k % 3}") for k in range(30)], "doc_id long, text string, source string")
    docs = base.selectExpr("*", *(f"concat('own {n} ', doc_id) as {n}" for n in names))
    got = mixing.mixture(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {r.doc_id for r in rows} == set(range(30))
    assert all(r[n] == f"own {n} {r.doc_id}" for r in rows for n in names)
    assert mixing.mixture(docs.limit(0)).count() == 0
