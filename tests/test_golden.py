"""Small cases with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import tokens
from siftwork.operators import heads, packing, probes, ranking, scoring
from siftwork.operators.prefix import prefix_sum
from siftwork.sources import shards, tables


def stream(spark, *contents):
    rows = [(k, 0, 0, list(c)) for k, c in enumerate(contents) if c]
    return spark.createDataFrame(rows, "shard long, block long, at long, tokens array<int>")


@pytest.mark.parametrize(
    ("contents", "lengths"),
    [
        (([5, 6, 2, 7], [8, 2, 9, 2], [10, 11]), [3, 3, 2, 2]),
        (([2, 5, 2],), [1, 2]),
        (([5, 6, 2, 2],), [3, 1]),
        (([7, 8],), [2]),
    ],
)
def test_islands(spark, contents, lengths):
    got = packing.islands(stream(spark, *contents), 4).orderBy("doc_start").collect()
    assert [r.n_tokens for r in got] == lengths
    assert [r.total_tokens_seen for r in got] == list(np.cumsum(lengths))
    assert [r.doc_start for r in got] == [0, *np.cumsum(lengths)[:-1].tolist()]


def placed(spark, *lengths):
    seen = np.cumsum(lengths).tolist()
    return spark.createDataFrame(list(zip(range(len(lengths)), lengths, seen, strict=True)), "doc_id long, n_tokens long, total_tokens_seen long")


@pytest.mark.parametrize(("lengths", "size", "shards_"), [((3, 4, 2, 3), 6, [6, 6]), ((3, 4, 2, 4), 6, [6, 6, 1]), ((3, 3, 2), 4, [4, 4]), ((9,), 4, [4, 4, 1])])
def test_layout(spark, lengths, size, shards_):
    got = packing.layout(placed(spark, *lengths), size).orderBy("shard_index").collect()
    assert [r.n_tokens for r in got] == shards_
    assert [r.shard_name for r in got] == [f"fineweb_{'train' if k else 'val'}_{k:06d}" for k in range(len(shards_))]


def test_pointers_of_three_shards(spark):
    rows = placed(spark, 2, 5).withColumn("pointer", packing.pointer(packing.ranges(3)))
    assert [r.pointer for r in rows.orderBy("doc_id").collect()] == ["fineweb_val_000000:0-1", "fineweb_val_000000:2-2—fineweb_train_000001:0-2—fineweb_train_000002:0-0"]


def test_resolve(spark):
    pieces = spark.createDataFrame([("a.b", 0, 0, [5, 6]), ("a.b", 0, 2, [2, 7]), ("c", 0, 0, [8, 2, 9])], "shard_name string, block long, at long, tokens array<int>")
    asked = [(1, "a.b:0-2"), (2, "a.b:3-3—c:0-1"), (3, "c:2-EOF"), (4, "a.b:3-3—a.b:EOF")]
    got = packing.resolve(spark.createDataFrame(asked, "doc_id long, pointer string"), pieces)
    assert {r.doc_id: r.tokens for r in got.collect()} == {1: [5, 6, 2], 2: [7, 8, 2], 3: [9], 4: [7]}


@pytest.mark.parametrize(("n", "want"), [(9, [5, 5]), (10, [5, 5, 2]), (1, []), (2, [2]), (0, [])])
def test_chunks(spark, n, want):
    row = spark.range(1).select(tokens.chunks(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), 4).alias("c")).first()
    assert [len(c) for c in row.c] == want


def test_score_formula(spark):
    rows = spark.createDataFrame([(10_000_000, 12_000_000), (10_000_000, 9_000_000), (0, 0)], "l_base long, l_ref long")
    assert [r.ai_score for r in scoring.ai_score(rows).collect()] == [0.2, -0.1, 0.0]


def test_losses():
    share = np.full(10, 0.1)
    base, reference = scoring.stand_in(share, bos=1)(np.array([5, 6, 5]))
    # context [1, 5] for 6, [1, 5, 6] for 5
    assert reference == round(-2e6 * math.log(0.1))
    assert base == pytest.approx(-1e6 * (math.log(0.05) + math.log(0.5 / 3 + 0.05)), abs=2)


def scores(spark):
    return spark.createDataFrame([("a", 0.1, 3), ("b", 0.4, 6), ("c", -0.2, 8), ("d", 0.3, 10)], "doc_id string, ai_score double, total_tokens_seen long")


def test_ranking(spark):
    rows = ranking.lengths(scores(spark))
    assert [r.tok_len for r in rows.orderBy("doc_id").collect()] == [3, 3, 2, 2]
    top = ranking.select(rows, 50.0)
    assert sorted(r.doc_id for r in top.collect()) == ["b", "d"]
    s = ranking.summary(top, rows).first()
    assert (s.n_selected, s.selected_tokens, s.token_pct) == (2, 5, 50.0)
    low = ranking.select(rows, bottom=20.0)
    assert [r.doc_id for r in low.collect()] == ["c"]
    assert ranking.summary(low, rows).first().token_pct == 20.0
    assert ranking.summary(rows.limit(0), rows.limit(0)).first().token_pct is None


@pytest.mark.parametrize(("limit", "n"), [(6, 2), (7, 3), (0, 1), (None, 4)])
def test_early_stop(spark, limit, n):
    assert scoring.until(placed(spark, 3, 3, 2, 2), limit).count() == n


def test_head_list(spark, tmp_path):
    (tmp_path / "h.txt").write_text("2,20\n2, 23\n 2 22\n\n")
    assert [(r.layer, r.head) for r in tables.read_heads(spark, str(tmp_path / "h.txt")).collect()] == [(2, 20), (2, 23), (2, 22)]


def test_how_many_heads():
    assert ranking.how_many(128, 5) == 7


def test_shard_files(spark, tmp_path):
    data = {"s1": [5, 65535, 2, 7], "s2": [], "s3": [2, 0]}
    for name, t in data.items():
        (tmp_path / f"{name}.bin").write_bytes(shards.encode(np.array(t, dtype=np.int64)) + b"rest")
    for read in (shards.read, shards.read_with_spark):
        got = read(spark, f"{tmp_path}/*.bin", block=3).orderBy("shard", "at").collect()
        assert [(r.shard, r.block, r.at, list(r.tokens)) for r in got] == [("s1", 0, 0, [5, 65535, 2]), ("s1", 1, 3, [7]), ("s3", 0, 0, [2, 0])]
    part = shards.read(spark, f"{tmp_path}/s1.bin", lo=1, hi=2).collect()
    assert [(r.at, list(r.tokens)) for r in part] == [(1, [65535, 2])]
    with pytest.raises(ValueError):
        shards.encode(np.array([65536]))
    with pytest.raises(ValueError):
        shards.decode(b"x" * 2000)
    with pytest.raises(ValueError):
        shards.decode(shards.header(3) + b"\0\0")


def test_shards_written(spark, tmp_path):
    pieces = spark.createDataFrame([("b", 3, [4]), ("a", 0, [1, 2]), ("b", 0, [1, 2, 3])], "shard string, at long, tokens array<int>")
    shards.write(pieces, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "b.bin"]
    assert shards.decode((tmp_path / "b.bin").read_bytes()).tolist() == [1, 2, 3, 4]


def test_prefix_sum(spark):
    rows = spark.range(1000).withColumn("v", (F.col("id") * 7 % 13))
    got = {r.id: r.t for r in prefix_sum(rows.repartition(7), "id", "v", "t").collect()}
    assert got == dict(enumerate(np.cumsum([k * 7 % 13 for k in range(1000)]).tolist()))
    assert prefix_sum(rows.limit(0), "id", "v", "t").count() == 0


def test_token_range(spark):
    bad = spark.createDataFrame([([1, 70000],)], "t array<int>").select(tokens.in_range(F.col("t")).alias("t"))
    with pytest.raises(Exception, match="outside"):
        bad.collect()


def test_tokenizer(spark):
    rows = spark.createDataFrame([("a b\n a",), ("",), (None,)], "t string").select(tokens.tokenize(F.col("t")).alias("x"), tokens.n_tokens(F.col("t")).alias("n"), tokens.with_bos(tokens.tokenize(F.col("t"))).alias("b")).collect()
    assert [r.n for r in rows] == [3, 0, 0]
    assert rows[0].x[0] == rows[0].x[2] != rows[0].x[1] and rows[0].x[3] == 2 and rows[1].x == [2] == rows[2].x
    assert rows[1].b == [1, 2]
    rows = spark.createDataFrame([(1, [7, 8, 7]), (2, []), (3, None)], "doc_id long, tokens array<int>")
    known = tokens.detokenize(rows, spark.createDataFrame([(7, "sea")], "token int, word string"))
    assert {r.doc_id: r.text for r in known.collect()} == {1: "sea <8> sea", 2: "", 3: ""}


def test_sentences(spark):
    rows = spark.createDataFrame([(1, "One two three four five. Six?  Seven eight nine ten eleven twelve!\nEnd without a stop here now")], "doc_id long, text string")
    assert [(r.sent_no, r.sentence) for r in probes.pool(rows).collect()] == [(0, "One two three four five."), (2, "Seven eight nine ten eleven twelve!"), (3, "End without a stop here now")]


def test_json_quotes(spark):
    text = 'é " \\ \n / \t'
    assert spark.createDataFrame([(text,)], "t string").select(probes.quoted(F.col("t")).alias("q")).first().q == '"é \\" \\\\ \\n / \\t"'


def test_probe_backs_off(spark):
    pool = spark.createDataFrame([(k, 0, f"s{k} b c d e.", 5) for k in range(100)], "doc_id long, sent_no int, sentence string, n_tok long")
    context = probes.contexts(pool, 2, "s").checkpoint()
    assert context.groupBy("probe_id").agg(F.count_distinct("sentence").alias("n")).where("n = 60").count() == 2
    assert [r.k for r in probes.prompts(context, 10_000, "s").collect()] == [60, 60]
    tight = probes.prompts(context, 300, "s").collect()
    assert all(r.k < 60 and r.answer in r.prompt and r.prompt.endswith("\nanswer:") for r in tight)
    with pytest.raises(Exception, match="budget"):
        probes.prompts(context, 50, "s").collect()


def test_copy_recall(spark):
    seq = spark.createDataFrame([(0, 0, 7), (0, 1, 8), (0, 2, 7), (0, 3, 9)], "probe_id long, pos int, token int")
    attended = spark.createDataFrame([(0, 0, 2, 0), (0, 0, 3, 1), (0, 1, 2, 1), (0, 1, 3, 1)], "probe_id long, head int, query_pos int, attended_pos int")
    got = {r.head: (r.hits, r.attempts, r.recall) for r in heads.copy_recall(seq, attended, 2).collect()}
    assert got == {0: (1, 1, 1.0), 1: (0, 1, 0.0)}  # 9 isn't in the prompt


def test_mask(spark):
    rows = spark.createDataFrame([(0, p, r, [1.0]) for p in "qkv" for r in range(4)], "layer int, proj string, row_idx int, w array<double>")
    chosen = spark.createDataFrame([(0, 1)], "layer int, head int")
    zero = {(r.proj, r.row_idx) for r in heads.masked(rows, chosen, 2, 2).collect() if r.w == [0.0]}
    assert zero == {(p, r) for p in "qkv" for r in (2, 3)}
    shared = {(r.proj, r.row_idx) for r in heads.masked(rows, chosen, 2, 2, group=2).collect() if r.w == [0.0]}
    assert shared == {("q", 2), ("q", 3), *((p, r) for p in "kv" for r in (0, 1))}
    with pytest.raises(IndexError):
        heads.masked(rows, spark.createDataFrame([(0, 2)], "layer int, head int"), 2, 2)
    assert heads.without_sampling({"do_sample": False, "top_p": 0.9, "x": 1}) == {"do_sample": False, "top_p": None, "x": 1}


def test_tables(spark, tmp_path):
    s = spark.createDataFrame([("a:0-1", 1.23456, 2.0, 0.1234567, 2)], tables.SCORES)
    tables.write_scores(s, str(tmp_path / "s"))
    assert tables.read_scores(spark, str(tmp_path / "s/tsv")).first().AI_Score == 0.123457
    p = spark.createDataFrame([(1, "é\n", "x")], tables.PROBES)
    tables.write_probes(p, str(tmp_path / "p"))
    assert tables.read_probes(spark, str(tmp_path / "p")).collect() == p.collect()


def test_parse_pointer(spark):
    rows = spark.createDataFrame([(1, "a.b:3-5"), (2, "a:3-EOF—b:0-2"), (3, "a:3-5—a:EOF"), (4, "a:3-5—b:EOF"), (5, "x:y:1-2")], "doc_id long, pointer string")
    got = {r.doc_id: [tuple(p) for p in r.p] for r in rows.select("doc_id", packing.parse_pointer(F.col("pointer")).alias("p")).collect()}
    assert got == {1: [("a.b", 3, 5)], 2: [("a", 3, None), ("b", 0, 2)], 3: [("a", 3, 5)], 4: [("a", 3, 5), ("b", 0, None)], 5: [("x:y", 1, 2)]}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ranks(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(k, None if k % 17 == 0 else float(rng.integers(0, 9)), k, None if k % 5 == 0 else int(k % 3)) for k in range(120)]
    scores = spark.createDataFrame(rows, "doc_id long, ai_score double, total_tokens_seen long, lang int").repartition(parts)
    high = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[2]))
    assert {r.doc_id for r in ranking.select(scores, 30).collect()} == {r[0] for r in high[:36]}
    low = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert {r.doc_id for r in ranking.select(scores, bottom=5).collect()} == {r[0] for r in low[:6]}
    want = set()
    for lang in (None, 0, 1, 2):
        own = [r for r in high if r[3] == lang]
        want |= {r[0] for r in own[: ranking.how_many(len(own), 10)]}
    got = ranking.select(scores, 10, by="lang")
    assert got.columns == scores.columns and {r.doc_id for r in got.collect()} == want


@pytest.mark.parametrize(("bins", "few"), [(8, 3), (1024, 1000)])
def test_selection_of_any_numbers(spark, monkeypatch, bins, few):
    """Nulls, NaN, infinities, the smallest and the largest doubles, ties and rows that nothing tells apart."""
    monkeypatch.setattr(ranking, "BINS", bins)
    monkeypatch.setattr(ranking, "FEW", few)
    odd = [None, math.nan, math.inf, -math.inf, 5e-324, 1e-323, -5e-324, 0.0, -0.0, 1.7e308, -1.7e308, 1.0, 1.0, 1.0, 1.0]
    rows = [(k, x, seen) for k, (x, seen) in enumerate(zip(odd * 2, [*range(12), 99, 99, 99, *range(20, 34), None], strict=True))]
    scores = spark.createDataFrame(rows, "__k long, ai_score double, total_tokens_seen long")

    def place(r, up):
        x = r[1]
        kind = -1 if x is None else 0
        key = (math.inf if up else -math.inf, 1) if x is not None and math.isnan(x) else ((x if up else -x) if x is not None else 0.0, 0)
        if x is not None and math.isnan(x):
            key = (math.inf, 1) if up else (-math.inf, -1)
        return (kind, *key, -1 if r[2] is None else r[2])

    for up in (False, True):
        order = [place(r, up) for r in sorted(rows, key=lambda r: place(r, up))]
        for per_cent in (50,) if few < 1000 else (1, 70, 120):
            got = ranking.select(scores, per_cent, per_cent if up else None)
            assert got.columns == scores.columns
            want = order[: ranking.how_many(len(rows), per_cent)]
            assert sorted(place(r, up) for r in got.collect()) == want
    assert ranking.select(scores.limit(0), 20).collect() == []


def test_selection_sorts_nothing(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 100)
    rows = spark.range(50_000).selectExpr("id total_tokens_seen", "cast(pmod(xxhash64(id), 1000000) as double) / 1e6 ai_score").checkpoint()
    got = ranking.select(rows, 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 10_000 and "Sort" not in plan and "rangepartitioning" not in plan


def test_shards_of_any_size(spark):
    rows = placed(spark, 2, 5, 9, 1, 30).withColumn("tokens", F.expr("transform(sequence(total_tokens_seen - n_tokens, total_tokens_seen - 1), x -> cast(x as int))"))
    for size, block in ((7, 3), (5, 8), (47, 4), (10, 5)):
        got = sorted((r.shard, r.at, r.block, r.tokens) for r in packing.slices(rows, size, block).collect())
        assert [t for *_, x in got for t in x] == list(range(47))
        assert all(x[0] == s * size + a and b == a // block == (a + len(x) - 1) // block and a + len(x) <= size for s, a, b, x in got)


def test_small_pools_are_used_up(spark):
    pool = spark.createDataFrame([(k, 0, f"sentence {k}", 5) for k in range(61)], "doc_id long, sent_no int, sentence string, n_tok long")
    got = probes.contexts(pool, 5, "s").groupBy("probe_id").agg(F.count_distinct("sentence").alias("n"), F.max("pos").alias("last")).collect()
    assert [(r.n, r["last"]) for r in got] == [(60, 59)] * 5


@pytest.mark.parametrize("n", [1, 2, 7, 30, 100, 577])
def test_permutations(spark, n):
    """Every place once for every key, and different orders for different keys."""
    places = spark.range(3 * n).selectExpr(f"cast(id div {n} as int) p", f"id % {n} i")
    got = {}
    for r in probes.drawn(places, n, "p").collect():
        got.setdefault(r.p, {})[r.i] = r.number
    assert len(got) == 3 and all(sorted(x.values()) == sorted(x) == list(range(n)) for x in got.values())
    assert n < 30 or len({tuple(x[i] for i in range(n)) for x in got.values()}) == 3


@pytest.mark.parametrize(("n", "size"), [(3, 5), (5, 5), (61, 60), (200, 60)])
def test_draws_without_replacement(spark, n, size):
    pool = spark.createDataFrame([(k, 0, f"sentence {k}", 5) for k in range(n)], "doc_id long, sent_no int, sentence string, n_tok long")
    got = probes.contexts(pool, 4, "s", size).groupBy("probe_id").agg(F.count_distinct("sentence").alias("n"), F.count("*").alias("rows"), F.max("pos").alias("last")).collect()
    assert [(r.n, r.rows, r["last"]) for r in got] == [(min(n, size), min(n, size), min(n, size) - 1)] * 4


def test_drawn_sentences_are_the_numbered_ones_and_others_stay(spark):
    """Numbers go by doc_id and sent_no; only documents that are drawn from are sorted."""
    rows = [(d, 2 * i, f"d{d} s{i}", 5) for d in (9, 3, 4, 1) for i in range(d % 5)]
    sents = spark.createDataFrame(rows, "doc_id long, sent_no int, sentence string, n_tok long")
    want = [s for _, _, s, _ in sorted(rows)]
    known = probes.firsts(sents)
    for ids in ([0], list(range(len(want))), [1, 4, len(want) - 1]):
        asked = spark.createDataFrame([(i,) for i in ids], "sent_id long")
        assert sorted(probes.picked(sents, known, asked).collect()) == [(i, want[i]) for i in ids]
