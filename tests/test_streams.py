"""Shards of any sizes: traced cases, random ones against plain Python, filters and the bytes that are read for them."""

import builtins
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringStartsWith

from siftwork.operators import scoring, streams
from siftwork.operators.prefix import carried, prefix_sum
from siftwork.sources import shards

EOT = 2


def written(folder, **contents):
    for name, tokens in contents.items():
        (folder / f"{name}.bin").write_bytes(shards.encode(np.array(tokens, dtype=np.int64)))
    return f"{folder}/*.bin"


def split(spark, path, block=4, **options):
    pieces, known = streams.read(spark, path, block=block, **options)
    return [(r.doc_id, r.tokens, r.total_tokens_seen) for r in streams.split(pieces, known, block=block).orderBy("total_tokens_seen").collect()]


def plain(contents):
    """(pointer, tokens, seen) by walking through the shards."""
    out, own, seen = [], [], 0
    for name in sorted(contents):
        for at, t in enumerate(contents[name]):
            own.append((name, at, t))
            if t == EOT:
                out.append(own)
                own = []
    found = []
    for doc in [*out, *([own] if own else [])]:
        seen += len(doc)
        names = list(dict.fromkeys(n for n, _, _ in doc))
        spans = [(n, [a for m, a, _ in doc if m == n]) for n in names]
        found.append(("—".join(f"{n}:{a[0]}-{a[-1]}" for n, a in spans), [t for _, _, t in doc], seen))
    return found


@pytest.mark.parametrize(
    ("contents", "want"),
    [
        (dict(s1=[5, 6, 2, 7], s2=[8, 2, 9, 2], s3=[10, 11]), [("s1:0-2", [5, 6, 2], 3), ("s1:3-3—s2:0-1", [7, 8, 2], 6), ("s2:2-3", [9, 2], 8), ("s3:0-1", [10, 11], 10)]),
        (dict(s1=[5, 2, 7], s2=[8, 9], s3=[10, 2]), [("s1:0-1", [5, 2], 2), ("s1:2-2—s2:0-1—s3:0-1", [7, 8, 9, 10, 2], 7)]),
        (dict(s1=[5, 2, 7], s2=[8]), [("s1:0-1", [5, 2], 2), ("s1:2-2—s2:0-0", [7, 8], 4)]),
        (dict(s1=[2, 5, 2]), [("s1:0-0", [2], 1), ("s1:1-2", [5, 2], 3)]),
        (dict(s1=[5, 6], s2=[], s3=[2]), [("s1:0-1—s3:0-0", [5, 6, 2], 3)]),
        (dict(s1=[], s2=[]), []),
    ],
)
def test_traced_cases(spark, tmp_path, contents, want):
    assert split(spark, written(tmp_path, **contents)) == want
    assert plain(contents) == want


@pytest.mark.parametrize("seed", range(2))
def test_like_plain_python(spark, tmp_path, seed):
    rng = random.Random(seed)
    contents = {f"x{k:02d}": [2 if rng.random() < 0.1 else rng.randint(3, 65_535) for _ in range(rng.choice([0, 1, 2, 7, 40, 90]))] for k in range(9)}
    path = written(tmp_path, **contents)
    want = plain(contents)
    assert split(spark, path) == want
    assert split(spark, path, block=1000) == want
    for limit in (0, 17, 10_000):
        pieces, known = streams.read(spark, path, max_tokens=limit, block=4)
        got = scoring.until(streams.split(pieces, known, block=4), limit).orderBy("total_tokens_seen").collect()
        assert [(r.doc_id, r.total_tokens_seen) for r in got] == [(p, n) for p, t, n in want if n - len(t) < limit or n == len(t)]


def test_orders_of_shards(spark, tmp_path):
    path = written(tmp_path, fineweb_val_000000=[5, 2, 7], fineweb_train_000001=[8, 2], fineweb_train_000010=[9, 2])
    assert [d for d, _, _ in split(spark, path, order="number")] == ["fineweb_val_000000:0-1", "fineweb_val_000000:2-2—fineweb_train_000001:0-1", "fineweb_train_000010:0-1"]
    assert [d for d, _, _ in split(spark, path)][0] == "fineweb_train_000001:0-1"
    assert [d for d, _, _ in split(spark, path, order="number", max_tokens=3)] == ["fineweb_val_000000:0-1", "fineweb_val_000000:2-2—fineweb_train_000001:0-1"]
    with pytest.raises(ValueError, match="order"):
        streams.spans(shards.headers(spark, path), "size")


def test_stream_goes_to_shards_of_any_sizes_and_back(spark, tmp_path):
    rng = random.Random(9)
    lengths = [rng.randint(1, 60) for _ in range(40)]
    seen = np.cumsum(lengths).tolist()
    rows = [(n, s, [rng.randint(3, 99) for _ in range(n - 1)] + [2]) for n, s in zip(lengths, seen, strict=True)]
    tokens = spark.createDataFrame(rows, "n_tokens long, total_tokens_seen long, tokens array<int>")
    sizes, start, known = [30, 1, 2, 200, 7], 0, []
    while start < seen[-1]:
        n = min(sizes[len(known) % 5], seen[-1] - start)
        known.append((f"part_{len(known):03d}", n, start))
        start += n
    shards.write(streams.slices(tokens, spark.createDataFrame(known, "shard string, n long, start long"), 16), str(tmp_path / "out"))
    assert {p.stem: len(shards.decode(p.read_bytes())) for p in (tmp_path / "out").glob("*.bin")} == {k: n for k, n, _ in known}
    assert [t for _, t, _ in split(spark, str(tmp_path / "out/*.bin"), block=16)] == [t for _, _, t in rows]


def test_carried_values(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, None, i * 10]), rng.choice([None, str(i)])) for i in range(200)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "o int, v int, __part string")
    got = {r.o: (r.last_v, r.last_w) for r in carried(frame, "o", {"v": "last_v", "__part": "last_w"}).collect()}
    before = {r.o: r.b for r in carried(frame, "o", {"v": "b"}, itself=False).collect()}
    v = w = None
    for o, a, b in sorted(rows):
        assert before[o] == v
        v, w = a if a is not None else v, b if b is not None else w
        assert got[o] == (v, w)
    assert sorted(prefix_sum(frame, "o", "v", "t").columns) == ["__part", "o", "t", "v"]


@pytest.fixture
def counted(monkeypatch):
    """Bytes that are read of files opened in this process."""
    total = [0]
    real = builtins.open

    def counting(*a, **b):
        f = real(*a, **b)
        if "b" in str(a[1:2]):
            inner = f.read

            class Counted:
                def __enter__(self):
                    return self

                def __exit__(self, *x):
                    f.close()

                def __getattr__(self, name):
                    return getattr(f, name)

                def read(self, n=-1):
                    got = inner(n)
                    total[0] += len(got)
                    return got

            return Counted()
        return f

    monkeypatch.setattr(shards, "open", counting, raising=False)
    return total


def source(path, *filters, block=16, **options):
    reader = shards._Reader({"path": path, "block": str(block), **options})
    left = list(reader.pushFilters(list(filters)))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return rows, left


def test_filters_become_files_and_bytes(tmp_path, counted):
    path = written(tmp_path, a1=range(1000), a2=range(1000, 2000), b1=range(50))
    every, _ = source(path)
    whole = counted[0]
    assert whole == 3 * 1024 + 2 * 2050
    at, block, shard = ("at",), ("block",), ("shard",)
    cases = [
        ([EqualTo(shard, "b1")], lambda r: r["shard"] == "b1", 1, 50),
        ([StringStartsWith(shard, "a"), LessThan(at, 40)], lambda r: r["shard"] < "b" and r["at"] < 40, 2, 2 * 48),
        ([In(shard, ("a2", "zz")), GreaterThanOrEqual(block, 60)], lambda r: r["shard"] == "a2" and r["block"] >= 60, 1, 1000 - 960),
        ([In(block, (0, 1, 7)), LessThanOrEqual(shard, "a1")], lambda r: r["shard"] == "a1" and r["block"] in (0, 1, 7), 2, 48),
        ([EqualTo(at, 16), IsNotNull(at)], lambda r: r["at"] == 16, 3, 48),
        ([EqualTo(at, 17)], lambda r: r["at"] == 17, 3, 48),
    ]
    for filters, keeps, heads, tokens in cases:
        counted[0] = 0
        rows, left = source(path, *filters)
        assert rows == [r for r in every if keeps(r)]
        assert left == []
        assert counted[0] == heads * 1024 + 2 * tokens, filters
    other = [StringContains(shard, "a"), Not(EqualTo(at, 0)), EqualTo(("at", "x"), 1), EqualTo(at, None)]
    rows, left = source(path, *other)
    assert left == other
    assert rows == every


def test_filters_with_a_range_and_small_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(shards._Reader, "RANGE", 64)
    path = written(tmp_path, a=range(1000))
    every, _ = source(path, block=24, lo="5", hi="700")
    assert [r["at"] for r in every] == [5, *range(24, 701, 24)]
    rows, _ = source(path, GreaterThanOrEqual(("at",), 30), LessThan(("block",), 9), block=24, lo="5", hi="700")
    assert rows == [r for r in every if r["at"] >= 30 and r["block"] < 9]


def test_files_that_are_cut_off(tmp_path):
    good = shards.encode(np.arange(10))
    for name, content in (("short", good[:-2]), ("bare", good[:1024]), ("head", good[:100])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.bin").write_bytes(content)
        with pytest.raises(ValueError):
            source(f"{tmp_path}/{name}/*.bin")


def test_filters_through_spark(spark, tmp_path):
    path = written(tmp_path, a1=range(100), a2=range(100), b1=[])
    rows = shards.read(spark, path, block=16)
    got = rows.where((F.col("shard") == "a2") & (F.col("at") >= 30) & (F.size("tokens") > 4) & (F.col("block") != 3))
    assert sorted(r.at for r in got.collect()) == [32, 64, 80]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "size(tokens" in plan and "shard" not in plan.split("Filter")[1].split("\n")[0]
    assert rows.where("shard is null").count() == 0 and rows.where("at = 0 or block = 2").count() == 4


def test_early_stop_reads_what_the_limit_needs(spark, tmp_path):
    """One shard more, then two: those behind them aren't opened at all, and here are broken."""
    path = written(tmp_path, s1=[5, 6, 2, 7], s2=[8, 9], s3=[10, 2], s4=[11, 2])
    (tmp_path / "s5.bin").write_bytes(shards.header(4))
    assert [d for d, _, _ in split(spark, path, max_tokens=4)] == ["s1:0-2", "s1:3-3—s2:0-1—s3:0-1", "s4:0-1"]
    with pytest.raises(Exception, match="cut off"):
        split(spark, path)


def test_short_shards_share_tasks(tmp_path):
    """A task for each shard made reading hundreds of thousands of them a matter of hours."""
    path = written(tmp_path, **{f"s{k:04d}": range(k % 7) for k in range(3000)})
    reader = shards._Reader({"path": path, "block": "4"})
    parts = reader.partitions()
    assert len(parts) < 10
    batches = [b for p in parts for b in reader.read(p)]
    assert len(batches) < 10
    rows = [r for b in batches for r in b.to_pylist()]
    assert rows == [{"shard": f"s{k:04d}", "block": at // 4, "at": at, "tokens": list(range(at, min(at + 4, k % 7)))} for k in range(3000) for at in range(0, k % 7, 4)]


def test_short_shards_share_tasks_of_sparks_reader(spark, tmp_path):
    path = written(tmp_path, **{f"s{k:04d}": range(k % 7) for k in range(1000)}, **{"x,y": [9]})
    rows = shards.read_with_spark(spark, path, block=4)
    assert rows.rdd.getNumPartitions() <= max(3, 4 * spark.sparkContext.defaultParallelism)
    assert len(rows.inputFiles()) == 1001
    assert sorted((r.shard, r.at, r.tokens) for r in rows.collect()) == sorted([*((f"s{k:04d}", at, list(range(at, min(at + 4, k % 7)))) for k in range(1000) for at in range(0, k % 7, 4)), ("x,y", 0, [9])])
