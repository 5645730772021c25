import random

import pytest
from pyspark.sql import functions as F

from siftwork.llm import suffixes
from siftwork.llm.bwt import Shard, repeats


def texts() -> dict[int, str | None]:
    rng = random.Random(11)

    def prose(n):
        return "".join(rng.choice("abcdefgh éß\n") for _ in range(n))

    shared = [prose(rng.choice([99, 100, 101, 130, 400])) for _ in range(8)]
    out: dict[int, str | None] = {3: None, 4: "", 5: "short", 6: "a" * 700, 7: "ab" * 300, 8: "xyz" * 90 + prose(50)}
    for _ in range(60):
        parts = [rng.choice([prose(rng.randint(0, 300)), rng.choice(shared)]) for _ in range(rng.randint(1, 5))]
        out[len(out) * 2 + 20] = "".join(parts)
    for k in list(out)[10:20]:
        t = out[k] or "x"
        p = rng.randrange(len(t))
        out[1000 + k] = t[:p] + "#" + t[p + 1 :]
        out[2000 + k] = t
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_like_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    t = texts()
    docs = spark.createDataFrame(list(t.items()), "doc_id long, text string").selectExpr("doc_id", "text", "1 as lo", "2 as spans").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs).collect()}
    assert got == suffixes.reference(t)


def test_edges(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdef ") for _ in range(300))
    rows = [(None, long), (None, long), (2, long), (1, long), (1, long), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.digest(docs).collect())
    assert got == [(-1, 300, 0, 0), (-1, 300, 0, 0), (1, 300, 0, 0), (1, 300, 0, 0), (2, 300, 300, 1), (9, 0, 0, 0)]
    kept = sorted((r.doc_id or -1, r.text) for r in suffixes.strip(docs).collect() if r.text)
    assert kept == [(-1, long), (-1, long), (1, long), (1, long)]
    assert suffixes.strip(docs).where("doc_id = 9").count() == 1
    assert suffixes.digest(docs.limit(0)).count() == 0


def test_characters_stay_whole():
    assert suffixes.strip_text("aéb", [{"lo": 0, "hi": 2}]) == "éb"
    assert suffixes.strip_text("aéb", [{"lo": 2, "hi": 4}]) == "aé"
    assert suffixes.strip_text("aéb", [{"lo": 1, "hi": 9}]) == "a"
    assert suffixes.strip_text(None, [{"lo": 1, "hi": 9}]) is None


def test_merged_transforms():
    rng = random.Random(2)
    for _ in range(200):
        s = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        k, cut = rng.randint(1, 16), rng.randint(0, len(s))
        parts = [p for p in (s[:cut], s[cut:]) if p]
        for p in parts:
            shard = Shard(p, 64)
            rest = [p[t][a:] for t, a in zip(shard.text, shard.at, strict=True)]
            assert rest == sorted(rest)
        places: dict[bytes, set] = {}
        for i, x in enumerate(s):
            for a in range(len(x) - k + 1):
                places.setdefault(x[a : a + k], set()).add((i, a))
        found: dict[int, set] = {}
        for b, shard, t, a in zip(*repeats([Shard(p, k) for p in parts], k), strict=True):
            found.setdefault(int(b), set()).add((int(t) + (len(parts[0]) if shard else 0), int(a)))
        assert {frozenset(x) for x in found.values()} == {frozenset(x) for x in places.values() if len(x) > 1}


def test_clashing_names(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdef ") for _ in range(300))
    names = ["spans", "removed_spans", "span_doc_id", "new", "old", "lo", "anchor", "_spans"]
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + "end")], "doc_id long, text string").selectExpr("*", *(f"concat('{n}', doc_id) as {n}" for n in names))
    rows = suffixes.strip(docs).collect()
    assert {r.doc_id: r.text for r in rows} == {1: long, 3: "end"}
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert suffixes.digest(docs).count() == 3


def test_long_texts(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefghij ", k=400_000))
    t = {1: long, 2: "start " + long[150_000:350_000] + " end", 3: "aé" * 100_000}
    docs = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs).collect()}
    assert got == suffixes.reference(t)


def test_slices(spark, monkeypatch):
    """Slice by slice the result is the same, and no table outlives the step that reads it."""
    t, alive, real = texts(), {}, suffixes.Scratch.keep

    def keep(self, rows, name):
        alive.setdefault(name, set()).update(p.rpartition("/")[2].rpartition("-")[0] for p in self.paths)
        return real(self, rows, name)

    monkeypatch.setattr(suffixes.Scratch, "keep", keep)
    docs = spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(3)
    for sliced in (0, 1 << 20):
        alive.clear()
        spans = {r.doc_id: [(s["lo"], s["hi"]) for s in r.spans] for r in suffixes.repeated_spans(docs, sliced=sliced).collect()}
        want = suffixes.reference(t)
        found = {i: suffixes.union([{"lo": a, "hi": b} for a, b in s], want[i][0]) for i, s in spans.items()}
        assert {i: (sum(b - a for a, b in s), len(s)) for i, s in found.items()} == {i: w[1:3] for i, w in want.items() if w[1]}
        assert not alive["parts"] & {"shared", "live", "firsts", "judged", "wanted"} and not alive["bodies"] & {"parts", "settled", "ruled"}


def test_texts_are_read_three_times(spark):
    """Anchors, parts and their bytes take one pass over the texts each."""
    t, reads = texts(), spark.sparkContext.accumulator(0)

    def read(text):
        reads.add(1)
        return text

    docs = spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(3).withColumn("text", F.udf(read, "string").asNondeterministic()("text"))
    want = {i: w[1:3] for i, w in suffixes.reference(t).items() if w[1]}
    found = {r.doc_id: [(s["lo"], s["hi"]) for s in r.spans] for r in suffixes.repeated_spans(docs).collect()}
    cut = {i: suffixes.union([{"lo": a, "hi": b} for a, b in s], len((t[i] or "").encode())) for i, s in found.items()}
    assert {i: (sum(b - a for a, b in s), len(s)) for i, s in cut.items()} == want
    assert 0 < reads.value <= 3 * len(t)


def test_copies_do_not_meet_in_one_task(spark):
    """Of copies in a batch one row stands for an anchor; the others have keys of their own. Copies in other batches meet that row."""
    rng = random.Random(8)
    long = "".join(rng.choice("abcdef ") for _ in range(500))
    docs = spark.createDataFrame([(i, long) for i in range(50)], "doc_id long, text string").coalesce(1)
    most = suffixes._occurrences(docs, suffixes.LENGTH, suffixes.GRAM).groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert most == 1
    got = {r.doc_id: r.n_removed for r in suffixes.digest(docs.repartition(7)).collect()}
    assert got == {i: 500 if i else 0 for i in range(50)}
