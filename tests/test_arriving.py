"""Documents of shards that arrive in any order, with restarts, are those of the whole stream."""

import random

import numpy as np
import pytest
from test_streams import plain

from siftwork.sources import arriving, shards
from siftwork.streaming import documents


def contents_of(seed, n):
    rng = random.Random(seed)
    return {f"s_{k:03d}": [2 if rng.random() < 0.15 else rng.randint(3, 65_535) for _ in range(rng.choice([0, 1, 3, 9, 40]))] for k in range(n)}


def put(folder, name, tokens):
    (folder / f"{name}.bin").write_bytes(shards.encode(np.array(tokens, dtype=np.int64)))


@pytest.mark.parametrize("seed", [5, 6])
def test_any_order_and_restarts(spark, tmp_path, seed):
    contents = contents_of(seed, 14)
    # One document over five shards, some of them empty.
    contents |= {"s_004": [7, 2, 8], "s_005": [9, 9], "s_006": [], "s_007": [10], "s_008": [11, 2, 12], "s_013": [7, 2, 5]}
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    names = list(contents)
    random.Random(seed).shuffle(names)
    want = sorted((p, t) for p, t, _ in plain(contents))
    for part in (names[:6], names[6:]):
        for name in part:
            put(folder, name, contents[name])
        documents.run(spark, str(folder), out, state, most=4)
        got = sorted((r.doc_id, r.tokens) for r in documents.read(spark, out).collect())
        assert all(g in want for g in got) and len(got) < len(want)
    arriving.finish(str(folder), len(contents))
    documents.run(spark, str(folder), out, state)
    rows = documents.read(spark, out).collect()
    assert sorted((r.doc_id, r.tokens) for r in rows) == want
    assert all(r.n_tokens == len(r.tokens) for r in rows)
    # Nothing new, nothing again.
    documents.run(spark, str(folder), out, state)
    assert documents.read(spark, out).count() == len(want)


@pytest.mark.parametrize("step", [1, 3, 1 << 20])
def test_parts_of_a_shard(tmp_path, monkeypatch, step):
    monkeypatch.setattr(arriving, "STEP", step)
    for tokens in ([2], [5], [], [5, 2], [2, 5], [5, 6, 2, 7, 2, 8, 9], [2, 2, 5, 2]):
        put(tmp_path, "x_3", tokens)
        with (s := arriving._Shard(str(tmp_path / "x_3.bin"))).file:
            edges, whole = list(s.edges(2)), list(s.documents(2))
        parts = {k: (b, c, p, np.frombuffer(t, "<u2").tolist()) for b, k, c, p, t in edges}
        ends = [i for i, t in enumerate(tokens) if t == 2]
        if not ends:
            assert parts == {"head": (3, False, f"x_3:0-{len(tokens) - 1}" if tokens else "", tokens)}
            assert whole == []
            continue
        assert parts["head"] == (3, True, f"x_3:0-{ends[0]}", tokens[: ends[0] + 1])
        assert parts["tail"][0] == 4 and parts["tail"][3] == tokens[ends[-1] + 1 :]
        assert [np.frombuffer(r[-1], "<u2").tolist() for r in whole] == [tokens[a + 1 : b + 1] for a, b in zip(ends, ends[1:])]
        assert [r[3] for r in whole] == [f"x_3:{a + 1}-{b}" for a, b in zip(ends, ends[1:])]


def test_edges_are_read_without_what_lies_between(tmp_path, monkeypatch):
    monkeypatch.setattr(arriving, "STEP", 10)
    put(tmp_path, "x_0", [5, 2] + [7] * 500 + [2] + [8] * 500 + [2, 9])
    s = arriving._Shard(str(tmp_path / "x_0.bin"))
    read, real = [], s.tokens
    s.tokens = lambda lo, hi: read.append(hi - lo) or real(lo, hi)
    with s.file:
        assert [r[1] for r in s.edges(2)] == ["tail", "head", "tail"]
    assert sum(read) < 40


def test_offsets_survive_a_restart(tmp_path):
    (tmp_path / "in").mkdir()
    options = {"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "most": "2"}
    one = arriving._Reader(options)
    assert one.initialOffset() == one.latestOffset() == {"entry": 0}
    for k in (5, 1, 3):
        put(tmp_path / "in", f"x_{k}", [2])
    assert one.latestOffset() == {"entry": 1}
    first = [p.path for p in one.partitions({"entry": 0}, {"entry": 1})]
    put(tmp_path / "in", "x_0", [2])
    two = arriving._Reader(options)
    assert two.latestOffset() == {"entry": 2}
    assert [p.path for p in two.partitions({"entry": 0}, {"entry": 1})] == first
    rest = [p.path for p in two.partitions({"entry": 1}, two.latestOffset())]
    assert len({*first, *rest}) == 4 and two.latestOffset() == one.latestOffset() == {"entry": 2}
    with pytest.raises(ValueError, match="number"):
        arriving.number_of("/a/shard.bin")


def test_batches_grow_with_what_waits(tmp_path):
    """A long backlog takes few batches, and few tasks each; every file comes once."""
    (tmp_path / "in").mkdir()
    for k in range(1000):
        put(tmp_path / "in", f"x_{k:04d}", [k + 3, 2])
    reader, at, batches, tasks, rows = arriving._Reader({"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "most": "10", "part": "edges"}), {"entry": 0}, 0, [], []
    while (to := reader.latestOffset()) != at:
        parts = reader.partitions(at, to)
        at, batches = to, batches + 1
        tasks.append(len(parts))
        rows += [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert batches < 30 and max(tasks) <= arriving.TASKS
    assert sorted(r["pointer"] for r in rows if r["kind"] == "head") == [f"x_{k:04d}:0-1" for k in range(1000)]


def test_large_shards_have_tasks_of_their_own(tmp_path):
    paths = [str(tmp_path / f"x_{k}") for k in range(9)]
    for k, p in enumerate(paths):
        open(p, "wb").write(b"0" * (10 if k % 3 else 100))
    assert [len(x) for x in arriving.grouped(paths, 3, 100)] == [1, 2, 1, 2, 1, 2]
    assert [len(x) for x in arriving.grouped(paths, 9, 100)] == [1] * 9
