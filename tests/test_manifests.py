"""Shards that a manifest names: nothing is seen before it is there, whatever has been lost."""

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from test_streams import source, split

from siftwork.sources import shards


def batch(shard, *tokens):
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([0]), pa.array([list(tokens)], pa.list_(pa.int32()))], names=["shard", "at", "tokens"])


def names(folder):
    return [(r["shard"], r["tokens"]) for r in source(f"{folder}/*.bin")[0]]


def test_lost_tasks_and_commits(tmp_path):
    folder = tmp_path / "out"
    writer = shards._Writer(str(folder), manifest=True)
    first = writer.write(iter([batch("a", 5, 2), batch("b", 7, 2)]))
    # A task that is lost in the midst of a shard, and one whose attempt is repeated.
    with pytest.raises(ValueError):
        writer.write(iter([batch("c", 8), batch("c", 70_000)]))
    writer.write(iter([batch("c", 9, 2)]))
    again = writer.write(iter([batch("c", 9, 2)]))
    assert len(list(folder.glob("*.tokens"))) == 5 and names(folder) == []
    writer.commit([first, None, again])
    assert names(folder) == [("a", [5, 2]), ("b", [7, 2]), ("c", [9, 2])]
    assert not list(folder.glob("*.bin")) and shards.exists(f"{folder}/b*.bin") and not shards.exists(f"{folder}/x*.bin")
    # A commit that is cut off anywhere lists nothing.
    late = writer.write(iter([batch("d", 3, 2)]))
    (whole,) = folder.glob("_manifest.*")
    before = whole.read_bytes()
    writer.commit([late])
    (new,) = {*folder.glob("_manifest.*")} - {whole}
    content = new.read_bytes()
    for n in (0, 1, 64, 65, 70, len(content) - 1):
        new.write_bytes(content[:n])
        assert [s for s, _ in names(folder)] == ["a", "b", "c"]
    new.write_bytes(content)
    assert [s for s, _ in names(folder)] == ["a", "b", "c", "d"] and whole.read_bytes() == before
    # An aborted job takes its files with it.
    gone = writer.write(iter([batch("e", 1)]))
    writer.abort([gone, None])
    assert not list(folder.glob("e.*"))
    # The same shard from two commits is an error, not a choice.
    writer.commit([writer.write(iter([batch("a", 1)]))])
    with pytest.raises(ValueError, match="twice"):
        names(folder)


def test_through_spark(spark, tmp_path):
    rows = [(f"s{k}", 0, [k + 3, 2, 9]) for k in range(6)]
    for k in (0, 3):
        shards.write(spark.createDataFrame(rows[k : k + 3], "shard string, at long, tokens array<int>"), str(tmp_path / "out"), manifest=True)
    path = f"{tmp_path}/out/*.bin"
    assert sorted((r.shard, r.tokens) for r in shards.read(spark, path).collect()) == [(s, t) for s, _, t in rows]
    assert [r.shard for r in shards.read(spark, path).where("shard > 's3'").orderBy("shard").collect()] == ["s4", "s5"]
    assert {r.shard: r.n_tokens for r in shards.headers(spark, path).collect()} == {s: 3 for s, _, _ in rows}
    want = split(spark, path)
    assert [d for d, _, _ in want][:2] == ["s0:0-1", "s0:2-2—s1:0-1"] and len(want) == 7
    listed = [json.loads(Path(p).read_bytes().partition(b"\n")[2]) for p in (tmp_path / "out").glob("_manifest.*")]
    assert sorted(s for part in listed for s, _ in part) == [s for s, _, _ in rows]
    # The same as plain files.
    shards.write(spark.createDataFrame(rows, "shard string, at long, tokens array<int>"), str(tmp_path / "plain"))
    assert split(spark, f"{tmp_path}/plain/*.bin") == want
    assert np.array_equal(shards.decode((tmp_path / "plain/s0.bin").read_bytes()), [3, 2, 9])
