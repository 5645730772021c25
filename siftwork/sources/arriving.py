"""Token shards as a stream: a data source of what has arrived, in whatever order.

Shards are numbered 0, 1, ... by the numbers that their names end in. A shard gives its whole documents, or (option part=edges) what it has at its ends: a head, the tokens up to
the first end of a document, and a tail, those behind the last one. A head belongs to the boundary before its shard, a tail to the one behind
it; both are read by seeking from the ends, without what lies between.

Which files make up which offset is written to a log folder, so that a restarted query gets the same rows again.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from glob import glob
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from siftwork.functions.tokens import EOS
from siftwork.sources.shards import HEADER, count_of, local

#: boundary: the number of the shard behind it, null for a whole document. kind: document, tail, or head; closed: whether a head has its end. tokens: as in shards, 16 bits each.
SCHEMA = "boundary long, kind string, closed boolean, pointer string, tokens binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Name of the file that says how many shards there are, once that is known.
END = "end.json"
#: Tokens that are read at a time.
STEP = 1 << 20
#: A batch takes one in so many of the files that wait, where these are more than its files otherwise: batches grow with what is behind.
SHARE = 4
#: Tasks of a batch from which on short shards share one, and bytes of the files of such a task, about.
TASKS, TASK_BYTES = 64, 16 << 20


def number_of(path: str) -> int:
    found = re.search(r"(\d+)$", Path(path).stem)
    if not found:
        raise ValueError(f"a shard's name ends in its number: {path}")
    return int(found[1])


class _Files(InputPartition):
    def __init__(self, path: str, *more: str):
        self.path, self.more = path, more


def grouped(paths: list[str], tasks: int = TASKS, size: int = TASK_BYTES) -> list[list[str]]:
    """The paths in order, a list a task: one each for `tasks` paths at most, and otherwise several, while they are small."""
    most, out, held = -(-len(paths) // tasks), [], 0
    for p in paths:
        n = os.path.getsize(p) if most > 1 else 0
        if not out or len(out[-1]) == most or held + n > size:
            out.append([])
            held = 0
        out[-1].append(p)
        held += n
    return out


def _row(boundary: int | None, kind: str, closed: bool, name: str, lo: int, tokens: np.ndarray) -> tuple:
    pointer = f"{name}:{lo}-{lo + len(tokens) - 1}" if len(tokens) else ""
    return boundary, kind, closed, pointer, tokens.astype("<u2").tobytes()


class _Shard:
    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115  closed by its reader
        self.name, self.number, self.n = Path(path).stem, number_of(path), count_of(self.file.read(4 * HEADER))

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        self.file.seek(4 * HEADER + 2 * lo)
        body = self.file.read(2 * (hi - lo))
        if len(body) != 2 * (hi - lo):
            raise ValueError("a token shard that is cut off")
        return np.frombuffer(body, dtype="<u2")

    def head(self, eot: int) -> int:
        """Tokens up to the first end, it included; -1 without one."""
        for lo in range(0, self.n, STEP):
            at = np.nonzero(self.tokens(lo, min(self.n, lo + STEP)) == eot)[0]
            if len(at):
                return lo + int(at[0]) + 1
        return -1

    def tail(self, eot: int) -> int:
        """Place behind the last end of a shard that has one."""
        hi = self.n
        while True:
            lo = max(0, hi - STEP)
            at = np.nonzero(self.tokens(lo, hi) == eot)[0]
            if len(at):
                return lo + int(at[-1]) + 1
            hi = lo

    def edges(self, eot: int) -> Iterator[tuple]:
        head = self.head(eot)
        if self.number == 0:
            yield _row(0, "tail", False, self.name, 0, np.zeros(0))
        if head < 0:
            yield _row(self.number, "head", False, self.name, 0, self.tokens(0, self.n))
            return
        yield _row(self.number, "head", True, self.name, 0, self.tokens(0, head))
        tail = self.tail(eot)
        yield _row(self.number + 1, "tail", False, self.name, tail, self.tokens(tail, self.n))

    def documents(self, eot: int) -> Iterator[tuple]:
        """The documents that begin and end in the shard, but for the first, which may have begun before."""
        first = self.head(eot)
        if first < 0:
            return
        own, start = [], first
        for lo in range(first, self.n, STEP):
            part = self.tokens(lo, min(self.n, lo + STEP))
            done = 0
            for at in (np.nonzero(part == eot)[0] + 1).tolist():
                own.append(part[done:at])
                whole = np.concatenate(own)
                yield _row(None, "document", True, self.name, start, whole)
                own, start, done = [], start + len(whole), at
            own.append(part[done:])


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.log = local(options["path"]), local(options["log"])
        self.part, self.eot, self.most = options.get("part", "documents"), int(options.get("eot", EOS)), int(options.get("most", 1 << 20))

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def _entry(self, k: int) -> str:
        return f"{self.log}/{k:012d}.json"

    def _listed(self, start: int, end: int) -> list[str]:
        return [p for k in range(start, end) for p in json.loads(Path(self._entry(k)).read_text())]

    def latestOffset(self) -> dict:
        """Behind the log's last entry; what has arrived since is written as a new one first, `most` files at a time, or one in SHARE where that is more."""
        os.makedirs(self.log, exist_ok=True)
        known = sorted(int(Path(p).stem) for p in glob(f"{self.log}/*.json"))
        n = known[-1] + 1 if known else 0
        if getattr(self, "seen", None) is None or self.seen[0] != n:
            self.seen = n, set(self._listed(0, n))
        there = glob(f"{self.path}/*.bin")
        if self.part == "edges":
            # Tails that a shard without an end has passed on, and the end of it all.
            there += glob(f"{self.path}/{END}") + glob(f"{self.log}/passed/*/*.parquet")
        waiting = sorted(p for p in there if p not in self.seen[1])
        new = waiting[: max(self.most, len(waiting) // SHARE)]
        if new:
            with open(f"{self.log}/.new", "w") as f:
                json.dump(new, f)
            os.replace(f"{self.log}/.new", self._entry(n))
            n += 1
            self.seen = n, self.seen[1] | set(new)
        return {"entry": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Files(*p) for p in grouped(self._listed(start["entry"], end["entry"]))]

    def commit(self, end: dict) -> None:
        """The log stays: a query may be started again from its beginning."""

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        for path in (part.path, *part.more):
            yield from self._rows(path)

    def _rows(self, path: str) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)

        if path.endswith(END):
            yield batch([_row(json.loads(Path(path).read_text())["shards"], "head", True, "", 0, np.zeros(0))])
        elif path.endswith(".parquet"):
            yield from pq.read_table(path, columns=NAMES).cast(pa.schema(list(zip(NAMES, types, strict=True)))).to_batches()
        else:
            shard = _Shard(path)
            with shard.file:
                rows, size = [], 0
                for r in shard.edges(self.eot) if self.part == "edges" else shard.documents(self.eot):
                    rows.append(r)
                    size += len(r[-1])
                    if size > 2 * STEP:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)


class ArrivingShards(DataSource):
    """readStream format("arriving_shards"): options path and log are folders, part is documents or edges."""

    @classmethod
    def name(cls) -> str:
        return "arriving_shards"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ArrivingShards)
    return spark


def finish(path: str, n: int) -> None:
    """Says that there are n shards in all: what is open behind the last one is a document then."""
    with open(f"{local(path)}/.{END}", "w") as f:
        json.dump({"shards": n}, f)
    os.replace(f"{local(path)}/.{END}", f"{local(path)}/{END}")
