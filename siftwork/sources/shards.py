"""Binary token shards as a Spark data source.

A shard has a header of 256 little-endian 32-bit numbers (a mark, a version, the number of tokens, zeros) and the tokens as little-endian
unsigned 16-bit numbers. Reading a range seeks to it. Paths are opened by the executors, so the folder has to be one they all mount;
for stores that only Spark's readers open, read_with_spark() takes the bytes from Spark instead.
"""

from __future__ import annotations

import hashlib
import json
import operator
import os
import re
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch
from glob import glob
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

# Fixed values of the format.
MARK, VERSION, HEADER = 20240520, 1, 256
#: Names of files that a manifest names, and of manifests.
OBJECT, MANIFEST = ".tokens", "_manifest."
SCHEMA = "shard string, block long, at long, tokens array<int>"
#: Tokens that go to Spark at a time.
BATCH = 1 << 19
#: Threads that give files their names.
RENAMERS = 16


def local(path: str) -> str:
    """The path of a file: URI, or the path itself; raises ValueError for other stores."""
    scheme, _, rest = path.partition(":/")
    if not rest or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"not a mounted folder: {path}")
    return "/" + rest.lstrip("/")


def complete(name: str, base: str = "") -> str:
    """Path of the shard that a pointer names: with the ending .bin, in the folder `base` unless the name has a folder of its own."""
    stem = name if name.endswith(".bin") else f"{re.sub(r'[.][^./]*$', '', name)}.bin"
    return stem if "/" in stem or not base else f"{base.rstrip('/')}/{stem}"


def paths_of(pointer: str, base: str = "", dash: str = "—") -> list[tuple[str, int, int | None]]:
    """(path, lo, hi) of the ranges of a pointer; hi is None where a range runs to the end of its shard. Later names without a folder are in the first one's."""
    out: list[tuple[str, int, int | None]] = []
    for part in pointer.split(dash):
        name, _, span = part.rpartition(":")
        if out and "/" not in name and "/" in out[0][0]:
            base = out[0][0].rpartition("/")[0]
        path = complete(name, base)
        if span == "EOF":
            # After a range of the same shard it says nothing new; else it is the whole shard.
            if not any(p == path for p, _, _ in out):
                out.append((path, 0, None))
            continue
        lo, _, hi = span.partition("-")
        out.append((path, int(lo), None if hi == "EOF" else int(hi)))
    return out


def header(n: int) -> bytes:
    if n >= 1 << 31:
        raise ValueError("a shard has fewer than 2**31 tokens")
    out = np.zeros(HEADER, dtype="<i4")
    out[:3] = MARK, VERSION, n
    return out.tobytes()


def count_of(head: bytes) -> int:
    """Number of tokens by a header; raises ValueError for another kind of file."""
    numbers = np.frombuffer(head[: 4 * HEADER], dtype="<i4")
    if len(numbers) < HEADER or numbers[0] != MARK or numbers[1] != VERSION:
        raise ValueError("not a token shard of this version")
    return int(numbers[2])


def decode(content: bytes) -> np.ndarray:
    n = count_of(content)
    body = content[4 * HEADER : 4 * HEADER + 2 * n]
    if len(body) != 2 * n:
        raise ValueError("a token shard that is cut off")
    return np.frombuffer(body, dtype="<u2").astype(np.int32)


def ids(tokens: np.ndarray) -> np.ndarray:
    """The tokens as they are in a shard."""
    tokens = np.asarray(tokens)
    if len(tokens) and (tokens.min() < 0 or tokens.max() >= 1 << 16):
        raise ValueError("a token id outside 0..65535")
    return tokens.astype("<u2")


def encode(tokens: np.ndarray) -> bytes:
    return header(len(tokens)) + ids(tokens).tobytes()


def blocks(runs: Iterable[tuple[str, int, np.ndarray]], block: int) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA of runs (shard, first, tokens), `first` being the place of tokens[0]; short runs go together, BATCH tokens at a time."""
    names, places, sizes, bodies, n = [], [], [], [], 0

    def batch() -> pa.RecordBatch:
        at, edge = np.concatenate(places), np.cumsum([0, *np.concatenate(sizes)])
        lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(bodies), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at // block), pa.array(at), lists], names=["shard", "block", "at", "tokens"])

    for shard, first, tokens in runs:
        if not len(tokens):
            continue
        edge = np.array([first, *range((first // block + 1) * block, first + len(tokens), block), first + len(tokens)], dtype=np.int64)
        names += [shard] * (len(edge) - 1)
        places.append(edge[:-1])
        sizes.append(np.diff(edge))
        bodies.append(tokens)
        n += len(tokens)
        if n >= BATCH:
            yield batch()
            names, places, sizes, bodies, n = [], [], [], [], 0
    if n:
        yield batch()


def listed(path: str) -> list[tuple[str, str]]:
    """(shard, path of its file) of the shards that match a file or pattern, in the order of their paths.

    Files whose names end in .bin speak for themselves. Others belong to a shard only if a manifest beside them says so, whose digest shows that it is whole.
    """
    found = [(Path(p).stem, p) for p in glob(path) if os.path.isfile(p) and not p.endswith((OBJECT, ".json"))]
    folder, _, name = path.rpartition("/")
    for m in glob(f"{folder or '.'}/{MANIFEST}*.json"):
        found += [(shard, f"{folder or '.'}/{file}") for shard, file in _manifest(Path(m).read_bytes()) if fnmatch(f"{shard}.bin", name)]
    if len({shard for shard, _ in found}) < len(found) and any(p.endswith(OBJECT) for _, p in found):
        raise ValueError(f"a shard is there twice: {path}")
    return sorted(found, key=lambda x: (x[1].rpartition("/")[0], x[0]))


def _manifest(content: bytes) -> list[tuple[str, str]]:
    """What a manifest lists; nothing if it was not written to its end."""
    digest, _, body = content.partition(b"\n")
    return [(shard, file) for shard, file in json.loads(body)] if digest.decode("ascii", "replace") == hashlib.sha256(body).hexdigest() else []


class _Ranges(InputPartition):
    """(shard, path, lo, hi) of places that a task reads. Paths in one folder are kept without it, since files may be very many."""

    def __init__(self, ranges: list[tuple[str, str, int, int]]):
        self.folder = os.path.commonpath([os.path.dirname(p) for _, p, _, _ in ranges]) if ranges else ""
        self.short = [("" if Path(p).stem == shard else shard, os.path.relpath(p, self.folder or "."), lo, hi) for shard, p, lo, hi in ranges]

    def ranges(self) -> Iterator[tuple[str, str, int, int]]:
        for shard, p, lo, hi in self.short:
            yield shard or Path(p).stem, os.path.join(self.folder, p), lo, hi


class _Files(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


#: How filters compare a column with a value; all of them are false for nulls.
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class _Reader(DataSourceReader):
    """A task for each RANGE tokens, of a long shard or of many short ones, of those from option lo to option hi (included) if they are given.

    Filters on shard leave files out; filters on at and block leave out the bytes of other blocks. All others are Spark's to evaluate.
    Rows begin at multiples of the block, or at lo, wherever tasks begin. Headers are read by tasks: the driver knows files by their sizes.
    """

    RANGE = 1 << 22
    #: Tokens that could be read in the time that it takes to open a file.
    OPEN = 1 << 12

    def __init__(self, options: dict):
        self.path = local(options["path"])
        self.lo, self.hi, self.block = int(options.get("lo", 0)), int(options["hi"]) if "hi" in options else None, int(options.get("block", 1024))
        self.by_name: list[tuple] = []
        self.by_place: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(getattr(f, "attribute", None), tuple) and len(f.attribute) == 1 else None
            if isinstance(f, IsNotNull) and name in ("shard", "block", "at", "tokens"):
                continue  # no column of a row is null
            value = tuple(f.value) if isinstance(f, In) else getattr(f, "value", None)
            known = value is not None and type(f) in (*COMPARED, In, *((StringStartsWith,) if name == "shard" else ()))
            if known and name == "shard":
                self.by_name.append((type(f), value))
            elif known and name in ("at", "block"):
                self.by_place.append((name, type(f), value))
            else:
                yield f

    def paths(self) -> list[tuple[str, str]]:
        def asked(shard: str) -> bool:
            return all(shard in v if kind is In else shard.startswith(v) if kind is StringStartsWith else COMPARED[kind](shard, v) for kind, v in self.by_name)

        return [(shard, p) for shard, p in listed(self.path) if asked(shard)]

    def ranges(self, n: int) -> list[tuple[int, int]]:
        """Places that are read of a shard of n tokens: those of the blocks that filters leave."""
        lo, hi, listed = self.lo, n if self.hi is None else min(n, self.hi + 1), None
        for name, kind, value in self.by_place:
            unit = self.block if name == "block" else 1
            if kind in (In, EqualTo):
                some = {v * unit // self.block for v in (value if kind is In else (value,)) if v is not None}
                listed = some if listed is None else listed & some
            elif kind in (GreaterThan, GreaterThanOrEqual):
                lo = max(lo, value * unit // self.block * self.block)
            else:
                hi = min(hi, (value * unit // self.block + 1) * self.block)
        if listed is None:
            return [(lo, hi)] if lo < hi else []
        out: list[tuple[int, int]] = []
        for b in sorted(listed):
            a, z = max(lo, b * self.block), min(hi, (b + 1) * self.block)
            if a < z and out and out[-1][1] == a:
                out[-1] = (out[-1][0], z)
            elif a < z:
                out.append((a, z))
        return out

    def partitions(self) -> list[InputPartition]:
        out, step = [], max(1, self.RANGE // self.block) * self.block
        task, n = [], 0
        for shard, path in self.paths():
            # At least one place, so that a file without tokens is looked at too.
            for lo, hi in self.ranges(max(1, (os.path.getsize(path) - 4 * HEADER) // 2)):
                edges = [lo, *range((lo // step + 1) * step, hi, step), hi]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if task and n + self.OPEN + b - a > self.RANGE + self.OPEN:
                        out.append(_Ranges(task))
                        task, n = [], 0
                    task.append((shard, path, a, b))
                    n += self.OPEN + b - a
        return [*out, _Ranges(task)]

    def read(self, part: _Ranges) -> Iterator[pa.RecordBatch]:
        for rows in blocks(self.runs(part), self.block):
            yield self.kept(rows)

    def runs(self, part: _Ranges) -> Iterator[tuple[str, int, np.ndarray]]:
        for shard, path, lo, hi in part.ranges():
            with open(path, "rb") as f:
                n = count_of(f.read(4 * HEADER))
                if n > (os.fstat(f.fileno()).st_size - 4 * HEADER) // 2:
                    raise ValueError("a token shard that is cut off")
                f.seek(4 * HEADER + 2 * lo)
                body = f.read(2 * max(0, min(hi, n) - lo))
            yield shard, lo, np.frombuffer(body, dtype="<u2").astype(np.int32)

    def kept(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.ones(rows.num_rows, dtype=bool)
        for name, kind, value in self.by_place:
            x = rows.column(name).to_numpy()
            keep &= np.isin(x, [v for v in value if v is not None]) if kind is In else COMPARED[kind](x, value)
        return rows if keep.all() else rows.filter(pa.array(keep))


class _Headers(DataSourceReader):
    """A task for each FILES shards, of which only headers are read."""

    FILES = 256

    def __init__(self, options: dict):
        self.path = local(options["path"])

    def partitions(self) -> list[InputPartition]:
        found = listed(self.path)
        return [_Files(found[i : i + self.FILES]) for i in range(0, len(found), self.FILES)] or [_Files([])]

    def read(self, part: _Files) -> Iterator[tuple[str, str, int]]:
        for shard, path in part.paths:
            with open(path, "rb") as f:
                yield shard, path, count_of(f.read(4 * HEADER))


class _Done(WriterCommitMessage):
    """The shards that a task has written, and the mark in its files' names."""

    def __init__(self, mark: str, shards: list[str]):
        self.mark, self.shards = mark, shards


class _Writer(DataSourceArrowWriter):
    """Rows of (shard, at, tokens), a shard's in one task and in order. Files get their names when all tasks have ended.

    With a manifest they keep the names that their attempt has given them, and one small file, written when all tasks have ended, says which of them are shards;
    so a store needs no renaming. What a lost task or attempt has left, or a commit that didn't come to its end, is never seen.
    """

    def __init__(self, path: str, manifest: bool = False):
        self.path, self.manifest = path, manifest

    def made(self, shard: str, mark: str) -> str:
        """Name of the file that an attempt writes."""
        return f"{shard}.{mark}{OBJECT}" if self.manifest else f".{shard}.{mark}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Done:
        import uuid

        os.makedirs(self.path, exist_ok=True)
        mark, known = uuid.uuid4().hex, []
        now, out, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.seek(0)
                out.write(header(n))
                out.close()

        for b in batches:
            names, lists = b.column("shard").to_pylist(), b.column("tokens")
            tokens, edge = ids(lists.flatten().to_numpy()), np.cumsum([0, *lists.value_lengths().to_pylist()])
            # Rows of a shard follow each other.
            first = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for lo, hi in zip(first, [*first[1:], len(names)], strict=True):
                if names[lo] != now:
                    close()
                    now, n = names[lo], 0
                    known.append(now)
                    out = open(f"{self.path}/{self.made(now, mark)}", "wb")  # noqa: SIM115
                    out.write(header(0))
                out.write(tokens[edge[lo] : edge[hi]].tobytes())
                n += int(edge[hi] - edge[lo])
        close()
        return _Done(mark, known)

    def commit(self, messages: list[_Done | None]) -> None:
        done = [(self.made(shard, m.mark), shard) for m in messages if m for shard in m.shards]
        if self.manifest:
            import uuid

            body = json.dumps([(shard, file) for file, shard in done]).encode()
            os.makedirs(self.path, exist_ok=True)
            Path(f"{self.path}/{MANIFEST}{uuid.uuid4().hex}.json").write_bytes(hashlib.sha256(body).hexdigest().encode() + b"\n" + body)
            return

        def name(k: int) -> None:
            for file, shard in done[k::RENAMERS]:
                os.replace(f"{self.path}/{file}", f"{self.path}/{shard}.bin")

        with ThreadPoolExecutor(RENAMERS) as pool:
            list(pool.map(name, range(RENAMERS)))

    def abort(self, messages: list[_Done | None]) -> None:
        for m in messages:
            for shard in m.shards if m else ():
                Path(f"{self.path}/{self.made(shard, m.mark)}").unlink(missing_ok=True)


class TokenShards(DataSource):
    """format("token_shards"): option path is a file or pattern for reading, a folder for writing."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(local(self.options["path"]), self.options.get("manifest", "false").lower() == "true")


class ShardHeaders(DataSource):
    """format("token_shard_headers"): option path is a file or pattern."""

    @classmethod
    def name(cls) -> str:
        return "token_shard_headers"

    def schema(self) -> str:
        return "shard string, path string, n_tokens long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Headers(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TokenShards)
    spark.dataSource.register(ShardHeaders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(shard, path, n_tokens) of the shards that match the path, empty ones too; their tokens are not read."""
    return register(spark).read.format("token_shard_headers").option("path", path).load()


def write(pieces: DataFrame, path: str, manifest: bool = False) -> None:
    """Writes pieces(shard, at, tokens) as shards named by `shard`; with a manifest where the store has no renaming."""
    register(pieces.sparkSession)
    in_order = pieces.select("shard", "at", "tokens").repartition("shard").sortWithinPartitions("shard", "at")
    in_order.write.format("token_shards").option("path", path).option("manifest", str(manifest).lower()).mode("append").save()


def read(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None, block: int = 1024) -> DataFrame:
    """(shard, block, at, tokens) of the shards that match the path, in the places lo..hi if given; empty shards give no rows."""
    source = register(spark).read.format("token_shards").option("path", path).option("block", block)
    for k, v in (("lo", lo), ("hi", hi)):
        source = source if v is None else source.option(k, v)
    return source.load()


def exists(path: str) -> bool:
    """Whether any shard matches the path."""
    return bool(listed(local(path)))


def read_with_spark(spark: SparkSession, path: str, block: int = 1024) -> DataFrame:
    """The same by Spark's own file reader, for any store it knows. A shard is one row there, so it has to fit in a task."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield name, 0, decode(content.as_py())

    stem = F.regexp_extract("path", "([^/]+?)(\\.[^./]*)?$", 1)
    files, (folder, _, name) = spark.read.format("binaryFile"), path.rpartition("/")
    # A pattern of names goes to the listing of one folder: as paths of their own files would be looked up one by one, and each new plan would compare them all.
    found = files.option("pathGlobFilter", name).load(folder) if folder and re.search(r"[*?\[{]", name) and not re.search(r"[*?\[{,]", folder) else files.load(path)
    # Spark takes a file for 4 MB at least, so short shards come to very many tasks.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return found.select(stem.alias("shard"), "content").coalesce(tasks).mapInArrow(lambda batches: blocks(contents(batches), block), SCHEMA)
