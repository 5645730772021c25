"""Losses under a trigram model of the corpus, by interpolated Kneser-Ney smoothing.

The model is three tables of counts, each a grouping of the one above: how often a trigram occurs, in how many first tokens' company a bigram does, in how many a
single token does. Discounts come from counts of counts. A probability takes what is left of its count and backs off to the shorter
context with the rest.

Tokens go in blocks of documents. A block asks once for each of its different trigrams, as sorted numbers in one row a part, so that no row is
a single token and a frequent trigram is no hot key. Parts deal trigrams by their last two tokens and count there for how many first tokens
these stand; what they know goes on, dealt by the first two tokens, to where contexts are counted and losses are made, back to the part, and from
there to the blocks, in the order in which they asked. A context has at most as many partners as there are token ids.

A trigram, its two contexts and what it backs off to share their middle token. So all of this goes slice by slice of middle tokens, and what is
shuffled for one slice is let go before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.tokens import BOS, VOCABULARY
from siftwork.operators.scoring import MICRO
from siftwork.sources.storage import delete, scratch

#: Targets in a slice, about, and slices at most.
SLICE, SLICES = 1 << 23, 16
#: Tokens in a block, and targets in a part, about.
BLOCK, PART = 1 << 21, 1 << 21
#: Targets that are worth a part of their own while there are idle cores.
LEAST = 1 << 16
LOSSES = ("l_trigram", "l_bigram", "l_unigram")
#: A trigram is one number: middle, last, first token, of so many bits each.
BITS = 21
MASK = (1 << BITS) - 1
#: Rows that tasks exchange: to a part, for or from a block, n numbers in a and what goes with them in b.
ROWS = "p int, block long, kind int, n int, a binary, b binary"
ASKED, PLAN = 0, 1


def _packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers, or small ones, byte by byte of all of them, compressed."""
    return pa.compress(numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each x, evenly."""
    h = x.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def _order(p: np.ndarray, parts: int) -> np.ndarray:
    """Stable; short numbers are sorted by their digits."""
    return np.argsort(p.astype(np.uint16) if parts <= 1 << 16 else p, kind="stable")


def _starts(same: np.ndarray) -> np.ndarray:
    """Places in sorted numbers where a new one begins."""
    return np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(same) else np.zeros(0, dtype=np.int64)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = _starts(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _at(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """0 for ids that the table doesn't reach."""
    return np.where(ids < len(table), table[np.minimum(ids, len(table) - 1)], 0)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _made(rows: list[tuple]) -> pa.RecordBatch:
    p, block, kind, n, a, b = zip(*rows, strict=True) if rows else [()] * 6
    return _batch("p block kind n a b", pa.array(p, pa.int32()), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(n, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()))


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows in runs of one value of `by`, which they are sorted by; a run is to be read before the next."""
    rows = (dict(zip(b.schema.names, r, strict=True)) for b in batches for r in zip(*(_values(c) for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[by])


def _values(column: pa.Array) -> list:
    return [x.as_buffer() for x in column] if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.to_pylist()


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartitionById(n, "p").sortWithinPartitions("p", "kind", "block")


def _let_go(spark: SparkSession, *paths: str) -> None:
    """Deletes the files and what steps that have ended still hold; a cluster's scheduler holds on to the plan of its last job, so that is made a small one."""
    spark.range(1).count()
    delete(spark, *paths)


def _blocks(tokens: DataFrame, path: str) -> DataFrame:
    """(block, docs, sizes, ids) of tokens(doc_id, tokens): documents in blocks; written. Null tokens are none."""
    kind, most = dict(tokens.dtypes)["doc_id"], BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, sizes, ids, n = TaskContext.get().partitionId() << 32, [], [], [], 0

        def block() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(docs), pa.array(np.concatenate(sizes), pa.int32()))]
            small = not len(all_ids) or all_ids.max() < 1 << 16
            return _batch("block docs sizes ids", pa.array([number], pa.int64()), *listed, pa.array([all_ids.astype(np.uint16 if small else np.int32).tobytes()], pa.binary()))

        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a token id is null")
            flat = flat.to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() > MASK):
                raise ValueError(f"a token id outside 0..{MASK}")
            length = np.asarray(lists.value_lengths()).astype(np.int32)
            edge = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
            at = 0
            while at < b.num_rows:
                upto = min(b.num_rows, max(at + 1, int(np.searchsorted(edge, edge[at] + most - n, side="right")) - 1))
                docs.append(b.column(0).slice(at, upto - at))
                sizes.append(length[at:upto])
                ids.append(flat[edge[at] : edge[upto]])
                n += int(edge[upto] - edge[at])
                at = upto
                if n >= most or at < b.num_rows:
                    yield block()
                    number, docs, sizes, ids, n = number + 1, [], [], [], 0
        if docs:
            yield block()

    known = tokens.select("doc_id", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"))
    made = known.mapInArrow(run, f"block long, docs array<{kind}>, sizes array<int>, ids binary")
    # Few to a file, so that a few long partitions are read by many tasks.
    made.write.option("maxRecordsPerFile", 4).parquet(path)
    return tokens.sparkSession.read.schema(made.schema).parquet(path)


def _chunk_counts(sizes: np.ndarray, length: int) -> np.ndarray:
    return np.where(sizes >= 2, -(-(sizes - 1) // length), 0)


def _requests(blocks: DataFrame, path: str, slices: int, parts: int, length: int | None, counted: bool) -> DataFrame:
    """ROWS with `part`, the slice of middle tokens: from every block to each part its different trigrams with their counts; written.

    With a length the block asks for those of its chunks, for which its PLAN says how often and for which chunk, in the order of parts and trigrams; BOS stands before a chunk.
    Counted are trigrams of whole documents; others count 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                yield from one(block, sizes.values.to_numpy(zero_copy_only=False).astype(np.int64), data.as_buffer())

    def one(block: int, sizes: np.ndarray, data: pa.Buffer) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(data, dtype=np.uint16 if len(data) == 2 * sizes.sum() else np.int32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        inner = np.ones(len(ids), dtype=bool)
        inner[first[sizes > 0]] = False
        at = np.flatnonzero(inner)
        place = at - np.repeat(first, np.maximum(sizes - 1, 0))
        known = ids[at - 1] << 2 * BITS | ids[at] << BITS | np.where(place >= 2, ids[at - 2], BOS)
        wanted = len(at) if length is not None else 0
        counts = np.full(len(at), int(counted), dtype=np.int64)
        chunk = np.zeros(0, dtype=np.int64)
        if length is not None:
            before = np.cumsum(_chunk_counts(sizes, length))
            before -= _chunk_counts(sizes, length)
            chunk = np.repeat(before, np.maximum(sizes - 1, 0)) + (place - 1) // length
            cut = np.flatnonzero(((place - 1) % length == 0) & (place > 1))
            more = known[cut] if counted else known[:0]
            known[cut] = known[cut] & ~MASK | BOS
            counts[cut] = 0
            known, counts = np.concatenate([known, more]), np.concatenate([counts, np.ones(len(more), dtype=np.int64)])
        slice_of = _spread(known >> 2 * BITS, slices)
        for k in range(slices):
            mine = np.flatnonzero(slice_of == k) if slices > 1 else np.arange(len(known))
            if not len(mine):
                continue
            # By part and trigram.
            mine = mine[np.argsort(known[mine])]
            p = _spread(known[mine] >> BITS, parts)
            order = _order(p, parts)
            mine, p = mine[order], p[order]
            keys = known[mine]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            starts = np.flatnonzero(new)
            n, keys, p = np.add.reduceat(counts[mine], starts), keys[starts], p[starts]
            edge = np.searchsorted(p, np.arange(parts + 1))
            rows = [(i, block, ASKED, int(hi - lo), _packed(keys[lo:hi]), _packed(n[lo:hi].astype(np.int32))) for i, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if lo < hi]
            if length is not None:
                asked = mine < wanted
                times = np.add.reduceat(asked, starts, dtype=np.int32)
                rows.append((-1, block, PLAN, len(keys), _packed(times), _packed(chunk[mine[asked]].astype(np.int32))))
            made = _made(rows)
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array(np.full(len(rows), k, dtype=np.int32))], names=[*made.schema.names, "part"])

    made = blocks.select("block", "sizes", "ids").mapInArrow(run, f"{ROWS}, part int")
    made.write.partitionBy("part").parquet(path)
    return _read(made, path)


def _read(rows: DataFrame, path: str) -> DataFrame:
    return rows.sparkSession.read.schema(rows.drop("part").withColumn("part", F.lit(0)).schema).parquet(path)


def _gathered(rows: Iterator[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of rows of requests, sorted, with their counts."""
    keys, counts, n, least = [], [], 0, PART
    for r in rows:
        keys.append(_unpacked(r["a"], r["n"], np.int64))
        counts.append(_unpacked(r["b"], r["n"], np.int32).astype(np.int64))
        n += r["n"]
        if n > 2 * least:
            one, two = _merged(np.concatenate(keys), np.concatenate(counts))
            keys, counts, n, least = [one], [two], len(one), max(least, len(one))
    return _merged(np.concatenate(keys), np.concatenate(counts))


def _counted(f: Callable) -> Callable:
    """f(p, keys, counts, k, places) of each part of requests: in how many first tokens' company the bigrams stand that begin at these places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _groups(batches, "p"):
            keys, counts = _gathered(rows)
            at = _starts(keys >> BITS)
            yield from f(p, keys, counts, np.add.reduceat((counts > 0).astype(np.int64), at), at)

    return run


def _statistics(p: int, keys: np.ndarray, counts: np.ndarray, k: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(kind, id, x, y), to be added up: counts of counts; for a middle token its k_v and n_v; for a last token its m."""
    some = k > 0
    v, w, k = keys[at][some] >> 2 * BITS, keys[at][some] >> BITS & MASK, k[some]
    middle, of = np.unique(v, return_inverse=True)
    last, m = np.unique(w, return_counts=True)
    for kind, ids, x, y in (
        (0, np.array([1, 2]), np.array([(counts == 1).sum(), (counts == 2).sum()]), np.array([(k == 1).sum(), (k == 2).sum()])),
        (1, middle, np.bincount(of, weights=k, minlength=len(middle)), np.bincount(of, minlength=len(middle))),
        (2, last, m, m),
    ):
        yield _batch("kind id x y", pa.array(np.full(len(ids), kind), pa.int32()), pa.array(ids, pa.int64()), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)))


@dataclass
class Model:
    """Requests of the documents it is of; discounts of the three orders; k_v, n_v and m by token id; sum and number of the m.

    Requests are kept in slices (column part); clear() deletes them.
    """

    requests: DataFrame
    chunks: DataFrame | None
    tokens: DataFrame
    length: int | None
    discounts: tuple[float, float, float]
    k_v: np.ndarray
    n_v: np.ndarray
    m: np.ndarray
    total: int
    types: int
    slices: int
    parts: int
    paths: tuple[str, ...] = ()

    @cached_property
    def trigrams(self) -> DataFrame:
        """(u, v, w, c, part)"""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in _groups(batches, "part"):
                for r in rows:
                    keys, counts = _unpacked(r["a"], r["n"], np.int64), _unpacked(r["b"], r["n"], np.int32)
                    keys, counts = keys[counts > 0], counts[counts > 0]
                    yield _batch("u v w c part", *(pa.array(x, pa.int32()) for x in (keys & MASK, keys >> 2 * BITS, keys >> BITS & MASK)), pa.array(counts, pa.int64()), pa.array(np.full(len(keys), part), pa.int32()))

        rows = self.requests.where(F.col("kind") == ASKED).select("part", "n", "a", "b").mapInArrow(run, "u int, v int, w int, c long, part int")
        return rows.groupBy("u", "v", "w").agg(F.sum("c").alias("c"), F.first("part").alias("part"))

    @property
    def contexts(self) -> DataFrame:
        """(u, v, c_uv, n_uv)"""
        return self.trigrams.groupBy("u", "v").agg(F.sum("c").alias("c_uv"), F.count("*").alias("n_uv"))

    @property
    def bigrams(self) -> DataFrame:
        """(v, w, k)"""
        return self.trigrams.groupBy("v", "w").agg(F.count("*").alias("k"))

    @property
    def firsts(self) -> DataFrame:
        """(v, k_v, n_v)"""
        ids = np.flatnonzero(self.k_v)
        return self.tokens.sparkSession.createDataFrame(list(zip(*(x.tolist() for x in (ids, self.k_v[ids], self.n_v[ids])), strict=True)), "v int, k_v long, n_v long")

    @property
    def singles(self) -> DataFrame:
        """(w, m)"""
        ids = np.flatnonzero(self.m)
        return self.tokens.sparkSession.createDataFrame(list(zip(ids.tolist(), self.m[ids].tolist(), strict=True)), "w int, m long")

    def clear(self) -> None:
        """Nothing that is still to be computed may read the model."""
        delete(self.tokens.sparkSession, *self.paths)


def _discount(one: int, two: int) -> float:
    return one / (one + 2 * two) if one else 0.5


def _ordered(tokens: DataFrame, length: int | None, paths: list[str], size: tuple[int, int] | None) -> tuple[DataFrame, DataFrame | None, int, int]:
    """Requests and chunks (block, no, doc_id, chunk) of tokens; how many slices and parts. Without a size the tokens are counted in a model."""
    spark = tokens.sparkSession
    blocks = _blocks(tokens, paths[0])
    if size is None:
        n = blocks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
        slices = min(SLICES, max(1, -(-n // SLICE)))
        each = -(-n // slices)
        parts = max(1, -(-each // PART), min(spark.sparkContext.defaultParallelism, -(-each // LEAST)))
    else:
        slices, parts = size
    requests = _requests(blocks, paths[1], slices, parts, length, size is None)
    chunks = None
    if length is not None:
        kind = dict(tokens.dtypes)["doc_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, docs, sizes in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    each = _chunk_counts(sizes.values.to_numpy(zero_copy_only=False).astype(np.int64), length)
                    row = np.repeat(np.arange(len(each)), each)
                    no = np.arange(len(row))
                    yield _batch("block no doc_id chunk", pa.array(np.full(len(row), block), pa.int64()), pa.array(no, pa.int32()), docs.values.take(pa.array(row)), pa.array(no - np.repeat(np.cumsum(each) - each, each), pa.int32()))

        made = blocks.select("block", "docs", "sizes").mapInArrow(run, f"block long, no int, doc_id {kind}, chunk int")
        made.write.parquet(paths[2])
        chunks = spark.read.schema(made.schema).parquet(paths[2])
    _let_go(spark, paths[0])
    return requests, chunks, slices, parts


def fit(tokens: DataFrame, length: int | None = None) -> Model:
    """The model of tokens(doc_id, tokens), whose ids are below VOCABULARY. Losses of chunks of that length of the same tokens then need no more than the model."""
    spark, paths = tokens.sparkSession, [scratch(tokens.sparkSession, name) for name in ("blocks", "requests", "chunks")]
    known: list[dict[int, list[int]]] = [{}, {}, {}]
    try:
        requests, chunks, slices, parts = _ordered(tokens, length, paths, None)
        for k in range(slices):
            asked = _dealt(requests.where((F.col("part") == k) & (F.col("kind") == ASKED)).drop("part"), parts)
            counted = asked.mapInArrow(_counted(_statistics), "kind int, id long, x long, y long")
            # As many rows as ids, at most, for each kind.
            for kind, i, x, y in zip(*(c.to_pylist() for c in counted.groupBy("kind", "id").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toArrow().columns), strict=True):
                both = known[kind].setdefault(i, [0, 0])
                both[0] += x
                both[1] += y
            del asked, counted
            _let_go(spark)
    except BaseException:
        delete(spark, *paths)
        raise

    def table(kind: int, which: int) -> np.ndarray:
        out = np.zeros(max(known[kind], default=0) + 1, dtype=np.int64)
        out[list(known[kind])] = [x[which] for x in known[kind].values()]
        return out

    (t1, b1), (t2, b2) = (known[0].get(i, (0, 0)) for i in (1, 2))
    m = table(2, 0)
    discounts = _discount(t1, t2), _discount(b1, b2), _discount(int((m == 1).sum()), int((m == 2).sum()))
    return Model(requests, chunks, tokens, length, discounts, table(1, 0), table(1, 1), m, int(m.sum()), int((m > 0).sum()), slices, parts, tuple(paths[1:]))


def _mixed(count: str, discount: float, more: str | Column, below: Column, total: str | Column) -> Column:
    """What is left of the count, and the discounts' sum spread like the shorter context."""
    return (F.greatest(F.coalesce(count, F.lit(0)) - F.lit(discount), F.lit(0.0)) + F.lit(discount) * more * below) / total


def losses(asked: DataFrame, model: Model) -> DataFrame:
    """asked(u, v, w, ...), one row a trigram, with LOSSES in millionths of a nat: of w after u and v, after v, and by itself."""
    three, two, one = model.discounts
    trigrams, contexts, bigrams = model.trigrams.select("u", "v", "w", "c"), model.contexts, model.bigrams
    met = asked.join(trigrams, ["u", "v", "w"], "left").join(contexts, ["u", "v"], "left").join(bigrams, ["v", "w"], "left")
    met = met.join(F.broadcast(model.firsts), "v", "left").join(F.broadcast(model.singles), "w", "left")
    even = F.lit(1.0 / VOCABULARY)
    p1 = _mixed("m", one, F.lit(model.types), even, F.lit(model.total)) if model.total else even
    met = met.withColumn("p1", p1)
    met = met.withColumn("p2", F.when(F.col("k_v").isNull(), F.col("p1")).otherwise(_mixed("k", two, F.col("n_v"), F.col("p1"), F.col("k_v"))))
    met = met.withColumn("p3", F.when(F.col("c_uv").isNull(), F.col("p2")).otherwise(_mixed("c", three, F.col("n_uv"), F.col("p2"), F.col("c_uv"))))
    return met.select(*asked.columns, *(F.floor(-F.log(p) * F.lit(float(MICRO)) + F.lit(0.5)).alias(name) for p, name in zip(("p3", "p2", "p1"), LOSSES, strict=True)))


def _lost(p: np.ndarray) -> np.ndarray:
    return np.floor(-np.log(p) * float(MICRO) + 0.5).astype(np.int32)


def _left(count: np.ndarray, discount: float, more: np.ndarray, below: np.ndarray, total: np.ndarray) -> np.ndarray:
    """_mixed of arrays; below where there is no total."""
    return np.where(total > 0, (np.maximum(count - discount, 0.0) + discount * more * below) / np.maximum(total, 1), below)


def _slice_losses(requests: DataFrame, asked: DataFrame, model: Model) -> DataFrame:
    """(block, no, n_targets, *LOSSES): sums of a slice. requests: those of the model and those of asked."""
    parts, (three, two, one), total, types, k_v, n_v = model.parts, model.discounts, model.total, model.types, model.k_v, model.n_v
    even = 1.0 / VOCABULARY
    # By id, and last for ids that the model doesn't know.
    m = np.append(model.m, 0)
    p1 = (np.maximum(m - one, 0.0) + one * types * even) / total if total else np.full(len(m), even)
    l1 = _lost(p1)

    def out(p: int, keys: np.ndarray, counts: np.ndarray, k: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        k = np.repeat(k, np.diff(np.append(at, len(keys))))
        to = _spread(keys >> 2 * BITS << BITS | keys & MASK, parts)
        order = _order(to, parts)
        keys, counts, k, to = keys[order], counts[order], k[order], to[order]
        edge = np.searchsorted(to, np.arange(parts + 1))
        for q, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            if lo < hi:
                # block: the part that the losses go back to.
                yield _made([(q, p, ASKED, int(hi - lo), _packed(keys[lo:hi]), _packed(np.stack([counts[lo:hi], k[lo:hi]], 1).reshape(-1)))])

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "p"):
            rows = [(r["block"], _unpacked(r["a"], r["n"], np.int64), _unpacked(r["b"], 2 * r["n"], np.int64).reshape(-1, 2)) for r in rows]
            keys, known = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
            c, k = known[:, 0], known[:, 1]
            pair = keys >> 2 * BITS << BITS | keys & MASK
            order = np.argsort(pair)
            at = _starts(pair[order])
            each = np.diff(np.append(at, len(keys)))
            c_uv, n_uv = np.empty_like(c), np.empty_like(c)
            c_uv[order] = np.repeat(np.add.reduceat(c[order], at), each)
            n_uv[order] = np.repeat(np.add.reduceat((c[order] > 0).astype(np.int64), at), each)
            v, w = keys >> 2 * BITS, keys >> BITS & MASK
            p2 = _left(k, two, _at(n_v, v), p1[np.minimum(w, len(p1) - 1)], _at(k_v, v))
            l3, l2 = _lost(_left(c, three, n_uv, p2, c_uv)), _lost(p2)
            lo = 0
            for p, mine, _ in rows:
                hi = lo + len(mine)
                yield _made([(p, -1, -1, hi - lo, _packed(mine), np.stack([l3[lo:hi], l2[lo:hi]]).tobytes())])
                lo = hi

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _groups(batches, "p"):
            keys, known = [], []
            table = None
            for r in rows:
                mine = _unpacked(r["a"], r["n"], np.int64)
                if r["kind"] < 0:
                    keys.append(mine)
                    known.append(np.frombuffer(r["b"], dtype=np.int32).reshape(2, -1))
                    continue
                if table is None:
                    table, known = np.concatenate(keys), np.concatenate(known, axis=1)
                    order = np.argsort(table)
                    table, known = table[order], known[:, order]
                    del keys, order
                at = np.minimum(np.searchsorted(table, mine), len(table) - 1)
                if (table[at] != mine).any():
                    raise RuntimeError("a trigram wasn't counted")
                found = known[:, at]
                yield _made([(p, r["block"], ASKED, len(mine), np.stack([*found, l1[np.minimum(mine >> BITS & MASK, len(l1) - 1)]]).tobytes(), b"")])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches, "block"):
            plan = next(rows)
            times = _unpacked(plan["a"], plan["n"], np.int32)
            chunk = _unpacked(plan["b"], int(times.sum()), np.int32)
            got = [np.frombuffer(r["a"], dtype=np.int32).reshape(3, -1) for r in rows]
            got = np.concatenate(got, axis=1)
            if plan["kind"] != PLAN or got.shape[1] != len(times):
                raise RuntimeError("a block didn't get all losses")
            n = np.bincount(chunk)
            some = np.flatnonzero(n)
            sums = [np.bincount(chunk, weights=np.repeat(x, times))[some].astype(np.int64) for x in got]
            yield _batch(" ".join(("block", "no", "n_targets", *LOSSES)), pa.array(np.full(len(some), block), pa.int64()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), *sums)

    plans = asked.where(F.col("kind") == PLAN)
    mine = asked.where(F.col("kind") == ASKED)
    requests = requests.where(F.col("kind") == ASKED)
    counted = _dealt(requests, parts).mapInArrow(_counted(out), ROWS)
    lost = _dealt(counted, parts).mapInArrow(context, ROWS)
    answers = _dealt(lost.unionByName(mine), parts).mapInArrow(told, ROWS)
    # Plans have p -1.
    home = plans.unionByName(answers).repartition(max(parts, plans.sparkSession.sparkContext.defaultParallelism), "block").sortWithinPartitions("block", "p")
    return home.mapInArrow(summed, f"block long, no int, n_targets long, {', '.join(f'{c} long' for c in LOSSES)}")


def chunk_losses(tokens: DataFrame, model: Model, length: int, frequent: int | None = None) -> DataFrame:
    """(doc_id, chunk, n_targets, *LOSSES) of the chunks of tokens(doc_id, tokens) that have targets.

    `frequent` has no effect: a block asks for a trigram once, so there is no other way for frequent ones.
    """
    spark = tokens.sparkSession
    paths = [scratch(spark, name) for name in ("sums", "blocks", "requests", "chunks")]
    try:
        own = tokens is model.tokens and length == model.length
        asked, chunks = (model.requests, model.chunks) if own else _ordered(tokens, length, paths[1:], (model.slices, model.parts))[:2]
        for k in range(model.slices):
            mine, known = (x.where(F.col("part") == k).drop("part") for x in (asked, model.requests))
            sums = _slice_losses(known if own else known.unionByName(mine), mine, model)
            sums.write.parquet(f"{paths[0]}/part={k}")
            parts = _read(sums, paths[0])
            del mine, known, sums
            _let_go(spark)
        # A chunk has a row for each slice.
        sums = parts.groupBy("block", "no").agg(*(F.sum(c).alias(c) for c in ("n_targets", *LOSSES)))
        return sums.join(chunks, ["block", "no"]).groupBy("doc_id", "chunk").agg(*(F.sum(c).alias(c) for c in ("n_targets", *LOSSES))).checkpoint()
    finally:
        delete(spark, *paths)


def document_losses(tokens: DataFrame, model: Model, length: int, *keep: str) -> DataFrame:
    """(doc_id, *keep, l_base, l_ref) for every row of tokens(doc_id, *keep, tokens): under the trigram model, and without any context; 0 without targets."""
    sums = chunk_losses(tokens, model, length).groupBy("doc_id").agg(F.sum("l_trigram").alias("l_base"), F.sum("l_unigram").alias("l_ref"))
    return tokens.select("doc_id", *keep).join(sums, "doc_id", "left").fillna(0, ["l_base", "l_ref"])
