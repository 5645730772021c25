"""Lloyd's algorithm over ball trees that are built once, inside partitions.

Vectors stay where they lie: a task gathers them in blocks and builds a tree of each, whose balls have a centre, a covering radius, a count and an integer
sum of what is in them. A round walks every tree with the centroids: a centroid is ruled out for a whole ball when, by the triangle
inequality, no point of it can be as near to it as to the best one. A ball with one centroid left gives it its count and sum; else the walk goes
down, and leaves compare point by point. Only counts and sums of centroids, a few rows a task, are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.storage import Scratch
from siftwork.llm.whole import SCALE, matrix, squares, whole_vectors

CENTROIDS, ROUNDS, DIM = 8, 10, 64
SEED = "3"
#: Vectors of a block, and of a leaf of its tree.
BLOCK, LEAF = 4096, 16
#: Room for rounding where a bound is compared.
SLACK = 1 + 1e-9
BLOCKS = "ids array<bigint>, q binary, center binary, sum binary, radius binary, place binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass
class Balls:
    """Ball i holds the points lo[i]..hi[i]-1; its children are first[i] and first[i] + 1, or none where first[i] is 0."""

    q: np.ndarray
    center: np.ndarray
    sum: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def balls(q: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Balls]:
    """The order of the points in the tree, and the tree. A ball is halved along the line between two points far apart, unless its points are equal."""
    order = np.arange(len(q))
    lo, hi, first, center, total, radius = [0], [len(q)], [], [], [], []
    k = 0
    while k < len(lo):
        at = order[lo[k] : hi[k]]
        x = q[at]
        total.append(x.sum(axis=0))
        center.append(total[-1] // len(x))
        far = squares(x, center[-1][None])[:, 0]
        radius.append(float(np.sqrt(float(far.max()))) * SLACK)
        first.append(0)
        if len(x) > leaf and far.max() > 0:
            a = x[far.argmax()]
            b = x[squares(x, a[None])[:, 0].argmax()]
            if (a != b).any():
                half = len(x) // 2
                order[lo[k] : hi[k]] = at[np.argpartition(x.astype(np.float64) @ (b - a).astype(np.float64), half)]
                first[k] = len(lo)
                lo += [lo[k], lo[k] + half]
                hi += [lo[k] + half, hi[k]]
        k += 1
    whole = [np.array(v, dtype=np.int64) for v in (center, total, first, lo, hi)]
    return order, Balls(q[order], whole[0], whole[1], np.array(radius), *whole[2:])


def assign(t: Balls, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of the centroids z: counts, sums, the nearest for each point (ties: the smaller number), and how many points came in whole balls."""
    k = len(z)
    count, total, own = np.zeros(k, dtype=np.int64), np.zeros_like(z), np.zeros(len(t.q), dtype=np.int32)
    between = np.sqrt(squares(z, z).astype(float))
    # A centroid equal to an earlier one is never chosen.
    alone = np.array([not (z[:j] == z[j]).all(axis=1).any() for j in range(k)])
    nodes, open_, whole = np.array([0]), np.tile(alone, (1, 1)), 0
    while len(nodes):
        d = np.where(open_, squares(t.center[nodes], z).astype(float), np.inf)
        best = d.argmin(axis=1)
        # |x-z|^2 - |x-best|^2 changes by at most 2 r |z-best| within a ball of radius r.
        open_ = open_ & ~(d - d.min(axis=1)[:, None] > 2 * t.radius[nodes][:, None] * between[best] * SLACK)
        done = (open_.sum(axis=1) == 1) | (t.radius[nodes] == 0)
        for i in np.nonzero(done)[0].tolist():
            b, n = best[i], nodes[i]
            count[b] += t.hi[n] - t.lo[n]
            total[b] += t.sum[n]
            own[t.lo[n] : t.hi[n]] = b
            whole += int(t.hi[n] - t.lo[n])
        nodes, open_ = nodes[~done], open_[~done]
        leaf = t.first[nodes] == 0
        if leaf.any():
            size = (t.hi - t.lo)[nodes[leaf]]
            points = np.repeat(t.lo[nodes[leaf]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            near = np.where(np.repeat(open_[leaf], size, axis=0), squares(t.q[points], z), np.iinfo(np.int64).max).argmin(axis=1)
            own[points] = near
            count += np.bincount(near, minlength=k)
            for b in np.unique(near).tolist():
                total[b] += t.q[points[near == b]].sum(axis=0)
        below = t.first[nodes[~leaf]]
        nodes, open_ = np.concatenate([below, below + 1]), np.tile(open_[~leaf], (2, 1))
    return count, total, own, whole


def forest(vectors: DataFrame, dim: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row a block of at most `block` vectors of a partition of vectors(vec_id, q): their ids and their tree."""

    def row(ids: list, q: np.ndarray) -> pa.RecordBatch:
        order, t = balls(q, leaf)
        ids = pa.concat_arrays(ids).take(pa.array(order))
        parts = [t.q.astype("<i4"), t.center.astype("<i4"), t.sum.astype("<i8"), t.radius.astype("<f8"), np.stack([t.first, t.lo, t.hi]).astype("<i8")]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists, *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["ids", "q", "center", "sum", "radius", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, n = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                if n and n + part.num_rows > block:
                    yield row(ids, np.concatenate(q))
                    ids, q, n = [], [], 0
                ids.append(part.column(0))
                q.append(matrix(part.column(1), dim))
                n += part.num_rows
        if n:
            yield row(ids, np.concatenate(q))

    return vectors.select("vec_id", "q").mapInArrow(run, BLOCKS)


def _trees(b: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, Balls]]:
    for i in range(b.num_rows):
        q, center, total, radius, place = (np.frombuffer(b.column(j)[i].as_buffer(), dtype=d) for j, d in ((1, "<i4"), (2, "<i4"), (3, "<i8"), (4, "<f8"), (5, "<i8")))
        first, lo, hi = place.reshape(3, -1)
        yield b.column(0)[i].values, Balls(q.astype(np.int64).reshape(-1, dim), center.astype(np.int64).reshape(-1, dim), total.reshape(-1, dim), radius, first, lo, hi)


def round_(trees: DataFrame, z: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors, or as they are without any."""
    k, dim = z.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, dtype=np.int64), np.zeros_like(z)
        for b in batches:
            for _, t in _trees(b, dim):
                count, total, _, _ = assign(t, z)
                n += count
                s += total
        some = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    sums = trees.mapInArrow(run, "cluster int, n long, s array<bigint>").groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)))
    out = z.copy()
    for r in sums.collect():  # at most a row a centroid
        out[r["cluster"]] = np.array([r[f"s{i}"] for i in range(dim)], dtype=np.int64) // r["n"]
    return out


def _assigned(trees: DataFrame, z: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, t in _trees(b, z.shape[1]):
                own = assign(t, z)[2]
                away = t.q - z[own]
                yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array((away * away).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of `dim` finite components.

    A component x counts as floor(scale * x), within 2**27 either way. Centroids start as the k vectors whose sha256 of "seed:vec_id" is smallest, in that order; rows of null vec_id come
    last there, those of equal ids by their components. With fewer vectors than k there are fewer centroids. Every round takes a vector to its nearest centroid (ties: the smaller number) and
    a centroid to the floored mean of its vectors, then vectors are assigned once more. Null, short, long and non-finite vectors
    are left out; repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    try:
        kept = whole_vectors(vectors, scale).where(F.size("q") == dim)
        named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        start = kept.select(named.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
        if not start:
            return spark.createDataFrame([], RESULT)
        z = np.array([r["q"] for r in start], dtype=np.int64)
        trees = scratch.keep(forest(kept, dim, block, leaf), "balls")
        for _ in range(rounds):
            z = round_(trees, z)
        found = scratch.keep(_assigned(trees, z), "assigned")
        sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
        about = [(i, s, sum(sums.values()), hashlib.sha256(",".join(map(str, z[i].tolist())).encode()).hexdigest()) for i, s in sums.items()]
        known = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
        return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").checkpoint()
    finally:
        scratch.clear()


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> str:
    """The query over the table embeddings, in DuckDB's SQL, round by round."""

    def near(i: int, what: str) -> str:
        far = "list_sum(list_transform(list_zip(g.q, z.q), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
        return f"n{i} as materialized (select g.id, {what}, z.c, {far} as d from g, z{i} z qualify row_number() over (partition by g.id order by d, z.c) = 1)"

    steps = []
    for i in range(rounds):
        steps.append(near(i, "g.q"))
        steps.append(f"e{i} as (select c, j, cast(sum(x) as bigint) as s, count(*) as n from (select c, unnest(q) as x, unnest(range({dim})) as j from n{i}) group by c, j)")
        steps.append(f"m{i} as (select c, list((s - ((s % n) + n) % n) // n order by j) as q from e{i} group by c)")
        steps.append(f"z{i + 1} as materialized (select c, coalesce(m.q, z.q) as q from z{i} z left join m{i} m using (c))")
    return f"""
with g as materialized (select row_number() over () as id, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as q from embeddings
        where embedding is not null and len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    z0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id), q) - 1 as c, q from g qualify c < {k}),
    {", ".join(steps)}, {near(rounds, "g.vec_id")}
select vec_id, cast(n.c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by n.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(z.q, ',')) as centroid_sha256
from n{rounds} n join z{rounds} z on n.c = z.c
"""


ORACLE = _oracle()
