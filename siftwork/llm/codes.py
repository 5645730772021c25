"""Product codes of vectors by Lloyd's algorithm that is kept up by differences.

Vectors are cut into parts; each part's place has a codebook. The table of a round holds every vector with the entries its parts have now and had before.
Integer sums and counts of all entries run on from round to round: only parts whose entry has changed are shuffled, once added to their new
entry and once taken from their old one, after they have been summed up in each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.storage import Scratch
from siftwork.llm.whole import SCALE, matrix, squares, whole_vectors

DIM, PARTS, ENTRIES, ROUNDS = 64, 4, 256, 4
#: Labels whose sums are sent to every executor.
BROADCAST = 10_000
STATE = "vec_id long, label int, q array<int>, code array<int>, was array<int>, error long"
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def assign(state: DataFrame, books: np.ndarray) -> DataFrame:
    """STATE of state(vec_id, label, q, code): the nearest entry of books[part] for each part (ties: the lower index), what was before, and the squared distances' sum."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column(2), parts * width).reshape(-1, parts, width)
            code, error = np.zeros((len(q), parts), dtype=np.int32), np.zeros(len(q), dtype=np.int64)
            for p in range(parts):
                d = squares(q[:, p], books[p])
                code[:, p] = d.argmin(axis=1)
                error += d.min(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, parts), pa.int32()), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists, b.column(3), pa.array(error)], names=["vec_id", "label", "q", "code", "was", "error"])

    return state.select("vec_id", "label", "q", "code").mapInArrow(run, STATE)


def changes(state: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): what the changed parts add to counts and sums of entries; those of a first round all are changed."""
    moved = state.where("was is null or code <> was").select("q", "code", "was", F.explode(F.array(*map(F.lit, range(parts)))).alias("part"))
    old = F.get("was", F.col("part"))
    moved = moved.where(old.isNull() | (F.get("code", F.col("part")) != old))
    both = moved.select("part", F.slice("q", F.col("part") * width + 1, F.lit(width)).alias("x"), F.explode(F.array(F.struct(F.get("code", F.col("part")).alias("entry"), F.lit(1).cast("long").alias("sign")), F.struct(old.alias("entry"), F.lit(-1).cast("long").alias("sign")))).alias("e"))
    sums = (F.sum(F.col("e.sign") * F.col("x")[j]).alias(f"s{j}") for j in range(width))
    return both.where("e.entry is not null").groupBy("part", F.col("e.entry").alias("entry")).agg(F.sum("e.sign").alias("n"), *sums)


def compress(vectors: DataFrame, dim: int = DIM, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector of finite components.

    A component x counts as floor(scale * x), within 2**27 either way. Each of `parts` equal consecutive parts has a codebook that starts as that part of the `entries` vectors (256 at most) of the smallest vec_ids;
    rows of equal ids come by their components, those of null vec_id last. Each round assigns parts to the nearest entry (ties: the lower index) and takes every used entry
    to the floored mean of its parts; then parts are assigned again. code has two hexadecimal digits a part, error is the
    squared distance, label_error its sum over rows of one label, nulls together. Null and non-finite vectors are left out; those of another
    length than `dim` have a null code and error. Repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    if dim % parts or entries > 256:
        raise ValueError("parts have to be equal, and an entry has two digits")
    spark, width = vectors.sparkSession, dim // parts
    scratch = Scratch(spark)
    try:
        every = whole_vectors(vectors, scale)
        fit = every.where(F.size("q") == dim)
        first = fit.orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(entries).collect()
        odd = every.where(F.size("q") != dim).select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), "label")
        digest, coded = hashlib.sha256(b"").hexdigest(), odd.where("false")
        if first:
            books = np.array([r["q"] for r in first], dtype=np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
            count, total = np.zeros(books.shape[:2], dtype=np.int64), np.zeros_like(books)
            state = fit.withColumn("code", F.lit(None).cast("array<int>"))
            for i in range(rounds + 1):
                state = scratch.keep(assign(state, books), "codes")
                scratch.drop(1 if i else 0)  # the round before
                if i == rounds:
                    break
                for r in changes(state, parts, width).collect():  # at most a row an entry
                    at = r["part"], r["entry"]
                    count[at] += r["n"]
                    total[at] += np.array([r[f"s{j}"] for j in range(width)], dtype=np.int64)
                books = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books)
            digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
            code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
            coded = state.select("vec_id", code.alias("code"), "error", "label")
        both = coded.unionByName(odd)
        sums = scratch.keep(both.groupBy(F.col("label").alias("of")).agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error")), "labels")
        known = F.broadcast(sums) if sums.count() <= BROADCAST else sums
        out = both.join(known, both["label"].eqNullSafe(known["of"]))
        return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")).checkpoint()
    finally:
        scratch.clear()


def _oracle(rounds: int = ROUNDS, width: int = DIM // PARTS) -> str:
    """The query over the table embeddings, in DuckDB's SQL, round by round."""
    far = "list_sum(list_transform(list_zip(g.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"n{i} as materialized (select g.id, g.part, g.x, b.entry, {far} as d from g join b{i} b using (part) qualify row_number() over (partition by g.id, g.part order by d, b.entry) = 1)")
        if i < rounds:
            steps.append(f"e{i} as (select part, entry, j, cast(sum(y) as bigint) as s, count(*) as n from (select part, entry, unnest(x) as y, unnest(range({width})) as j from n{i}) group by part, entry, j)")
            steps.append(f"m{i} as (select part, entry, list((s - ((s % n) + n) % n) // n order by j) as x from e{i} group by part, entry)")
            steps.append(f"b{i + 1} as materialized (select part, entry, coalesce(m.x, b.x) as x from b{i} b left join m{i} m using (part, entry))")
    return f"""
with v as materialized (select row_number() over () as id, vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as q from embeddings
        where embedding is not null and len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    g as materialized (select id, part, q[part * {width} + 1 : part * {width} + {width}] as x from v, range({PARTS}) p(part)),
    first as (select id, row_number() over (order by vec_id, q) - 1 as entry from v qualify entry < {ENTRIES}),
    b0 as materialized (select part, entry, x from g join first using (id)),
    {", ".join(steps)},
    whole as (select id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, cast(sum(d) as bigint) as error from n{rounds} group by id),
    digest as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from v join whole using (id), digest
"""


ORACLE = _oracle()
