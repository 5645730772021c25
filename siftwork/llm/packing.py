"""Hierarchical residual packing of tokenised documents into fixed-size sequences.

Every document becomes its token ids and a closing id 0. A document longer than the sequence size is cut so
that all its pieces but the first are full; a full piece is a sequence by itself. The other pieces are best-fit
packed inside buckets of bounded size; nearly full bins are final, and underfull bins travel as items of their own
to a smaller number of buckets, where they are best-fit packed again, until a round no longer saves bins.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.batches import portions

SIZE = 2048
#: A bin with at most this many free places is final.
SLACK = 8
#: Items that one task packs at a time.
BUCKET = 16_384
END = 0

_ENCODERS: dict = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by the byte-level BPE of the tokenizers file at `path`, run by its rank table beside it (same ids, five times as fast).

    Like that file's own encoder it takes the strings of the file's added tokens, wherever they stand, for those tokens.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        ranks = {}
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            for token, rank in map(bytes.split, f):
                ranks[base64.b64decode(token)] = int(rank)
        coder = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        _ENCODERS[path] = functools.partial(coder.encode, allowed_special="all")
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than size."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))] if n else []


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; a null text is an empty one."""
    tokenizer = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in portions(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(ids), size)):
                    for column, x in zip(out, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of the items in decreasing order: bin of each item, its offset, fill of each bin."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    fills: list[int] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by free places
    some = 0  # bit r is set while room[r] has a bin
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fit := some >> n:
            free = n + (fit & -fit).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                some ^= 1 << free
        else:
            b, free = len(fills), size
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if left := free - n:
            room[left].append(b)
            some |= 1 << left
    return bins, offsets, np.array(fills, dtype=np.int64)


def _round(items: DataFrame, buckets: int, size: int, salt: int) -> DataFrame:
    """uid, bin (uid of the first item in it), shift (offset in it), fill, for items (uid, length)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        bins, offsets, fills = best_fit(group["length"].to_numpy(), size)
        head = np.full(len(fills), np.iinfo(np.int64).max)
        np.minimum.at(head, bins, group["uid"].to_numpy())
        return pd.DataFrame({"uid": group["uid"], "bin": head[bins], "shift": offsets, "fill": fills[bins]})

    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(run, "uid long, bin long, shift long, fill long")


def pack(parts: DataFrame, size: int = SIZE, slack: int = SLACK, bucket: int | None = None) -> DataFrame:
    """Adds sequence_id and offset, in the place of columns of these names, to `parts`, any rows with a column length of 1 to size.

    Rows are told apart by a number of their own, so repeated or null ids are ordinary; an empty input gives no rows.
    Raises ValueError for a length outside 1..size.
    """
    bucket = bucket or BUCKET
    uid = "uid"
    while uid in {c.lower() for c in parts.columns}:
        uid = f"_{uid}"
    parts = parts.drop("sequence_id", "offset").withColumn(uid, F.monotonically_increasing_id()).checkpoint()
    found = parts.agg(F.count(F.when(F.col("length") < size, 1)).alias("n"), F.min("length").alias("least"), F.max("length").alias("most"), F.count(F.when(F.col("length").isNull(), 1)).alias("none")).first()
    if found["none"] or found["least"] is not None and (found["least"] < 1 or found["most"] > size):
        raise ValueError(f"lengths must lie in 1..{size}")
    full = parts.where(F.col("length") == size).select(F.col(uid).alias("uid"), F.col(uid).alias("bin"), F.lit(0).cast("long").alias("shift"))
    items, place, n = parts.where(F.col("length") < size).select(F.col(uid).alias("uid"), "length"), None, found["n"]
    done = [full]
    k = 0
    while n:
        made = _round(items, max(1, -(-n // bucket)), size, k).checkpoint()
        if place is None:
            place = made.select("uid", "bin", "shift", "fill")
        else:
            up = made.select(F.col("uid").alias("bin"), F.col("bin").alias("bin2"), F.col("shift").alias("shift2"), F.col("fill").alias("fill2"))
            place = place.join(up, "bin").select("uid", F.col("bin2").alias("bin"), (F.col("shift") + F.col("shift2")).alias("shift"), F.col("fill2").alias("fill"))
        place = place.checkpoint()
        under = F.col("fill") < size - slack
        found = made.agg(F.count_distinct("bin").alias("bins"), F.count_distinct(F.when(under, F.col("bin"))).alias("under")).first()
        # All items were in one bucket, or the round has saved no bin.
        if n <= bucket or found["bins"] == n:
            break
        done.append(place.where(~under).select("uid", "bin", "shift"))
        place = place.where(under)
        items, n, k = made.where(under).groupBy("bin").agg(F.first("fill").alias("length")).withColumnRenamed("bin", "uid"), found["under"], k + 1
    if place is not None:
        done.append(place.select("uid", "bin", "shift"))
    where = done[0]
    for x in done[1:]:
        where = where.unionByName(x)
    return parts.join(where.select(F.col("uid").alias(uid), F.col("bin").alias("sequence_id"), F.col("shift").alias("offset")), uid).drop(uid)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of `docs`.

    Texts are tokenised whole, however long. A null or empty text gives one piece of one id (the closing 0); rows with equal or null doc_id are packed each by
    themselves; other columns are ignored; an empty table gives no rows. Sequences have at most `size` ids, without gaps.
    """
    return pack(pieces(docs, tokenizer, size), size)
