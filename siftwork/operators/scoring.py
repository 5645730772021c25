"""Document scores: how much a document's loss rises when the model can't copy from its context.

Models stand behind one function, losses(chunk) -> (base, reference), in millionths of a nat for a chunk of token ids. The one built in is a stand-in
for a pair of neural models: the base model mixes a copying part, the share of earlier tokens in the chunk that equal the next
one, with token frequencies; the reference model, whose copying is cut out, has the frequencies alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.tokens import BOS, VOCABULARY

Losses = Callable[[np.ndarray], tuple[int, int]]
MICRO = 1_000_000
#: Losses below this don't divide.
FLOOR = 1e-12


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Share of each token id in the corpus; the table has as many rows as ids fit in 16 bits, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, dtype=np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=VOCABULARY)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "n"])

    rows = tokens.select("tokens").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY)
    out[rows["token"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out / max(1.0, out.sum())


def stand_in(share: np.ndarray, bos: int | None = BOS) -> Losses:
    """Losses of the stand-in pair; with a `bos` every chunk begins with it unless it does already."""

    def losses(chunk: np.ndarray) -> tuple[int, int]:
        if bos is not None and chunk[0] != bos:
            chunk = np.concatenate([[bos], chunk])
            skip = 1  # the chunk's own first token is context, not a target
        else:
            skip = 0
        order = np.argsort(chunk, kind="stable")
        same = chunk[order]
        start = np.concatenate([[True], same[1:] != same[:-1]])
        head = np.maximum.accumulate(np.where(start, np.arange(len(chunk)), 0))
        earlier = np.empty(len(chunk), dtype=np.int64)
        earlier[order] = np.arange(len(chunk)) - head
        at = np.arange(1 + skip, len(chunk))
        p = share[chunk[at]]
        base = -np.log(0.5 * (earlier[at] / at) + 0.5 * p)
        reference = -np.log(p)
        return int(np.floor(base * MICRO + 0.5).sum()), int(np.floor(reference * MICRO + 0.5).sum())

    return losses


def score(tokens: DataFrame, losses: Losses, length: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, l_base, l_ref) in millionths of a nat: sums over the chunks of tokens(doc_id, *keep, tokens).

    Targets are the second token to the last, each once; a chunk has the token before its first target as context. A document of one
    token has no targets and losses of 0.
    """
    columns = ["doc_id", *keep]
    fields = ", ".join(f"{c} {t}" for c, t in tokens.select(*columns).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(len(columns))
            flat, edge = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.array(ids.value_lengths()))])
            base, reference = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
            for i in range(b.num_rows):
                t = flat[edge[i] : edge[i + 1]]
                for k in range(0, len(t) - 1, length):
                    x, y = losses(t[k : k + length + 1])
                    base[i] += x
                    reference[i] += y
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(base), pa.array(reference)], names=[*columns, "l_base", "l_ref"])

    return tokens.select(*columns, "tokens").mapInArrow(run, f"{fields}, l_base bigint, l_ref bigint")


def ai_score(scored: DataFrame) -> DataFrame:
    """Adds ai_score, the relative rise of the loss, rounded to 6 places."""
    base, reference = F.col("l_base") / F.lit(float(MICRO)), F.col("l_ref") / F.lit(float(MICRO))
    return scored.withColumn("ai_score", F.round((reference - base) / F.greatest(base, F.lit(FLOOR)), 6))


def until(placed: DataFrame, max_tokens: int | None) -> DataFrame:
    """The documents up to the first with which the tokens seen reach max_tokens, that one included; always the first. None: all."""
    if max_tokens is None:
        return placed
    return placed.where((F.col("total_tokens_seen") - F.col("n_tokens") < max_tokens) | (F.col("total_tokens_seen") == F.col("n_tokens")))
