"""Attention heads by how well they copy, and weights with such heads cut out.

What attends to what comes from a provider: rows (probe_id, head, query_pos, attended_pos) for answer positions. The one built in is a stand-in for
a neural model's attention: vectors of a table stand for tokens, a head sees its own slice of them, and attention is their inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.operators.ranking import how_many

EPSILON = 1e-12


def sequences(vectors: DataFrame, length: int) -> DataFrame:
    """(probe_id, pos, token, v): `length` consecutive vec_ids are a sequence; a vector's label is its token."""
    return vectors.select(F.expr(f"vec_id div {length}").alias("probe_id"), F.expr(f"cast(vec_id % {length} as int)").alias("pos"), F.col("label").alias("token"), F.col("embedding").cast("array<double>").alias("v"))


def probe_sequences(tokens: DataFrame, vector: Column) -> DataFrame:
    """(probe_id, pos, token, v, n_prompt) of tokens(id, tokens, n_prompt); `vector` is that of the column token."""
    return tokens.select(F.col("id").alias("probe_id"), "n_prompt", F.posexplode("tokens").alias("pos", "token")).withColumn("v", vector)


def _early(prompt: int | None) -> Column:
    """Whether a position is in the prompt: of a length that all probes have, or of their own."""
    return F.col("pos") < (F.col("n_prompt") if prompt is None else F.lit(prompt))


def attention(seq: DataFrame, prompt: int | None, n_heads: int) -> DataFrame:
    """(probe_id, head, query_pos, attended_pos): the first prompt position of the largest inner product, for every later position and head.

    prompt: positions of every prompt, or None where seq has n_prompt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for probe, steps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pos, v, first = (np.array([s[k] for s in steps]) for k in ("pos", "v", "early"))
                width = v.shape[1] // n_heads
                early, late = v[first], v[~first]
                if not len(early):
                    continue
                for h in range(n_heads):
                    part = slice(h * width, (h + 1) * width)
                    best = (late[:, part] @ early[:, part].T).argmax(axis=1)
                    for q, k in zip(pos[~first].tolist(), pos[first][best].tolist(), strict=True):
                        for column, x in zip(out, (probe, h, q, k), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.int32()) for c in out[1:])], names=["probe_id", "head", "query_pos", "attended_pos"])

    whole = seq.groupBy("probe_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v", _early(prompt).alias("early")))).alias("steps"))
    return whole.mapInArrow(run, "probe_id long, head int, query_pos int, attended_pos int")


def copy_recall(seq: DataFrame, attended: DataFrame, prompt: int | None) -> DataFrame:
    """(head, hits, attempts, recall): of the answer tokens that the prompt has too, how many attend to one that equals them."""
    tokens = seq.select("probe_id", "pos", "token", _early(prompt).alias("early"))
    early = tokens.where("early")
    can = tokens.where("not early").join(early.select("probe_id", "token").distinct(), ["probe_id", "token"], "left_semi")
    tried = attended.join(can.select("probe_id", F.col("pos").alias("query_pos"), "token"), ["probe_id", "query_pos"])
    seen = tried.join(early.select("probe_id", F.col("pos").alias("attended_pos"), F.col("token").alias("attended_token")), ["probe_id", "attended_pos"])
    out = seen.groupBy("head").agg(F.count_if(F.col("token") == F.col("attended_token")).alias("hits"), F.count("*").alias("attempts"))
    return out.withColumn("recall", F.round(F.col("hits") / (F.col("attempts") + F.lit(EPSILON)), 6))


def best_heads(recall: DataFrame, heads_per_layer: int, per_cent: float) -> DataFrame:
    """(rank, layer, head_in_layer, recall) of the best ceil(n * per_cent / 100) heads, ties to the smaller number; rank from 1."""
    k = how_many(recall.count(), per_cent)
    top = recall.orderBy(F.desc("recall"), "head").limit(k)
    # k rows
    rows = top.agg(F.collect_list(F.struct("recall", "head")).alias("r")).select(F.posexplode(F.array_sort("r", lambda a, b: F.when(a["recall"] > b["recall"], -1).when(a["recall"] < b["recall"], 1).otherwise(a["head"] - b["head"]))).alias("i", "r"))
    return rows.select((F.col("i") + 1).alias("rank"), F.expr(f"cast(r.head div {heads_per_layer} as int)").alias("layer"), F.expr(f"cast(r.head % {heads_per_layer} as int)").alias("head_in_layer"), F.col("r.recall").alias("recall"))


def masked(weights: DataFrame, heads: DataFrame, head_dim: int, n_heads: int, group: int = 1) -> DataFrame:
    """weights(layer, proj, row_idx, w) with zeros in the rows of the heads(layer, head): blocks of head_dim rows.

    In projections other than q a block of rows serves `group` heads. Raises IndexError for a head outside 0..n_heads-1.
    """
    if heads.where(~F.col("head").between(0, n_heads - 1)).limit(1).count():
        raise IndexError(f"a head outside 0..{n_heads - 1}")
    block = F.expr(f"cast(row_idx div {head_dim} as int)")
    q = heads.select("layer", F.lit("q").alias("proj"), F.col("head").alias("block"))
    kv = heads.select("layer", F.explode(F.array(F.lit("k"), F.lit("v"))).alias("proj"), F.expr(f"cast(head div {group} as int)").alias("block"))
    # No more rows than three times the heads of the model.
    cut = q.unionByName(kv).distinct().withColumn("cut", F.lit(True))
    joined = weights.withColumn("block", block).join(F.broadcast(cut), ["layer", "proj", "block"], "left")
    zero = F.transform("w", lambda x: F.lit(0.0))
    return joined.select("layer", "proj", "row_idx", F.col("cut").isNotNull().alias("masked"), F.when(F.col("cut").isNotNull(), zero).otherwise(F.col("w")).alias("w"))


def without_sampling(settings: dict) -> dict:
    """Generation settings without those that only sampling uses, if sampling is off."""
    if settings.get("do_sample") is not False:
        return dict(settings)
    return {k: None if k in ("temperature", "top_p", "top_k", "top_n") else v for k, v in settings.items()}
