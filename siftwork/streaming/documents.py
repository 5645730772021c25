"""Documents of token shards that arrive in any order, with Structured Streaming.

One query appends the documents that lie within a shard, without any state. Another one has a state for each boundary between two shards, and
never one for the whole stream: what has come first, the tail before it or the head behind it, waits there for the other. Where the shard behind a
boundary has no end of a document, tail and shard together are a tail for the next boundary; it is written to a folder that the source reads, so
that a document may go on through any number of shards, one batch for each.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siftwork.functions.tokens import EOS
from siftwork.operators.packing import DASH
from siftwork.session import prepare
from siftwork.sources import arriving
from siftwork.sources.shards import local

#: Files of what a batch passes on, at most.
PASSED = 8
STATE = "kind string, closed boolean, pointer string, tokens binary"


class Boundary(StatefulProcessor):
    """Joins the tail before a boundary with the head behind it, whichever comes first. Each comes once; nothing is held when both have been there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {}
        if self.waiting.exists():
            kind, *rest = self.waiting.get()
            held[kind] = rest
        for frame in rows:
            for r in frame.itertuples(index=False):
                held.setdefault(r.kind, [bool(r.closed), r.pointer, bytes(r.tokens)])
        if len(held) < 2:
            for kind, rest in held.items():
                self.waiting.update((kind, *rest))
            return
        (_, before, a), (closed, behind, b) = held["tail"], held["head"]
        pointer, tokens = DASH.join(p for p in (before, behind) if p), a + b
        self.waiting.clear()
        if not closed:
            yield pd.DataFrame([(key[0] + 1, "tail", False, pointer, tokens)], columns=arriving.NAMES)
        elif tokens:
            yield pd.DataFrame([(None, "document", True, pointer, tokens)], columns=arriving.NAMES).astype({"boundary": "Int64"})

    def close(self) -> None:
        pass


def _source(spark: SparkSession, path: str, log: str, part: str, eot: int, most: int | None) -> DataFrame:
    source = arriving.register(prepare(spark)).readStream.format("arriving_shards").option("path", path).option("log", f"{log}/{part}").option("part", part).option("eot", eot)
    return (source if most is None else source.option("most", most)).load()


def start(spark: SparkSession, path: str, out: str, state: str, eot: int = EOS, most: int | None = None) -> list[StreamingQuery]:
    """Two queries that append the documents of shards in the folder `path` to Parquet under `out`; `state` holds what a restart needs.

    most: files of a batch; where many wait it takes a share of them, so that batches are few. Rows of a batch go to a folder with its number, which a repeated batch writes anew.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    joined = _source(spark, path, f"{state}/log", "edges", eot, most).groupBy("boundary").transformWithStateInPandas(Boundary(), outputStructType=arriving.SCHEMA, outputMode="Append", timeMode="None")
    passed = local(f"{state}/log/edges/passed")

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("boundary is null").select("pointer", "tokens").write.mode("overwrite").parquet(f"{out}/joined/batch={number}")
        some = batch.where("boundary is not null")
        # The folder gets its name when it is whole, and keeps it if the batch is repeated.
        if not some.isEmpty() and not os.path.exists(f"{passed}/{number}"):
            # As few files as can be: each is one that the source takes in.
            some.coalesce(PASSED).write.mode("overwrite").parquet(f"{passed}/.{number}")
            os.replace(f"{passed}/.{number}", f"{passed}/{number}")
        batch.unpersist()

    def save_whole(batch: DataFrame, number: int) -> None:
        batch.select("pointer", "tokens").write.mode("overwrite").parquet(f"{out}/whole/batch={number}")

    whole = _source(spark, path, f"{state}/log", "documents", eot, most)
    return [q.option("checkpointLocation", f"{state}/{name}").start() for name, q in (("whole", whole.writeStream.foreachBatch(save_whole)), ("joined", joined.writeStream.foreachBatch(save)))]


def run(spark: SparkSession, path: str, out: str, state: str, eot: int = EOS, most: int | None = None) -> None:
    """Takes in all that has arrived, and ends; run again for what comes later."""
    queries = start(spark, path, out, state, eot, most)
    try:
        for q in queries:
            q.processAllAvailable()
    finally:
        for q in queries:
            q.stop()


def read(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, tokens, n_tokens) of the documents so far; ids are pointers."""

    @F.pandas_udf("array<int>")
    def numbers(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: np.frombuffer(t, dtype="<u2").astype(np.int32))

    kept = spark.read.schema("pointer string, tokens binary").option("recursiveFileLookup", True).parquet(out)
    return kept.select(F.col("pointer").alias("doc_id"), numbers("tokens").alias("tokens"), F.expr("octet_length(tokens) div 2").alias("n_tokens"))
