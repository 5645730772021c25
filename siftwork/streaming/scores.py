"""Scores of documents as they arrive, with Structured Streaming.

Token frequencies are those of a corpus known beforehand, so a document's score doesn't depend on what else arrives, and no state is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siftwork.operators.packing import token_table
from siftwork.operators.scoring import ai_score, score, stand_in

SCHEMA = "doc_id long, text string"


def read(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Documents of Parquet files that arrive in a folder, at most `files` of them at a time."""
    source = spark.readStream.schema(SCHEMA)
    return (source if files is None else source.option("maxFilesPerTrigger", files)).parquet(path)


def scored(docs: DataFrame, share: np.ndarray, length: int) -> DataFrame:
    """(doc_id, n_tokens, l_base, l_ref, ai_score) of a stream, or of a table, of documents."""
    return ai_score(score(token_table(docs), stand_in(share), length, ("n_tokens",)))


def start(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to Parquet files under path, each document once, and ends; run again for what comes later."""
    return scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
