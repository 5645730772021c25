"""A corpus from raw documents to packed sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import jaccard, mixing, packing, suffixes, toxicity
from siftwork.llm.storage import delete, table_path
from siftwork.session import prepare, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents; n_chars is that of the text as it is now."""
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain, keep=True).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.one_of_each(docs).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _documents(suffixes.strip(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources occur up to twice; every document occurs."""
    prepare(spark)
    return mixing.mixture(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, the merged transforms and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again for the next, and deleted once that is written."""
    docs, paths = table(prepare(spark), sf_dir, "documents"), []
    try:
        for name, stage in STAGES[:-1]:
            paths.append(table_path(spark, name))
            stage(spark, docs, sf_dir).write.parquet(paths[-1])
            for path in paths[:-1]:
                delete(spark, path)
            del paths[:-1]
            docs = spark.read.parquet(paths[-1])
        return STAGES[-1][1](spark, docs, sf_dir).checkpoint()
    finally:
        for path in paths:
            delete(spark, path)
